"""Operators for training text: encoding, mixing, reading level. Nothing outside this folder imports it."""
