"""Part of wayline."""
