"""Encoding of a corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of the operators.
VOCABULARIES = "/opt/tokenizers"
#: Splits text before the merges; part of the vocabulary's definition.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of more characters are cut into pieces of at most so many.
PIECE_CHARS = 8192
BATCH_BYTES = 32 << 20


class Encoder:
    """A rank file as encoder: whole texts, single pieces of bytes, and the places where any text may be cut."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.core = tiktoken.Encoding("wayline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}
        # white space by its Unicode property, as the encoder sees it
        self.pretokens = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.blank = regex.compile(r"\p{White_Space}+")
        # after a letter or digit a character of another kind always begins anew, whatever surrounds the two
        self.safe = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.core.encode_ordinary(text), np.int32)

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Merges only: the piece as part of one unsplit stretch."""
        return self.core._core_bpe.encode_single_piece(piece) if piece else []

    def cut(self, text: str, limit: int = PIECE_CHARS) -> Iterator[tuple[int, str]]:
        """Pieces (run, text). Run 0: encoded alone. Pieces of an equal run > 0 are neighbours inside one unsplit stretch."""
        at, run, n = 0, 0, len(text)
        while at < n:
            if n - at <= limit:
                yield 0, text[at:]
                return
            end = max((m.start() for m in self.safe.finditer(text, at + limit // 2, min(n, at + limit + 1))), default=0)
            if end > at:
                yield 0, text[at:end]
                at = end
                continue
            m = self.safe.search(text, at + 1)
            end = m.start() if m else n
            if end - at <= limit:
                yield 0, text[at:end]
            else:
                # a stretch without safe places: long words, numbers, rows of signs or white space
                small: list[str] = []
                for t in self.pretokens.finditer(text, at, end):
                    long = t.end() - t.start() > limit
                    if long or sum(map(len, small)) > limit // 2:
                        # white space at the end of a piece would be split in another way than before what follows: it stands alone
                        ended = len(small)
                        while ended and self.blank.fullmatch(small[ended - 1]):
                            ended -= 1
                        if ended:
                            yield 0, "".join(small[:ended])
                        for blank in small[ended:]:
                            run += 1
                            yield run, blank
                        small = []
                    if not long:
                        small.append(t.group())
                        continue
                    run += 1
                    for s in range(t.start(), t.end(), limit):
                        yield run, text[s : min(s + limit, t.end())]
                if small:
                    yield 0, "".join(small)
            at = end

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of one stretch from those of its two parts.

        A window of tokens round the join, doubled until its encoding begins with the left part's own token and ends with the right
        part's own: then every two neighbours in the result stand as in a true encoding, which makes it the encoding.
        """
        if not left or not right:
            return left + right
        k = 8
        while True:
            a, b = left[-k:], right[:k]
            w = self.encode_bytes(b"".join(self.bytes_of[i] for i in a + b))
            if (len(a) == len(left) or w[0] == a[0]) and (len(b) == len(right) or w[-1] == b[-1]):
                return left[: len(left) - len(a)] + w + right[len(b) :]
            k *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Neighbouring halves joined up a tree."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES, piece_chars: int = PIECE_CHARS, keep: list[str] | None = None) -> DataFrame:
    """Token ids of every text, without special tokens: (key, ids array<int>, kept columns), one row per row of ``docs``.

    Null and empty texts have no ids (an empty list); strings of special tokens are ordinary text; a null key stays, and repeated rows or keys come
    out as often as they come in. Further columns are dropped unless named in ``keep``. An empty table gives no row. The session's Arrow batches
    are limited to BATCH_BYTES, as long texts must not meet in one.

    Texts up to ``piece_chars`` are encoded in batches. Longer ones are cut in the places where the splitting pattern always
    cuts, and unsplit stretches longer than a piece into blind parts; the pieces spread over the cluster, are encoded in parallel, and
    meet again by text: cut pieces are strung together, blind parts joined up a tree (``Encoder.join``), with exactly the encoding of the whole.
    """
    path = f"{folder}/{vocabulary}.tiktoken"
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    # under names of their own, whatever theirs are
    names = {f"__kept_{i}": c for i, c in enumerate(keep or [])}
    kept = list(names)
    x = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(F.col(c).alias(n) for n, c in names.items()))
    key_type = x.schema["key"].dataType.simpleString()
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in x.schema if f.name in kept)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = _lists([e.encode(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("key"), ids, *(b.column(c) for c in kept)], names=["key", "ids", *kept])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        row = TaskContext.get().partitionId() << 33  # rows are told apart by their place in the table, not by their key
        for b in batches:
            for i, t in enumerate(b.column("text").to_pylist()):
                row += 1
                cut = list(e.cut(t, piece_chars))
                for s in range(0, len(cut), 512):
                    part = cut[s : s + 512]
                    n = len(part)
                    # the first piece carries the row's other columns
                    once = [pa.concat_arrays([b.column(c).slice(i, 1 if s == 0 else 0), pa.nulls(n - (s == 0), b.column(c).type)]) for c in ("key", *kept)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * n, pa.int64()), pa.array(range(s, s + n), pa.int64()), pa.array([r for r, _ in part], pa.int64()), pa.array([p for _, p in part]), *once],
                        names=["row", "no", "run", "text", "key", *kept],
                    )

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            runs, texts = b.column("run").to_pylist(), b.column("text").to_pylist()
            ids = _lists([np.asarray(e.encode_bytes(t.encode()), np.int32) if r else e.encode(t) for r, t in zip(runs, texts, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("no"), b.column("run"), ids, *(b.column(c) for c in ("key", *kept))], names=["row", "no", "run", "ids", "key", *kept])

    def whole(t: pa.Table) -> pa.Table:
        e = encoder(path)
        order = np.argsort(t.column("no").to_numpy(), kind="stable")
        runs = t.column("run").to_numpy()[order]
        ids = t.column("ids").combine_chunks()
        out: list[np.ndarray] = []
        blind: list[list[int]] = []
        for i, (o, r) in enumerate(zip(order.tolist(), runs.tolist(), strict=True)):
            one = ids[o].values.to_numpy(zero_copy_only=False)
            if not r:
                out.append(one)
                continue
            blind.append(one.tolist())
            if i + 1 == len(runs) or runs[i + 1] != r:
                out.append(np.asarray(e.join_all(blind), np.int32))
                blind = []
        first = int(order[0])
        same = [t.column(c).slice(first, 1).combine_chunks() for c in ("key", *kept)]
        return pa.table([same[0], _lists([np.concatenate(out)]), *same[1:]], names=["key", "ids", *kept])

    few = x.where(F.length("text") <= piece_chars).mapInArrow(short, f"key {key_type}, ids array<int>{kinds}")
    long = x.where(F.length("text") > piece_chars)
    schema = f"row long, no long, run long, {{}}, key {key_type}{kinds}"
    encoded = long.mapInArrow(pieces, schema.format("text string")).repartition("row", "no").mapInArrow(parts, schema.format("ids array<int>"))
    joined = encoded.groupBy("row").applyInArrow(whole, f"key {key_type}, ids array<int>{kinds}")
    return few.unionByName(joined).select(F.col("key").alias(key), "ids", *(F.col(n).alias(c) for n, c in names.items()))
