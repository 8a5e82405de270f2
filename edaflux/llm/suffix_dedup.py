"""Removal of every byte of a repeated fixed-length string, by suffix sorting with bucket-pointer refinement.

``anchors`` brings the strings that may be repeated into common buckets of bounded size. There the suffixes are sorted as
far as the string length: buckets of equal 8-grams come first, exact, as 64-bit numbers. Each refinement sorts a suffix
by its bucket's number and the number of the bucket that holds the suffix further on by the length already sorted, so
lengths double and every refinement reuses the numbers the last one made. A suffix alone in its bucket is done with, and
so is one that would need such a suffix. The last step overlaps the one before it to end at the length asked for.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edaflux.llm.anchors import Bytes, joined_spans, ranges_of, repeated_spans, with_spans
from edaflux.llm.frames import map_rows

WIDTH = 400
GRAM = 32
FIRST = 8


def shared_buckets(text: np.ndarray, room: np.ndarray, width: int) -> np.ndarray:
    """For each position the bucket of its ``width``-byte string, or -1 where no other position has that string.

    ``room`` is the number of bytes from a position to the end of its own text; shorter strings have no bucket.
    """
    n = len(text)
    kind = np.int32 if n < 1 << 31 else np.int64
    bucket = np.full(n, -1, kind)

    def refine(at: np.ndarray, key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        del order
        new = np.concatenate([[True], key[1:] != key[:-1]])
        del key
        alone = new & np.append(new[1:], True)
        number = np.cumsum(new, dtype=kind) - kind(1)
        bucket[:] = -1
        bucket[at[~alone]] = number[~alone]
        return np.sort(at[~alone])

    size = min(FIRST, width)
    at = np.flatnonzero(room >= size).astype(kind)
    gram = np.zeros(len(at), np.uint64)
    for k in range(size):
        gram <<= np.uint64(8)
        gram |= text[at + kind(k)]
    if not len(at):
        return bucket
    at = refine(at, gram)
    del gram
    while size < width and len(at):
        step = min(size, width - size)
        at = at[room[at] >= size + step]
        at = at[bucket[at + kind(step)] >= 0]
        if not len(at):
            bucket[:] = -1
            break
        # Numbers are below n, so one integer holds the pair.
        at = refine(at, bucket[at] * np.int64(n) + bucket[at + kind(step)])
        size += step
    return bucket


def refine_bytes(width: int):
    def refine(rows: list[tuple]) -> list[list[list[int]]]:
        """Windows of each line that occur again, in another line or elsewhere in the same one."""
        sizes = np.array([len(r[4]) for r in rows], np.int64)
        text = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        kind = np.int32 if len(text) < 1 << 31 else np.int64
        begin = np.cumsum(sizes) - sizes
        room = np.repeat((begin + sizes).astype(kind), sizes)
        room -= np.arange(len(text), dtype=kind)
        shared = shared_buckets(text, room, width) >= 0
        return [ranges_of(shared[b : b + s - width + 1]) if r[3] == 1 else [] for r, b, s in zip(rows, begin, sizes, strict=True)]

    return refine


def repeated_bytes(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, kept_sha256), one for each input row.

    A byte goes if a ``width``-byte string that covers it starts anywhere else, in the same text or another; overlaps
    count, and all strings are judged on the input. Repeated rows are repetitions like any other, so both lose what they
    share. A null text has no bytes; texts shorter than ``width`` stay whole. Keys are whole numbers or null. Other
    columns are not read.
    """
    picked = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    spans = repeated_spans(picked, Bytes, width, min(GRAM, width), F.col("n") > 1, refine_bytes(width), "long")

    def digest(rows: dict) -> dict:
        out: dict[str, list] = {n: [] for n in ("key", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for k, t, s in zip(rows["key"], rows["text"], rows["spans"], strict=True):
            t, runs = t or b"", joined_spans(s)
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(t[at:a])
                at = b
            kept.update(t[at:])
            for n, v in zip(out, (k, len(t), sum(b - a for a, b in runs), len(runs), kept.hexdigest()), strict=True):
                out[n].append(v)
        return out

    columns = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return map_rows(with_spans(picked, spans).drop("mark"), digest, columns, binary=True).withColumnRenamed("key", key)
