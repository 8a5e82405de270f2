"""Removal of word sequences that an earlier document holds, by relative Lempel-Ziv parsing.

``anchors`` brings the passages that may be repeated into common buckets; each bucket is a reference block, indexed by
the windows of its passages. A passage is parsed greedily against the part of the block from documents with smaller ids:
where a window's words occur there, the longest match from that occurrence is a factor; elsewhere a word is a literal.
Windows inside a factor are duplicates. The greedy choice may cut a repetition that goes on in another reference, so
the windows that cross the end of a factor are looked up one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edaflux.llm.anchors import Words, joined_spans, ranges_of, repeated_spans, with_spans
from edaflux.llm.frames import fresh, map_rows

WIDTH = 50
GRAM = 8


def parse(words: list[bytes], windows: list[bytes], index: dict, lines: list[list[bytes]], key: int, width: int) -> np.ndarray:
    """Which windows of a passage of document ``key`` occur in the indexed block under a smaller id."""
    hit = np.zeros(len(windows), bool)
    at = 0
    while at < len(windows):
        found = index.get(windows[at])
        if found is None or found[0] >= key:
            at += 1
            continue
        source, place = lines[found[1]], found[2]
        size = width
        while at + size < len(words) and place + size < len(source) and words[at + size] == source[place + size]:
            size += 1
        hit[at : at + size - width + 1] = True
        at += size - width + 1  # the first window that crosses the factor's end
    return hit


def refine_words(width: int):
    def refine(rows: list[tuple]) -> list[list[list[int]]]:
        out: list = [[] for _ in rows]
        # Blocks in the order of their documents: what is indexed when a passage is parsed came from smaller ids or its own.
        order = sorted((i for i, r in enumerate(rows) if r[2] is not None), key=lambda i: (rows[i][0], rows[i][2]))
        block, index, lines = None, {}, []
        for i in order:
            anchor, _, first, _, line = rows[i]
            if anchor != block:
                block, index, lines = anchor, {}, []
            unit = Words(line)
            windows = [xxhash.xxh3_128_digest(unit.part(k, k + width)) for k in range(unit.size - width + 1)]
            out[i] = ranges_of(parse(unit.words, windows, index, lines, first, width))
            for k, w in enumerate(windows):
                index.setdefault(w, (first, len(lines), k))
            lines.append(unit.words)
        return out

    return refine


def _spans(picked: DataFrame, width: int) -> DataFrame:
    return repeated_spans(picked, Words, width, min(GRAM, width), F.coalesce(F.col("first") < F.col("key"), F.lit(False)), refine_words(width), "long")


def repeated_words(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_words, n_removed, kept_sha256), one for each input row.

    A word goes if a window of ``width`` words that covers it also starts in a document with a smaller key; windows are
    judged on the input. A row with a null key is no document with a smaller key and has none. Repeated rows have one
    key and don't count against each other. A null text has no words. Keys are whole numbers. Other columns are not
    read.
    """
    picked = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))

    def digest(rows: dict) -> dict:
        out: dict[str, list] = {n: [] for n in ("key", "n_words", "n_removed", "kept_sha256")}
        for k, t, s in zip(rows["key"], rows["text"], rows["spans"], strict=True):
            words, runs = (t or b"").split(), joined_spans(s)
            kept, at = [], 0
            for a, b in runs:
                kept += words[at:a]
                at = b
            kept += words[at:]
            row = (k, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
            for n, v in zip(out, row, strict=True):
                out[n].append(v)
        return out

    columns = "key long, n_words long, n_removed long, kept_sha256 string"
    return map_rows(with_spans(picked, _spans(picked, width)).drop("mark"), digest, columns, binary=True).withColumnRenamed("key", key)


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text less each run of words, from a run's first byte to its last word's last byte."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    word = ~space[np.frombuffer(text, np.uint8)]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at : begin[a]])
        at = end[b - 1]
    return b"".join([*kept, text[at:]])


def deduplicated(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated words cut from its texts; other rows, columns and white space as they were.

    A text of which nothing is left is empty; a null text stays null.
    """
    key_, mark_, spans_ = (fresh(docs, n) for n in ("_key", "_mark", "_spans"))
    picked = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    found = _spans(picked, width).select(F.col("key").alias(key_), F.col("mark").alias(mark_), F.col("spans").alias(spans_))
    same = docs[key].cast("long").eqNullSafe(found[key_]) & (F.xxhash64(docs[text]) == found[mark_])

    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([None if t is None else without(t, joined_spans(s)).decode() for t, s in rows], pa.string())

    hit = F.col(spans_).isNotNull()
    kept = F.arrow_udf(cut, "string")(F.when(hit, F.col(text)), F.col(spans_))
    return docs.join(found, same, "left").withColumn(text, F.when(hit, kept).otherwise(F.col(text))).select(*docs.columns)
