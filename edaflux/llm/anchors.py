"""Repeated fixed-length windows of all documents, found through content-defined anchors.

A window is ``width`` symbols (bytes or words). Its anchor is the place inside it whose ``gram`` symbols have the least
hash, the leftmost of ties; that depends on the window's content alone, so equal windows have equal anchors at equal
offsets. All windows of a document fall into runs of neighbours with one anchor place, about one run in half a window.
A run's content, from its first window's start to its last window's end, is what is compared:

* an anchor that occurs once can hold no repetition, and its run is dropped;
* other runs are counted by (anchor, content) with map-side combine; copies need no more work;
* where an anchor has several contents, one run of each is fetched, and the operator compares the contents of an anchor bucket
  (``refine``). A bucket with more than ``BUCKET`` contents is split by window instead: counted rows of window hashes.

So text itself is shuffled twice (for the fetch and for the result), runs once, repeated ones again, and windows never unless a
bucket is that large. Nothing is gathered whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edaflux.llm.frames import discard, map_rows, stored

# A task compares a bucket of at most so many contents as a whole, in about 120 MB of arrays for windows of 400 bytes.
BUCKET = 4096
# Keys with more than one in this many of all runs are met by broadcast; there can't be more of them than this.
HEAVY = 1000
# Of these a task makes about a hundred times as many bytes of arrays.
SLAB_BYTES = 1 << 19
SLICE_BYTES = 500_000
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE_BITS = np.uint64(34)


class Bytes:
    """A text as bytes."""

    def __init__(self, text: bytes):
        self.line, self.size = text, len(text)

    def values(self) -> np.ndarray:
        return np.frombuffer(self.line, np.uint8).astype(np.uint64) + np.uint64(1)

    def part(self, begin: int, end: int) -> bytes:
        return self.line[begin:end]


class Words:
    """A text as words between ASCII white space, written with one space between them."""

    def __init__(self, text: bytes):
        self.words = text.split()
        self.line, self.size = b" ".join(self.words), len(self.words)
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, self.size) + 1) - 1
        self.ends, self.begins = ends.tolist(), [0, *(ends[:-1] + 1).tolist()]

    def values(self) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.array([digest(w) for w in self.words], np.uint64)

    def part(self, begin: int, end: int) -> bytes:
        return self.line[self.begins[begin] : self.ends[end - 1]]


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(size, _BASE, np.uint64))
        down = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))
    return up, down


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """A mixed polynomial hash of each ``gram`` neighbouring symbols, from prefix sums."""
    up, down = _powers(max(SLICE_BYTES + (SLICE_BYTES >> 3), len(values)))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(values) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima from both ends of blocks of that width."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def window_runs(values: np.ndarray, sizes: np.ndarray, width: int, gram: int):
    """(text, first window, last window, anchor hash) of each run, of texts whose symbols lie end to end."""
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if len(values) < width or not (sizes >= width).any():
        return empty
    h = gram_hashes(values, gram)
    key = (h >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    place = (sliding_least(key, width - gram + 1) & np.uint64((1 << 34) - 1)).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - width + 1, 0)
    text = np.repeat(np.arange(len(sizes)), windows)
    start = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    at = place[start]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    owner = text[first]
    return owner, start[first] - begin[owner], start[last] - begin[owner], h[at[first]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def document_runs(docs: DataFrame, units: type, width: int, gram: int, kind: str) -> DataFrame:
    """Runs of all documents of (key, mark, text): (key, mark, lo, hi, anchor, content)."""

    def work(rows: dict) -> dict:
        made = [units(t) if t else None for t in rows["text"]]
        sizes = np.array([m.size if m else 0 for m in made], np.int64)
        values = [m.values() for m in made if m is not None and m.size]
        owner, lo, hi, anchor = window_runs(np.concatenate(values) if values else np.zeros(0, np.uint64), sizes, width, gram)
        digest = xxhash.xxh3_64_intdigest
        content = [
            _signed(digest(made[o].part(a, b + width))) for o, a, b in zip(owner.tolist(), lo.tolist(), hi.tolist(), strict=True)
        ]
        return {
            "key": [rows["key"][o] for o in owner], "mark": [rows["mark"][o] for o in owner], "lo": lo, "hi": hi,
            "anchor": anchor.view(np.int64), "content": content,
        }

    return map_rows(docs, work, f"key {kind}, mark long, lo int, hi int, anchor long, content long", binary=True, limit=SLICE_BYTES)


Refine = Callable[[list[tuple]], Iterable[list[int]]]


def _compare(refine: Refine):
    """Slabs of whole anchor buckets, in anchor order, through ``refine``; rows come out with their covered windows."""

    def run(batches):
        schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("ranges", pa.list_(pa.list_(pa.int32())))])
        held: list[tuple] = []

        def done(rows):
            found = refine(rows)
            kept = [(r[0], r[1], f) for r, f in zip(rows, found, strict=True) if f]
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], f.type) for i, f in enumerate(schema)], schema=schema)

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if size > SLAB_BYTES and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield done(held)

    return run


def _window_rows(units: type, width: int):
    def run(batches):
        kind = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("k", pa.int32()), ("window", pa.binary())])
        for batch in batches:
            out = []
            for anchor, content, first, n, line in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                unit = units(line)
                for k in range(unit.size - width + 1):
                    out.append((anchor, content, first, n, k, xxhash.xxh3_128_digest(unit.part(k, k + width))))
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(kind)], schema=kind)
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(kind)], schema=kind)

    return run


def met(rows: DataFrame, counted: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``counted``, which has one row of each key and in ``n`` the number of rows with it.

    Keys with more than ``total / HEAVY`` rows are fewer than ``HEAVY``, so they are broadcast and their rows stay where they
    are. Of any other key no task gets more rows than that.
    """
    heavy = counted.where(F.col("n") > total / HEAVY)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(counted.where(F.col("n") <= total / HEAVY), keys, how)
    return rows.join(F.broadcast(heavy), keys, how).unionByName(rest)


def repeated_spans(
    docs: DataFrame, units: type, width: int, gram: int, copied: Column, refine: Refine, kind: str
) -> DataFrame:
    """Rows (key, mark, spans) of the documents of (key, mark, text) that hold repeated windows; spans in symbols.

    ``mark`` is a hash of the text. ``copied`` says, from ``n`` (runs with this content), ``first`` (their smallest key)
    and ``key``, whether a window counts as repeated; ``refine`` does so inside buckets, over rows (anchor, content,
    first, n, line), and gives ranges of windows for each row.
    """
    every = stored(document_runs(docs, units, width, gram, kind))
    # Most anchors occur once. Their runs go before anything wider is shuffled.
    again = stored(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    total = again.agg(F.sum("n")).head()[0] or 0
    runs = stored(met(every, again, ["anchor"], total, "left_semi"))
    discard(every)
    discard(again)
    place = F.struct("key", "mark", "lo", "hi")
    contents = runs.groupBy("anchor", "content").agg(
        F.count("*").alias("n"), F.min("key").alias("first"), F.min(place).alias("place")
    )
    buckets = contents.groupBy("anchor").agg(F.count("*").alias("contents"), F.max("n").alias("most")).where("contents > 1 OR most > 1")
    useful = stored(contents.join(buckets.drop("most"), "anchor"))
    marks = met(runs, useful.select("anchor", "content", "n", "first", "contents"), ["anchor", "content"], total)
    whole = marks.where(copied).select("key", "mark", F.col("lo").alias("begin"), (F.col("hi") + width).alias("end"))

    wanted = useful.where("contents > 1").select(
        F.col("place.key").alias("key"), F.col("place.mark").alias("mark"),
        F.struct("place.lo", "place.hi", "anchor", "content", "first", "n", "contents").alias("run"),
    ).groupBy("key", "mark").agg(F.collect_list("run").alias("runs"))

    def fetch(rows: dict) -> dict:
        out: dict[str, list] = {n: [] for n in ("anchor", "content", "first", "n", "contents", "line")}
        for text, runs_ in zip(rows["text"], rows["runs"], strict=True):
            unit = units(text)
            for r in runs_:
                for n in ("anchor", "content", "first", "n", "contents"):
                    out[n].append(r[n])
                out["line"].append(unit.part(r["lo"], r["hi"] + width))
        return out

    same = docs["key"].eqNullSafe(wanted["key"]) & (docs["mark"] == wanted["mark"])
    asked = docs.join(wanted, same).select("text", "runs")
    lines = map_rows(asked, fetch, f"anchor long, content long, first {kind}, n long, contents long, line binary", binary=True)
    # Repeated rows of one document fetch a content more than once.
    lines = stored(lines.dropDuplicates(["anchor", "content"]))
    usual = lines.where(F.col("contents") <= BUCKET).drop("contents")
    usual = usual.repartition("anchor").sortWithinPartitions("anchor", "content")
    found = usual.mapInArrow(_compare(refine), "anchor long, content long, ranges array<array<int>>")
    windows = lines.where(F.col("contents") > BUCKET).drop("contents").mapInArrow(
        _window_rows(units, width), "anchor long, content long, first long, n long, k int, window binary"
    )
    alike = windows.groupBy("anchor", "window").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    split = windows.select("anchor", "window", "content", F.col("first").alias("key"), "k").join(alike, ["anchor", "window"])
    split = split.where(copied).select("anchor", "content", F.array(F.array("k", "k")).alias("ranges"))
    some = marks.where(~copied).join(found.unionByName(split), ["anchor", "content"])
    # A content's ranges hold for its rows with the smallest key; the others are copies as a whole.
    some = some.where(F.col("key").eqNullSafe(F.col("first"))).select("key", "mark", "lo", F.explode("ranges").alias("r")).select(
        "key", "mark", (F.col("lo") + F.col("r")[0]).alias("begin"), (F.col("lo") + F.col("r")[1] + width).alias("end")
    )
    spans = whole.unionByName(some).groupBy("key", "mark").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    return spans


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents with the spans of theirs, null where there are none."""
    renamed = spans.withColumnsRenamed({"key": "_key", "mark": "_mark"})
    same = docs["key"].eqNullSafe(renamed["_key"]) & (docs["mark"] == renamed["_mark"])
    return docs.join(renamed, same, "left").drop("_key", "_mark")


def joined_spans(spans: list | None) -> list[tuple[int, int]]:
    """Begin and end of maximal covered runs; overlapping and touching spans are one."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        a, b = s["begin"], s["end"]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def ranges_of(hit: np.ndarray) -> list[list[int]]:
    """First and last index of each run of true values."""
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], 1).tolist()
