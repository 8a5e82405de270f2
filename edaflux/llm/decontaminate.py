"""Benchmark decontamination by an FM-index of each training shard.

A shard is a bounded run of a task's documents as word numbers. Words that occur in no test phrase are all number zero:
no phrase can match across one, so a run of them is one separator. The shard's suffix array is built by prefix doubling,
with every separator a sentinel of its own, which ends all comparisons. The Burrows-Wheeler transform is held as a
wavelet matrix. All phrases are searched at once, last word first, by ranks; their occurrences are located by walking
back to sampled suffix positions; the located spans are merged per document.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edaflux.llm.frames import fresh, slices

WINDOW = 10
SAMPLE = 8
# A benchmark above this many bytes is searched in parts, one pass over the documents for each.
PART_BYTES = 8 << 20
_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(c if c in _KEEP else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters (as lower case), digits and non-ASCII bytes."""
    return text.translate(_FOLD).split() if text else []


class WaveletMatrix:
    """Rank of any symbol at many positions of a sequence at once."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels = []
        now = sequence
        for b in range(bits - 1, -1, -1):
            on = (now >> b) & 1
            ones = np.concatenate([[0], np.cumsum(on, dtype=np.int32)]).astype(np.int32)
            self.levels.append((b, ones, len(now) - int(ones[-1])))
            now = np.concatenate([now[on == 0], now[on == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol[k]`` before ``position[k]``."""
        begin, at = np.zeros_like(position), position
        for b, ones, zeros in self.levels:
            on = ((symbol >> b) & 1).astype(bool)
            left, right = ones[begin], ones[at]
            begin, at = np.where(on, zeros + left, begin - left), np.where(on, zeros + right, at - right)
        return at - begin


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, separators (zero) ranked among themselves by position, so that each ends a comparison."""
    n = len(symbols)
    stops = symbols == 0
    rank = symbols.astype(np.int64) + stops.sum()
    rank[stops] = np.arange(stops.sum())
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (max(n, int(rank.max())) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class FmIndex:
    """Backward search and locate over one shard."""

    def __init__(self, symbols: np.ndarray):
        order = suffix_array(symbols)
        self.bwt = symbols[order - 1]
        bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.matrix = WaveletMatrix(self.bwt, bits)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << bits))])
        self.sampled = (order % SAMPLE == 0) | (symbols[order - 1] == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases (rows of word numbers, padded on the right)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((k < lengths) & (low < high))
            c = phrases[live, k]
            low[live] = self.starts[c] + self.matrix.rank(c, low[live])
            high[live] = self.starts[c] + self.matrix.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one (a suffix behind a separator always is)."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while True:
            walk = np.flatnonzero(~self.sampled[at])
            if not walk.size:
                return self.samples[self.sample_rank[at]] + steps
            c = self.bwt[at[walk]]
            at[walk] = self.starts[c] + self.matrix.rank(c, at[walk])
            steps[walk] += 1


class Phrases:
    """The distinct windows of a benchmark, and which items hold each."""

    def __init__(self, items: tuple[tuple[int, bytes], ...], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for k in range(max(1, len(words) - window + 1) if words else 0):
                holders.setdefault(tuple(words[k : k + window]), set()).add(item)
        self.lengths = np.array([len(p) for p in holders], np.int64)
        self.rows = np.zeros((len(holders), window), np.int64)
        for i, p in enumerate(holders):
            self.rows[i, : len(p)] = p
        self.holders = [sorted(h) for h in holders.values()]
        self.shortest = int(self.lengths.min(initial=window))

    def find(self, numbers: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences in documents of word numbers: (document, first word, phrase)."""
        none = (np.zeros(0, np.int64),) * 3
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        if not len(self.rows) or not sizes.sum():
            return none
        flat = np.concatenate([np.array(n, np.int64) for n in numbers if n])
        doc = np.repeat(np.arange(len(numbers)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # Runs of known words inside one document; a run shorter than every phrase can't hold one.
        known = flat > 0
        edge = np.concatenate([[True], (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])])
        begin = np.flatnonzero(edge)
        length = np.diff(np.append(begin, len(flat)))
        keep = known[begin] & (length >= self.shortest)
        begin, length = begin[keep], length[keep]
        if not begin.size:
            return none
        # Each kept run behind one separator.
        out = np.cumsum(length + 1) - length
        symbols, source = np.zeros(int((length + 1).sum()) + 1, np.int64), np.zeros(int((length + 1).sum()) + 1, np.int64)
        inside = np.repeat(out - (np.cumsum(length) - length), length) + np.arange(length.sum())
        source[inside] = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
        symbols[inside] = flat[source[inside]]
        index = FmIndex(symbols)
        phrases = np.flatnonzero((self.rows < len(index.starts) - 1).all(1))
        low, high = index.search(self.rows[phrases], self.lengths[phrases])
        hits = high - low
        rows = np.repeat(low - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())
        at = source[index.locate(rows)]
        return doc[at], place[at], np.repeat(phrases, hits)

    def search(self, texts: list[bytes | None]) -> list[tuple[int, list[list[int]], list[int]]]:
        """For each text its words, the merged spans (first and last word, from 0) of all occurrences, and their items."""
        get = self.number.get
        numbers = [[get(w, 0) for w in words_of(t)] for t in texts]
        doc, first, phrase = self.find(numbers)
        spans, items = [[] for _ in numbers], [set() for _ in numbers]
        last = first + self.lengths[phrase] - 1
        for d, a, b, p in zip(doc.tolist(), first.tolist(), last.tolist(), phrase.tolist(), strict=True):
            spans[d].append([a, b])
            items[d].update(self.holders[p])
        return [(len(n), merged(s), sorted(i)) for n, s, i in zip(numbers, spans, items, strict=True)]


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Spans in order, those that touch or overlap made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def without(text: bytes, spans: list[list[int]]) -> bytes:
    """The text less each span, from its first word's first byte to its last word's last byte."""
    folded = np.frombuffer(text.translate(_FOLD), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[False], folded, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : begin[a]])
        at = end[b]
    return b"".join([*kept, text[at:]])


@lru_cache(2)
def _phrases(items: tuple, window: int) -> Phrases:
    return Phrases(items, window)


def benchmark_parts(benchmark: DataFrame, item: str = "item_id", text: str = "text", limit: int = PART_BYTES) -> list[tuple]:
    """The benchmark as parts of at most about ``limit`` bytes, each fetched when it is asked for.

    Null texts have no words; rows with a null item are left out, as no item could be named for them.
    """
    rows = benchmark.select(F.col(item).alias("item"), F.encode(text, "utf-8").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text") + 16)).head()[0] or 0
    parts = 1 + int(size) // limit
    for p in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p)
        yield tuple(sorted((r[0], bytes(r[1])) for r in part.collect()))


_KIND = "struct<n_words: bigint, spans: array<array<int>>, items: array<bigint>>"


def with_contamination(
    docs: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW, text: str = "text", item: str = "item_id",
    item_text: str = "text", limit: int = PART_BYTES,
) -> DataFrame:
    """``docs`` with a column ``name``: a struct of n_words, the merged spans (first and last word) and the item ids.

    One output row for each input row; null and empty texts have no words and no spans. Only the text is sent to Python,
    and nothing is shuffled. One benchmark part is the usual case. More parts are searched one after another in the same
    pass, each adding to the spans and items found before it. An empty benchmark finds nothing.
    """

    def searcher(part: tuple):
        def search(texts: pa.Array, before: pa.Array) -> pa.Array:
            rows, out = texts.cast(pa.binary()).to_pylist(), []
            for begin, end in slices(rows):
                out += _phrases(part, window).search(rows[begin:end])
            for k, old in enumerate(before.to_pylist()):
                if old is not None:
                    out[k] = (out[k][0], merged(out[k][1] + old["spans"]), sorted({*out[k][2], *old["items"]}))
            fields = [("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.int64()))]
            return pa.StructArray.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])

        return F.arrow_udf(search, _KIND)

    found = F.lit(None).cast(_KIND)
    for part in benchmark_parts(benchmark, item, item_text, limit):
        found = searcher(part)(F.col(text), found)
    return docs.withColumn(name, found)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_words, n_hit, n_items, items_sha256, contaminated), one for each input row; no item hashes as an
    empty text. Null keys and repeated rows stay."""
    found = with_contamination(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), benchmark, "found", window)
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0] + 1)
    names = F.array_join(F.array_sort(F.transform("found.items", lambda i: i.cast("string"))), ",")
    return found.select(
        F.col("key").alias(key), F.col("found.n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` with every merged span cut from its text; all other rows and columns as they were."""

    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([None if t is None else without(t, s).decode() for t, s in rows], pa.string())

    name = fresh(docs, "_found")
    found = with_contamination(docs, benchmark, name, window, text)
    hit = F.size(F.col(name)["spans"]) > 0
    clean = F.arrow_udf(cut, "string")(F.when(hit, F.col(text)), F.when(hit, F.col(name)["spans"]))
    return found.withColumn(text, F.when(hit, clean).otherwise(F.col(text))).drop(name)
