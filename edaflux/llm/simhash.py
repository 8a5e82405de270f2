"""SimHash fingerprints, and their links at a small Hamming distance through a segment-popcount embedding.

A fingerprint is cut into segments of two bits and mapped to its vector of segment bit counts. One differing bit changes one count by at most one, so the Manhattan distance of two vectors is never above the
Hamming distance of their fingerprints. The vector's coordinates are dealt into ``groups``; within ``radius`` units at
most ``radius`` groups differ, so two linked fingerprints share the grid cell of at least one choice of ``groups -
radius`` groups. Members of a cell are compared by the Manhattan bound and then exactly.

Cells may be of any size. Up to ``CELL`` distinct fingerprints a cell is one array, compared in one task; an edge for
each member stands for its links. The members of larger cells are looked up in another exact way: each fingerprint is
listed under itself and its 64 one-bit neighbours, so two of them within two bits meet under a common neighbour, and no
such list can hold over 65.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edaflux.llm.components import components
from edaflux.llm.frames import fresh, map_rows, stored

CELL = 256
# Each shingle of a slice is an object of its own.
SLICE_BYTES = 1_000_000
_LANES = np.uint64(0x0101010101010101)
_ODD = 0x5555555555555555


def shingles(text: bytes | None, size: int) -> list[bytes]:
    """The text's runs of ``size`` words, repeats included; a text of fewer words is one run, one without words none."""
    words = text.lower().split() if text else []  # bytes: A-Z only, and ASCII white space
    line = b" ".join(words)
    if len(words) <= size:
        return [line] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    return [line[a:b] for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def shingle_hashes(text: bytes | None, size: int) -> list[int]:
    return [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, size)]


def fingerprints(texts: list[bytes | None], shingle: int = 3) -> np.ndarray:
    """64-bit SimHash of each text's word shingles (repeats included), as signed longs; no words give zero."""
    return simhashes([shingle_hashes(t, shingle) for t in texts])


def simhashes(texts: list) -> np.ndarray:
    """64-bit SimHash of each list or array of hashes, as signed longs; none give zero."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if not full.size:
        return out.view(np.int64)
    h = np.concatenate([np.array(t, np.uint64) for t in texts])
    # Eight counters to a word, each of one byte: sum runs of at most 255 hashes, then add the runs of a text.
    runs = -(-sizes[full] // 255)
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    text_at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    run_at = np.repeat(text_at, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    for shift in range(8):
        packed = np.add.reduceat((h >> np.uint64(shift)) & _LANES, run_at)
        counts = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            on = 2 * counts[:, byte] > sizes[full]
            out[full[on]] |= np.uint64(1 << (8 * byte + shift))
    return out.view(np.int64)


def segment_counts(fingerprint: Column) -> Column:
    """The embedding, packed: two bits hold the bit count of each two-bit segment."""
    other = F.shiftrightunsigned(fingerprint, 1)
    one, both = (x.bitwiseAND(F.lit(_ODD)) for x in (fingerprint.bitwiseXOR(other), fingerprint.bitwiseAND(other)))
    return one.bitwiseOR(F.shiftleft(both, 1))


def _group_mask(group: int, groups: int) -> int:
    return sum(3 << (2 * s) for s in range(32) if s * groups // 32 == group)


def _links_of_cell(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """For each member of a cell an edge to the first member that exact links reach from it inside the cell."""
    x = members.view(np.uint64)
    one, pair = (x ^ (x >> np.uint64(1))) & np.uint64(_ODD), x & (x >> np.uint64(1)) & np.uint64(_ODD)
    counts = one | (pair << np.uint64(1))

    def near(a: int, z: int) -> np.ndarray:
        """Rows a to z against all members: the Manhattan bound first, then the bits."""
        bound = np.zeros((z - a, len(x)), np.int16)
        for k in range(0, 64, 2):
            c = ((counts >> np.uint64(k)) & np.uint64(3)).astype(np.int8)
            bound += np.abs(c[a:z, None] - c[None, :])
        row, column = np.nonzero(bound <= radius)
        hit = np.zeros(bound.shape, bool)
        hit[row, column] = np.bitwise_count(x[a + row] ^ x[column]) <= radius
        return hit

    label = np.arange(len(x))
    while True:
        low = np.concatenate([np.where(near(a, min(a + 256, len(x))), label[None, :], len(x)).min(1) for a in range(0, len(x), 256)])
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    return [(int(members[i]), int(members[r])) for i, r in enumerate(label) if i != r]


def _cell_links(radius: int):
    def run(batches):
        kind = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        for batch in batches:
            links = [p for m in batch.column(0).to_pylist() for p in _links_of_cell(np.array(m, np.int64), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], schema=kind)

    return run


def fingerprint_links(distinct: DataFrame, radius: int = 2, groups: int = 4) -> DataFrame:
    """Edges (u, v) among distinct fingerprints ``fp`` whose components are those of all links within ``radius`` bits, 0 to 2."""
    if not 0 <= radius <= 2:
        raise ValueError("links of more than two bits are not found")
    cells = []
    for k, chosen in enumerate(combinations(range(groups), groups - radius)):
        mask = sum(_group_mask(g, groups) for g in chosen)
        mask -= (mask >> 63) << 64
        cells.append(F.struct(F.lit(k).alias("plane"), segment_counts(F.col("fp")).bitwiseAND(F.lit(mask)).alias("cell")))
    keyed = distinct.select("fp", F.explode(F.array(*cells)).alias("at")).select("fp", "at.plane", "at.cell")
    sizes = keyed.groupBy("plane", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes, ["plane", "cell"]))
    small = shared.where(F.col("n") <= CELL).groupBy("plane", "cell").agg(F.collect_list("fp").alias("members"))
    edges = small.select("members").mapInArrow(_cell_links(radius), "u long, v long")
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << b) - ((1 << b) >> 63 << 64))) for b in range(64)])
    crowded = shared.where(F.col("n") > CELL).select("fp").distinct()
    balls = crowded.select("fp", F.explode(flips).alias("near")).groupBy("near").agg(F.collect_list("fp").alias("members"))
    star = balls.where(F.size("members") > 1).select(
        F.explode("members").alias("u"), F.array_min("members").alias("v")
    ).where("u <> v")
    if radius < 2:
        star = star.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    return edges.unionByName(star)


def _grouped(docs: DataFrame, shingle: int, radius: int, groups: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, mark, fp), ``mark`` a hash of the text; and for each fingerprint its (fp, root, component_id)."""
    kind = docs.schema[key].dataType.simpleString()

    def work(rows: dict) -> dict:
        return {"key": rows["key"], "mark": rows["mark"], "fp": fingerprints(rows["text"], shingle)}

    picked = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    marked = stored(map_rows(picked, work, f"key {kind}, mark long, fp long", binary=True, limit=SLICE_BYTES))
    distinct = stored(marked.groupBy("fp").agg(F.min("key").alias("first")))
    return marked, labels(distinct, fingerprint_links(distinct.select("fp"), radius, groups))


def labels(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """For each row (fp, first) its (fp, root, component_id), the component's smallest ``first``."""
    linked = stored(components(edges).withColumnRenamed("node", "fp"))
    least = linked.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("least"))
    label = linked.join(least, "root").select("fp", "root", "least")
    return stored(
        distinct.join(label, "fp", "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id")
        )
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 2, groups: int = 4, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (key, fingerprint, component_id), one for each input row; ``component_id`` is the smallest key reachable
    through links of ``radius`` bits, the row's own included.

    Copies share a fingerprint and are linked once. Null and empty texts, and texts of white space, have fingerprint zero
    and link like any other. A null key takes part, but is no component's smallest key unless all are null. Repeated
    rows stay. Other columns are not read. An empty table gives an empty result.
    """
    marked, final = _grouped(docs, shingle, radius, groups, key, text)
    return marked.join(final, "fp").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, shingle: int = 3, radius: int = 2, groups: int = 4, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one row of each component: the smallest key's (of several texts under that key, the one with the
    least hash; of repeated rows, one). Rows with null keys stay only where a component has no other. Columns as they
    were."""
    return first_of_each(docs, *_grouped(docs, shingle, radius, groups, key, text), key, text)


def first_of_each(docs: DataFrame, marked: DataFrame, final: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with one row of each root of ``final`` (fp, root); ``marked`` has each row's (key, mark, fp)."""
    rank = F.struct(F.col("key").isNull().alias("no_key"), "key", "mark")
    chosen = marked.join(final, "fp").groupBy("root").agg(F.min(rank).alias("row"))
    wanted = stored(chosen.select(F.col("row.key").alias("_key"), F.col("row.mark").alias("_mark")))
    same = docs[key].eqNullSafe(wanted["_key"]) & (F.xxhash64(docs[text]) == wanted["_mark"])
    kept = docs.join(wanted, same, "left_semi")
    repeated = marked.groupBy("key", "mark").count().where("count > 1").limit(1).count() > 0
    if not repeated:
        return kept
    # A key given twice with one text: keep one row of them. Other columns may differ, so rows can't just be distinct.
    row = Window.partitionBy(F.col(key), F.xxhash64(text)).orderBy(F.lit(0))
    name = fresh(docs, "_row")
    return kept.withColumn(name, F.row_number().over(row)).where(F.col(name) == 1).drop(name)
