"""Prefix trie of conversations: ternary search trees over range shards, merged at their boundary nodes.

Each distinct turn (role, text) has a number in a dictionary, so a conversation is a list of numbers. Conversations are
dealt out by ranges of those lists, copies by conversation id as well, so that neither a common beginning nor a
conversation with many copies lies in one task. A task cuts its sorted rows into shards of bounded size and inserts the
distinct lists of a shard, medians first, into a ternary search tree, which is balanced that way at every depth. An
iterative traversal adds up members, children, leaves and savings from the ends to the root.

Only nodes on the path of a shard's first or last list can lie in another shard as well. Those boundary nodes are named
by a 128-bit hash of their path and merged. What a merged node saves, and whether it is a leaf, is added below its
ancestors once, in the first shard that holds it: all its ancestors are boundary nodes of that shard too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edaflux.llm.frames import discard, stored

SHARD_TURNS, SHARD_ROWS = 100_000, 20_000
HOT_TURNS = 1000
HEAD = 9
_NODES = (
    "shard long, key binary, up binary, depth int, conv_id long, parent_conv_id long, n long, children long, leaves long,"
    " saved long, size long, side int, ends string"
)
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (f.split(" ") for f in _NODES.split(", "))])
_ENDS = pa.schema([("key", pa.binary()), ("ends", pa.string())])
_ROOT = bytes(16)


def conversation_lists(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows (conv_id, ids, sizes): a conversation's turns in order, as numbers of the dictionary of distinct (role,
    text), and the UTF-8 bytes of their texts.

    Null roles and texts count as empty. Turns are ordered by turn (nulls first), then by role and the md5 of the text;
    repeated rows stay. Rows without a conversation take no part. A conversation is one row of 12 bytes a turn.
    """
    said, spoke = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    rows = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("long").alias("conv_id"), F.col(turn).alias("turn"), spoke.alias("role"), F.md5(said).alias("mark"),
        F.octet_length(said).alias("size"),
    )
    rows = stored(rows)
    # Numbers follow the order of role and mark, so that they also order the turns of one number.
    counted = rows.groupBy("role", "mark").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    words = stored(counted.orderBy("role", "mark").select("role", "mark", "size", "n", F.monotonically_increasing_id().alias("id")))
    # Turns with a thousandth of all rows are a thousand at most: they are broadcast, and what is left has no hot key.
    total = rows.count()
    hot = F.broadcast(words.where(F.col("n") * HOT_TURNS > total).select("role", "mark", "id"))
    known = rows.join(hot, ["role", "mark"])
    rare = rows.join(hot, ["role", "mark"], "left_anti").join(words.select("role", "mark", "id"), ["role", "mark"])
    one = F.struct("turn", "id", "size")
    lists = known.unionByName(rare).groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    out = stored(lists.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes")))
    discard(rows)
    discard(words)
    return out


def with_shared_heads(lists: DataFrame, every: int = 5, head: int = HEAD) -> DataFrame:
    """Conversation c with its first h turns replaced by those of conversation c - c % ``every``, h being the unsigned
    crc32 of the decimal c modulo ``head``: all of them if they are fewer, none if that conversation does not exist."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).cast("int")
    heads = lists.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_base"), F.slice("ids", 1, head - 1).alias("_ids"), F.slice("sizes", 1, head - 1).alias("_sizes")
    )
    cut = lists.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % every, "_h": h}).join(heads, "_base", "left")

    def rebuilt(own: str, other: str):
        kept = F.slice(own, F.col("_h") + 1, F.greatest(F.size(own), F.lit(1)))
        return F.concat(F.slice(F.coalesce(other, F.slice(own, 1, 0)), F.lit(1), F.col("_h")), kept).alias(own)

    return cut.select("conv_id", rebuilt("ids", "_ids"), rebuilt("sizes", "_sizes"))


class Tree:
    """A ternary search tree over lists of numbers; node ``i`` stands for the lists that begin with its path."""

    def __init__(self):
        self.key, self.low, self.high, self.next = [], [], [], []
        self.n, self.least, self.size = [], [], []
        self.root = -1

    def _new(self, key: int, size: int) -> int:
        for column, value in ((self.key, key), (self.low, -1), (self.high, -1), (self.next, -1), (self.n, 0), (self.least, None), (self.size, size)):
            column.append(value)
        return len(self.key) - 1

    def insert(self, ids: list[int], sizes: list[int], n: int, least: int) -> int:
        """Count ``n`` members of which ``least`` is the smallest along the path; returns the last node, -1 for none."""
        key, low, high, after = self.key, self.low, self.high, self.next
        last = -1
        for depth, x in enumerate(ids):
            at = self.root if last < 0 else after[last]
            if at < 0:
                at = self._new(x, sizes[depth])
                if last < 0:
                    self.root = at
                else:
                    after[last] = at
            while key[at] != x:
                side = low if x < key[at] else high
                if side[at] < 0:
                    side[at] = self._new(x, sizes[depth])
                at = side[at]
            self.n[at] += n
            if self.least[at] is None or least < self.least[at]:
                self.least[at] = least
            last = at
        return last

    def path(self, ids: list[int]) -> list[int]:
        out, at = [], self.root
        for x in ids:
            while self.key[at] != x:
                at = self.low[at] if x < self.key[at] else self.high[at]
            out.append(at)
            at = self.next[at]
        return out

    def parents(self) -> tuple[list[int], list[int]]:
        """Nodes in an order in which each comes after its parent; and the parents, -1 for the root."""
        order, parent = [], [-1] * len(self.key)
        waiting = [self.root] if self.root >= 0 else []
        while waiting:
            at = waiting.pop()
            order.append(at)
            for near in (self.low[at], self.high[at]):
                if near >= 0:
                    parent[near] = parent[at]
                    waiting.append(near)
            if self.next[at] >= 0:
                parent[self.next[at]] = at
                waiting.append(self.next[at])
        return order, parent


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the median of each range before its halves."""
    waiting = [(0, n)]
    while waiting:
        a, z = waiting.pop()
        if a < z:
            m = (a + z) // 2
            yield m
            waiting += [(a, m), (m + 1, z)]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shard_nodes(lists: list[list], number: int) -> dict[str, list]:
    """The nodes of one shard, as columns of ``_NODES``. ``lists`` holds sorted distinct [ids, sizes, n, least, members].

    A boundary node has a ``key``, and only what lies below it in nodes of this shard alone is in ``leaves`` and
    ``saved``. Other nodes are whole, but for the parent's conversation where the parent is a boundary node (``up``).
    """
    tree = Tree()
    ends: dict[int, str] = {}
    for k in medians(len(lists)):
        ids, sizes, n, least, members = lists[k]
        ends[tree.insert(ids, sizes, n, least)] = members
    order, parent = tree.parents()
    one, other = tree.path(lists[0][0]), tree.path(lists[-1][0])
    side = {x: 1 for x in one} | {x: 2 for x in other} | {x: 0 for x in set(one) & set(other)}
    keys = {-1: _ROOT}
    for path in (one, other):
        above = -1
        for x in path:
            keys[x] = xxhash.xxh3_128_digest(keys[above] + tree.key[x].to_bytes(8, "big", signed=True))
            above = x
    count = len(order) + 1  # the root is last, under index -1
    leaves, saved, children, depth = [0] * count, [0] * count, [0] * count, [0] * count
    for at in order:
        depth[at] = depth[parent[at]] + 1 if parent[at] >= 0 else 1
    for at in reversed(order):
        up = parent[at]
        if at not in side:
            children[up] += 1
            saved[at] += (tree.n[at] - 1) * tree.size[at]
            leaves[at] += children[at] == 0
        saved[up] += saved[at]
        leaves[up] += leaves[at]
    out = {name: [] for name in _SCHEMA.names}
    whole, least = sum(x[2] for x in lists), min(x[3] for x in lists)
    for at in [-1, *order]:
        edge, up = at in keys, parent[at] if at >= 0 else None
        row = {
            "shard": number, "key": keys.get(at), "up": keys.get(up), "depth": depth[at], "conv_id": tree.least[at] if at >= 0 else least,
            "parent_conv_id": None if up is None or up in keys else tree.least[up], "n": tree.n[at] if at >= 0 else whole,
            "children": children[at], "leaves": leaves[at], "saved": saved[at], "size": tree.size[at] if at >= 0 else 0,
            "side": side.get(at, 0) if edge else None, "ends": ends.get(at) if edge else digest(ends.get(at, "")),
        }
        for name, value in row.items():
            out[name].append(value)
    return out


def _shards(shard_turns: int, shard_rows: int):
    def run(batches):
        number, lists, turns, rows = TaskContext.get().partitionId() << 32, [], 0, 0

        def made():
            for x in lists:
                x[4] = ",".join(x[4])
            nodes = shard_nodes(lists, number)
            return pa.RecordBatch.from_arrays([pa.array(nodes[f.name], f.type) for f in _SCHEMA], schema=_SCHEMA)

        for batch in batches:
            for conv, ids, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "sizes")), strict=True):
                if lists and (rows >= shard_rows or turns >= shard_turns):
                    yield made()
                    number, lists, turns, rows = number + 1, [], 0, 0
                if lists and lists[-1][0] == ids:
                    lists[-1][2] += 1
                    lists[-1][4].append(str(conv))
                else:
                    lists.append([ids, sizes, 1, conv, [str(conv)]])
                    turns += len(ids)
                rows += 1
        if lists:
            yield made()

    return run


def _digests(batches):
    """SHA-256 of the joined member lists of each key, over rows sorted by key and shard."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(members.encode())
            else:
                state.update(b"," + members.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(_ENDS)], schema=_ENDS)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], schema=_ENDS)


def trie_nodes(lists: DataFrame, shard_turns: int = SHARD_TURNS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one for each
    distinct beginning of the lists, the empty one included.

    ``lists`` has a conv_id, unique, and arrays ids and sizes of one length. A node's conv_id is its smallest member and
    parent_conv_id its parent's (null at the root); saved_tokens sums (members - 1) times the size of the last turn over
    its subtree; ends_sha256 is the digest of the members whose list ends here, in order, comma-joined. Lists without
    turns end at the root. No lists give no nodes.
    """
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = lists.select("conv_id", "ids", "sizes").repartitionByRange(n, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    nodes = stored(sorted_.mapInArrow(_shards(shard_turns, shard_rows), _NODES))
    edge = nodes.where(F.col("key").isNotNull())
    merged = edge.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum("children").alias("inner"), F.min("shard").alias("owner"),
        F.first("up").alias("up"), F.first("depth").alias("depth"), F.max("size").alias("size"),
    )
    merged = stored(merged)
    kids = merged.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("key")).agg(F.count("*").alias("outer"))
    merged = stored(merged.join(kids, "key", "left").withColumn("children", F.col("inner") + F.coalesce("outer", F.lit(0))).drop("inner", "outer"))

    # What merged nodes add to themselves and to what is above them, in the shard that owns them.
    own = merged.select("key", "owner", ((F.col("n") - 1) * F.col("size")).alias("own"), (F.col("children") == 0).cast("long").alias("leaf"))
    here = edge.select("shard", "key", "side", "depth", "leaves", "saved").join(own, "key")
    mine = F.col("owner") == F.col("shard")
    here = here.withColumns({"own": F.when(mine, F.col("own")).otherwise(0), "leaf": F.when(mine, F.col("leaf")).otherwise(0)})
    below = Window.orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, 0)
    every, same = below.partitionBy("shard"), below.partitionBy("shard", "side")

    def upward(column: str):
        return F.when(F.col("side") == 0, F.sum(column).over(every)).otherwise(F.sum(column).over(same))

    added = here.select("key", (F.col("saved") + upward("own")).alias("saved"), (F.col("leaves") + upward("leaf")).alias("leaves"))
    totals = added.groupBy("key").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    parts = edge.where(F.col("ends").isNotNull()).select("key", "ends", "shard").repartition("key").sortWithinPartitions("key", "shard")
    ends = parts.select("key", "ends").mapInArrow(_digests, "key binary, ends string")
    above = merged.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    boundary = merged.join(totals, "key").join(ends, "key", "left").join(above, "up", "left").withColumn("ends", F.coalesce("ends", F.lit(digest(""))))

    # The conversations of boundary parents, matched inside each shard: a common parent is no hot key.
    inner = nodes.where(F.col("key").isNull())
    parents = edge.select("shard", "key").join(merged.select("key", "conv_id"), "key")
    parents = parents.select("shard", F.col("key").alias("up"), F.col("conv_id").alias("_parent"))
    inner = inner.join(parents, ["shard", "up"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    columns = [
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    ]
    return inner.select(*columns).unionByName(boundary.select(*columns))
