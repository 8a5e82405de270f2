"""Cheapest repair of conversation structure by the auction algorithm for shortest paths.

A conversation is a lattice: nodes are (rows read, state), states are the start, after a system turn, after a user turn,
after an assistant turn; edits are arcs with integer costs. A path starts at an origin with prices that no arc
contradicts (price of a node at most the arc's cost plus the price behind it). Its last node is extended along a tight
arc; where none is tight its price rises to the least offer and the path is contracted by one node. When the path arrives,
the price of the origin is its distance. Every cheapest path is then made of tight arcs, so the ASCII-least string of
edits is traced through the tight arcs from which the end is reached.

Lattices are settled in blocks of a few rows from the end: distances at the start of a block are the exit costs of the
block before it. That keeps the work linear in the rows, and prices of blocks seen before are reused.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edaflux.llm.frames import discard, stored
from edaflux.operators.ordering import range_parts
from edaflux.operators.ranking import group_key

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = (USER, USER, ASSISTANT, USER)  # the state behind a user or assistant turn, whichever the state asks for
FAULTLESS, BLANK, DUPLICATE, TRUNCATED = range(4)
OTHER = 3  # the class of a role whose initial is none of s, u, a; these are classes 0 to 2
BLOCK_ROWS = 16
CHUNK_ROWS = 64


def arcs(row: int, state: int) -> list[tuple[str, int, bool, int]]:
    """(initial, cost, reads the row, next state) of the edits at ``state`` before a row (fault * 4 + class), by initial."""
    fault, role = divmod(row, 4)
    late = fault == TRUNCATED
    out = [("D", 3, True, state), ("I", 2, False, AFTER[state])]
    if fault not in (BLANK, DUPLICATE):
        to = {0: SYSTEM if state == START else None, 1: USER if state != USER else None, 2: ASSISTANT if state == USER else None}.get(role)
        if to is not None:
            out.append(("K", int(late), True, to))
        out.append(("R", 2 + late, True, AFTER[state]))
    return out


_ARCS = [[arcs(row, state) for state in range(4)] for row in range(16)]
_LEAST = [min(min(cost for label, cost, _, _ in _ARCS[row][s] if label != "I") for s in range(4)) for row in range(16)]
FINAL = (0, 4, 2, 0)  # behind the last row: what completing the last pair costs


@lru_cache(1 << 16)
def block_prices(rows: bytes, exits: tuple[int, int, int, int]) -> tuple[int, ...]:
    """Prices of the nodes (4 * rows read + state) of a block; exact at its start and on all cheapest paths from there."""
    n = len(rows)
    end = 4 * (n + 1)
    price = [0] * end + [0]
    bound = min(exits)
    for i in range(n, -1, -1):
        price[4 * i : 4 * i + 4] = [bound] * 4
        bound += _LEAST[rows[i - 1]] if i else 0
    for origin in range(4):
        path = [origin]
        while path[-1] != end:
            node = path[-1]
            i, state = node >> 2, node & 3
            if i == n:
                best, to = exits[state], end
            else:
                best, to = min((cost + price[4 * (i + reads) + after], 4 * (i + reads) + after) for _, cost, reads, after in _ARCS[rows[i]][state])
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    return tuple(price[:end])


@lru_cache(1 << 16)
def block_trace(rows: bytes, exits: tuple[int, int, int, int], entry: int) -> tuple[str, int]:
    """The least string of edits among the cheapest from ``entry`` through a block, and the state behind it."""
    price, n = block_prices(rows, exits), len(rows)
    good = [False] * (4 * n) + [price[4 * n + s] == exits[s] for s in range(4)]
    tight = [[] for _ in good]
    for i in range(n - 1, -1, -1):
        for s in range(4):
            tight[4 * i + s] = [(label, 4 * (i + reads) + to) for label, cost, reads, to in _ARCS[rows[i]][s] if price[4 * i + s] == cost + price[4 * (i + reads) + to]]
        for _ in range(3):  # inserts lead to nodes of the same row, two in a row at most
            for s in range(4):
                good[4 * i + s] = good[4 * i + s] or any(good[to] for _, to in tight[4 * i + s])
    out, node = [], entry
    while node < 4 * n:
        label, node = next((label, to) for label, to in tight[node] if good[to])
        out.append(label)
    return "".join(out), node & 3


def repaired(chunks: list[bytes]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of a conversation's cheapest repair, and for each chunk of its rows the entry state and string of edits. What
    completes the last pair is a last chunk of its own."""
    blocks = [(k, c[a : a + BLOCK_ROWS]) for k, c in enumerate(chunks) for a in range(0, len(c), BLOCK_ROWS)]
    exits = [FINAL]
    for _, rows in reversed(blocks):
        low = min(exits[-1])  # prices are kept for relative exit costs, which repeat
        prices = block_prices(rows, tuple(e - low for e in exits[-1]))
        exits.append(tuple(p + low for p in prices[:4]))
    exits.reverse()
    out, state = [[None, []] for _ in chunks], START
    for (k, rows), after in zip(blocks, exits[1:], strict=True):
        low = min(after)
        if out[k][0] is None:
            out[k][0] = state
        edits, state = block_trace(rows, tuple(e - low for e in after), state)
        out[k][1].append(edits)
    tail = "I" * (FINAL[state] // 2)
    return exits[0][START], [*((s, "".join(e)) for s, e in out), (state, tail)]


def repaired_lines(turns: list[tuple[str, str]], entry: int, edits: str) -> list[str]:
    """``role:text`` of each turn that the edits leave."""
    out, state, rows = [], entry, iter(turns)
    for e in edits:
        role, text = next(rows) if e != "I" else ("", "")
        if e == "D":
            continue
        if e == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        else:
            state = AFTER[state]
            role = "user" if state == USER else "assistant"
        out.append(f"{role}:{text}")
    return out


def damaged(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, copy, role, text, first_role, first_text) after damage by crc32(``conv_id:turn``) % 20: 0
    drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes its role user. Nulls count as
    one space. The last two columns are the row before damage."""
    blank = F.lit(" ")
    said, spoke = F.coalesce(F.col(text), blank), F.coalesce(F.col(role), blank)
    name = F.concat(F.coalesce(F.col(conversation).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    rows = turns.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), spoke.alias("first_role"), said.alias("first_text"),
        (F.crc32(name.cast("binary")) % 20).alias("_kind"),
    ).where("_kind <> 0")
    kind = F.col("_kind")
    ends = F.translate("first_text", ".!?", "")
    return rows.select(
        "conv_id", "turn", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        F.when(kind == 4, "user").otherwise(F.col("first_role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, ends).otherwise(F.col("first_text")).alias("text"), "first_role", F.md5("first_text").alias("first_text"),
    )


def _chunks(rows: DataFrame) -> DataFrame:
    """Rows (_k, part, chunk, codes, turns): the conversations' rows in order, in chunks of ``CHUNK_ROWS``; ``codes`` has
    a byte for each row (fault * 4 + class of the role).

    Rows are cut by ranges of conversation and turn, so one conversation may fill any number of parts.
    """
    order = ["turn", "first_role", "first_text", "copy"]
    cut = range_parts(rows.withColumn("_k", group_key(["conv_id"])), ["_k", *order], "part", rows.count(), stored)
    place = Window.partitionBy("_k", "part").orderBy(*order)
    placed = stored(cut.withColumns({"at": F.row_number().over(place), "mark": F.struct("role", F.md5("text"))}))
    first = placed.groupBy("_k", "mark").agg(F.min(F.struct("part", "at")).alias("first"))
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(F.struct("part", "at") > F.col("first"), DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    code = F.coalesce(fault, F.lit(FAULTLESS)) * 4 + kind
    chunk = F.floor((F.col("at") - 1) / CHUNK_ROWS).cast("int")
    one = F.struct("at", code.cast("byte").alias("code"), "role", "text")
    seen = placed.join(first, ["_k", "mark"]).groupBy("_k", "part", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    out = stored(seen.select("_k", "part", "chunk", F.col("turns.code").alias("codes"), F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns")))
    discard(cut)
    discard(placed)
    return out


_REPAIR = "_k struct<conv_id:{kind}>, blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits array<struct<part:int,chunk:int,entry:int,edits:string>>"


def _repair(batches):
    legal = np.zeros((4, 4), bool)
    legal[0, 1] = legal[1, 2] = legal[2, 1] = True
    for batch in batches:
        rows = []
        for chunks in batch.column(1).to_pylist():
            codes = [bytes(c["codes"]) for c in chunks]
            row = np.frombuffer(b"".join(codes), np.uint8)
            faults, role = np.bincount(row >> 2, minlength=4).tolist(), row & 3
            cost, edits = repaired(codes)
            places = [*((c["part"], c["chunk"]) for c in chunks), (None, None)]
            rows.append((
                *faults[1:], int((~legal[role[:-1], role[1:]]).sum()), cost, "".join(e for _, e in edits),
                [{"part": p, "chunk": c, "entry": s, "edits": e} for (p, c), (s, e) in zip(places, edits, strict=True)],
            ))
        kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.struct([("part", pa.int32()), ("chunk", pa.int32()), ("entry", pa.int32()), ("edits", pa.string())]))]
        made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["_k", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "edits"])


def _lines(batches):
    for batch in batches:
        texts = []
        for turns, entry, edits in zip(*(batch.column(c).to_pylist() for c in ("turns", "entry", "edits")), strict=True):
            lines = repaired_lines([(t["role"], t["text"]) for t in turns or ()], entry, edits)
            texts.append("\n".join(lines) if lines else None)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_k", "part", "chunk")), pa.array(texts, pa.string())], names=["_k", "part", "chunk", "lines"])


def _digests(batches):
    """SHA-256 of each conversation's lines, over rows sorted by conversation and place."""
    key, state, names = None, None, ["_k", "repaired_sha256"]

    def batch_of(done, kind):
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], names=names)

    kind = None
    for batch in batches:
        done, kind = [], batch.column(0).type
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is None or k != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(b"\n" + text.encode())
        yield batch_of(done, kind)
    if state is not None:
        yield batch_of([(key, state.hexdigest())], kind)


def structure_repairs(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one for each distinct
    conv_id of ``conversations``; ``rows`` as ``damaged`` gives them.

    Rows are ordered by turn (nulls first), then by role and md5 of the text before damage; copies follow each other. A
    null conversation is a conversation. A role without an initial is neither system, user nor assistant. A conversation
    without rows has zeros, an empty audit and the digest of an empty text. No conversations give no rows.

    The texts of a conversation are never gathered; what one task holds of it is a byte a row, as its audit is.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = stored(rows)
    chunks = _chunks(rows)
    light = chunks.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("part", "chunk", "codes"))).alias("chunks"))
    fixed = stored(light.mapInArrow(_repair, _REPAIR.format(kind=kind)))
    steps = fixed.select("_k", F.explode("edits").alias("e")).select("_k", "e.*").where("edits <> ''")
    # The last inserts of a conversation belong to no chunk and come behind all of them.
    joined = steps.where(F.col("part").isNotNull()).join(chunks, ["_k", "part", "chunk"]).select("_k", "part", "chunk", "turns", "entry", "edits")
    behind = steps.where(F.col("part").isNull()).select(
        "_k", F.lit(2**31 - 1).alias("part"), F.lit(0).alias("chunk"), F.lit(None).cast(chunks.schema["turns"].dataType).alias("turns"), "entry", "edits"
    )
    lines = joined.unionByName(behind).mapInArrow(_lines, f"_k struct<conv_id:{kind}>, part int, chunk int, lines string").where("lines IS NOT NULL")
    ordered = lines.repartition("_k").sortWithinPartitions("_k", "part", "chunk").select("_k", "lines")
    digests = ordered.mapInArrow(_digests, f"_k struct<conv_id:{kind}>, repaired_sha256 string")
    turn = F.col("turn")
    gaps = rows.groupBy(group_key(["conv_id"]).alias("_k")).agg((F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)).alias("gaps"))
    every = conversations.select(group_key(["conv_id"]).alias("_k")).distinct()
    out = every.join(fixed.drop("edits"), "_k", "left").join(gaps, "_k", "left").join(digests, "_k", "left")

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long")).alias(name)

    result = stored(out.select(
        F.col("_k")["conv_id"].alias("conv_id"), *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    ))
    for table in (rows, chunks, fixed):
        discard(table)
    return result
