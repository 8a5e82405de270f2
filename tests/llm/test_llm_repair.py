"""Structure repair against all cheapest edit strings of small conversations, and a plain re-statement of the whole."""

from __future__ import annotations

import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from llm_cases import rows_of, sha

from edaflux.llm import structure_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copy string, part int, _k string, at int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "k", 2) for r in rows], SCHEMA)


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str, list[str]]:
    """Least (cost, edits) by Dijkstra over whole (cost, edits) strings; rows are (fault, initial)."""
    seen, queue = set(), [(0, "", 0, "", ())]
    while queue:
        cost, edits, i, said, lines = heapq.heappop(queue)
        if (i, said) in seen:
            continue
        seen.add((i, said))
        if i == len(rows) and said in ("", "a"):
            return cost, edits, list(lines)
        after = "a" if said == "u" else "u"
        heapq.heappush(queue, (cost + 2, edits + "I", i, after, (*lines, (after, None))))
        if i == len(rows):
            continue
        fault, initial = rows[i]
        heapq.heappush(queue, (cost + 3, edits + "D", i + 1, said, lines))
        if fault in ("blank", "duplicate"):
            continue
        late = fault == "truncated"
        heapq.heappush(queue, (cost + 2 + late, edits + "R", i + 1, after, (*lines, (after, i))))
        if initial == after or (initial == "s" and not said):
            heapq.heappush(queue, (cost + late, edits + "K", i + 1, initial, (*lines, ("", i))))
    raise AssertionError


def plain(rows: list[tuple]) -> list[tuple]:
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        order = (t is not None, t or 0, role, sha_md5(text))
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            convs[c] += [(*order, k, "user" if kind == 4 else role, text) for k in range(1 + (kind == 3))]
    out = []
    for c, damaged in convs.items():
        damaged.sort()
        seen, faults, turns = set(), [], [r[1] for r in damaged if r[0]]
        for *_, role, text in damaged:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[5][:1] for r in damaged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, edits, lines = cheapest(list(zip(faults, initials, strict=True)))
        said = [f"{ {'u': 'user', 'a': 'assistant'}.get(r) or damaged[i][5]}:{'' if i is None else damaged[i][6]}" for r, i in lines]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, sha("\n".join(said))))
    return sorted(out, key=repr)


def sha_md5(text: str) -> str:
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


def made(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 8, 40])):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]) if rng.random() < 0.4 else ["user", "assistant"][t % 2]
            text = rng.choice(["Yes.", "No!", "what?\n", "cut", " ", "", None, "ä. ", "long " * 20 + "."]) if rng.random() < 0.5 else f"Turn {t}."
            rows.append((c, t if rng.random() < 0.9 else None, role, text))
    return rows


def test_cheapest_edits_of_any_rows():
    rng = random.Random(3)
    names = ["", "blank", "duplicate", "truncated"]
    for _ in range(1500):
        rows = [(rng.choice(names), rng.choice("suax")) for _ in range(rng.randint(0, 9))]
        codes = bytes(names.index(f) * 4 + "suax".index(r) for f, r in rows)
        cost, edits, _ = cheapest(rows)
        for size in (1, 2, 3, 16):
            pieces = [codes[i : i + size] for i in range(0, len(codes), size)]
            got = structure_repair.repaired(pieces)
            assert (got[0], "".join(e for _, e in got[1])) == (cost, edits), rows


def test_prices_contradict_no_arc_and_tight_arcs_lead_on():
    rng = random.Random(4)
    for _ in range(200):
        rows = bytes(rng.randrange(16) for _ in range(rng.randint(1, 12)))
        exits = tuple(rng.randint(0, 5) for _ in range(4))
        exits = tuple(e - min(exits) for e in exits)
        price = structure_repair.block_prices(rows, exits)
        for i, row in enumerate(rows):
            for s in range(4):
                for _, cost, reads, to in structure_repair.arcs(row, s):
                    assert price[4 * i + s] <= cost + price[4 * (i + reads) + to]


def test_long_conversation_is_linear_work():
    rng = random.Random(6)
    codes = bytes(rng.choice([1, 2, 2, 1, 0, 5, 9, 13, 14, 3]) for _ in range(20_000))
    cost, edits = structure_repair.repaired([codes[i : i + 64] for i in range(0, len(codes), 64)])
    assert sum(e != "I" for _, x in edits for e in x) == 20_000 and cost > 0


@pytest.mark.parametrize("chunk", [structure_repair.CHUNK_ROWS, 3])
def test_repairs_of_made_conversations(spark, monkeypatch, chunk):
    monkeypatch.setattr(structure_repair, "CHUNK_ROWS", chunk)
    rows = made(60, chunk) + [(-4, None, None, None), (None, 1, "user", "Lost?"), (None, 2, "assistant", "Yes."), (None, 2, "assistant", "Yes.")]
    df = table(spark, rows)
    assert rows_of(structure_repair.structure_repairs(structure_repair.damaged(df), df)) == plain(rows)


def test_dropped_and_no_conversations(spark):
    gone = [(c, 0, "user", "x") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    df = table(spark, gone)
    assert rows_of(structure_repair.structure_repairs(structure_repair.damaged(df), df)) == plain(gone) and len(gone) > 5
    none = table(spark, [])
    assert structure_repair.structure_repairs(structure_repair.damaged(none), none).count() == 0


def test_one_conversation_in_many_parts(spark, monkeypatch):
    from edaflux.operators import ordering

    monkeypatch.setattr(ordering, "PIECE_ROWS", 50)
    rows = [(7, t, ["user", "assistant"][t % 2], f"Say {t % 90}.") for t in range(700)]
    df = table(spark, rows)
    assert rows_of(structure_repair.structure_repairs(structure_repair.damaged(df), df)) == plain(rows)
