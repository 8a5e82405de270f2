"""Prefix tries against a plain re-statement, with shards of any size."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest
from llm_cases import rows_of, sha

from edaflux.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, ids string, sizes int, n int, key string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "k") for r in rows], SCHEMA)


def rebuilt(rows: list[tuple]) -> dict[int, list]:
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], x[2], __import__("hashlib").md5(x[3].encode()).hexdigest()))] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain_nodes(convs: dict[int, list]) -> list[tuple]:
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below)
        saved = sum((len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(path))
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(kids), leaves, saved, sha(ends)))
    return sorted(out, key=repr)


def awkward() -> list[tuple]:
    rng = random.Random(5)
    rows = [(1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", ""), (2, 5, "user", "é😀"), (None, 1, "user", "lost"), (-7, 1, "user", "x"), (-5, 0, "system", "s")]
    for c in range(40, 75):  # many equal beginnings, copies, and one long conversation
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a", "bb", "ccc\n"])) for t in range(rng.randint(1, 12))]
    for c in range(100, 130):
        rows += [(c, t, "user", f"same {t}") for t in range(4)]
    rows += [(200, t, "user", f"long {t}") for t in range(300)] + [(201, t, "user", f"long {t}") for t in range(200)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("turns", "rows"), [(100_000, 20_000), (1, 1), (30, 7), (400, 3)])
def test_trie_of_awkward_rows(spark, turns, rows):
    data = awkward()
    lists = prefix_trie.with_shared_heads(prefix_trie.conversation_lists(table(spark, data)))
    got = prefix_trie.trie_nodes(lists, turns, rows)
    assert rows_of(got) == plain_nodes(rebuilt(data))


def test_turnless_conversations_and_no_conversations(spark):
    rows = [(c, 0, "user", "only") for c in range(1, 20) if c % 5]
    data = rebuilt(rows)
    assert any(not t for t in data.values())
    lists = prefix_trie.with_shared_heads(prefix_trie.conversation_lists(table(spark, rows)))
    assert rows_of(prefix_trie.trie_nodes(lists)) == plain_nodes(data)
    none = prefix_trie.with_shared_heads(prefix_trie.conversation_lists(table(spark, [])))
    assert prefix_trie.trie_nodes(none).count() == 0


def test_dictionary_without_common_turns(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HOT_TURNS", 0)  # no turn is hot
    data = awkward()
    lists = prefix_trie.with_shared_heads(prefix_trie.conversation_lists(table(spark, data)))
    assert rows_of(prefix_trie.trie_nodes(lists, 50, 5)) == plain_nodes(rebuilt(data))


def test_medians_balance_the_tree():
    assert sorted(prefix_trie.medians(1000)) == list(range(1000))
    tree = prefix_trie.Tree()
    for k in prefix_trie.medians(1000):
        tree.insert([k, 7], [1, 1], 1, k)

    def height(at):
        return 0 if at < 0 else 1 + max(height(tree.low[at]), height(tree.high[at]))

    assert height(tree.root) == 10
