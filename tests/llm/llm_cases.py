"""Small tables with the awkward rows every text operator must take, and plain re-statements of the contracts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, spans int, key string, _key int, mark double"


def words(n: int, seed: int, size: int = 400) -> list[str]:
    rng = random.Random(seed)
    bag = ["".join(rng.choice("abcdefghijklmnopäéß") for _ in range(rng.randint(1, 8))) for _ in range(size)]
    return [rng.choice(bag) for _ in range(n)]


def awkward_texts() -> list[tuple]:
    """(doc_id, text): nulls, empties, white space, ties, repeated rows, copies, shared passages and a very long text."""
    base, passage = words(300, 1), " ".join(words(80, 2))
    near = base.copy()
    near[150] = "changed"
    long = " ".join(words(30_000, 3, 5000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "Two words"), (6, " ".join(base)), (7, " ".join(base)),
        (7, " ".join(base)), (8, " ".join(near)), (9, long), (10, "x " * 700), (None, " ".join(base)), (None, None),
        (11, " ".join(words(40, 4)) + "\n" + passage + "  " + " ".join(words(90, 5))), (12, passage),
        (13, "Head " + passage.upper() + " tail " + passage), (14, "é" * 900), (15, "日本語 text 123 !?"), (16, "<s>▁ ▁</s>\u0000"),
        (17, long[: len(long) // 2] + " end"), (18, "123 456 -- !!"), (-3, " ".join(near[:120])),
    ]


def frame(spark, rows: list[tuple], extra: bool = True):
    """Documents of (doc_id, text), with columns whose names clash with those the operators use."""
    full = [(d, t, "en" if d is None or d % 2 else "de", f"src{(d or 0) % 4}", len(t or ""), "x", 7, "k", 3, 0.5) for d, t in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df if extra else df.select("doc_id", "text")


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def split(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def kept_bytes(docs: list[tuple], width: int) -> list[tuple]:
    seen = defaultdict(int)
    data = [(d, (t or "").encode()) for d, t in docs]
    for _, b in data:
        for i in range(len(b) - width + 1):
            seen[b[i : i + width]] += 1
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = len([s for s in bytes(gone).split(b"\0") if s])
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return sorted(out, key=repr)


def kept_words(docs: list[tuple], width: int) -> list[tuple]:
    first: dict[tuple, int] = {}
    for d, t in docs:
        w = split(t)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for d, t in docs:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            f = first.get(tuple(w[i : i + width]))
            if d is not None and f is not None and f < d:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out, key=repr)


def contamination(docs: list[tuple], items: list[tuple], size: int = 10) -> list[tuple]:
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    holders = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - size + 1) if w and i is not None else 0):
            holders[tuple(w[k : k + size])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(h) for h in holders}:
            for k in range(len(w) - n + 1):
                held = holders.get(tuple(w[k : k + n]))
                if held:
                    hit.update(range(k, k + n))
                    found |= held
        names = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), sha(names), bool(hit)))
    return sorted(out, key=repr)
