"""Each operator against a plain re-statement of its contract, on awkward rows and on the given tables."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_cases import awkward_texts, contamination, frame, kept_bytes, kept_words, lower, rows_of, sha, split
from pyspark.sql import functions as F

from edaflux.llm import anchors, chat, decontaminate, langid, mixing, simhash, substring, suffix_dedup, token_counts, topk, toxicity
from edaflux.llm.components import components
from edaflux.llm.frames import map_rows


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# Token counts


def library_counts(model, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return [len(sp.encode(t or "")) for t in texts]


def test_token_counts_are_the_librarys(spark, model):
    docs = awkward_texts()
    got = token_counts.token_counts(frame(spark, docs), model, limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(d, len((t or "").encode()), n, n > 100) for (d, t), n in zip(docs, library_counts(model, [t for _, t in docs]), strict=True)]
    assert rows_of(got) == sorted(want, key=repr)
    assert rows_of(token_counts.token_counts(frame(spark, []), model)) == []


def test_chunks_compose_across_any_cut(model, monkeypatch):
    rng = random.Random(4)
    parts = ["a", "the", " ", "   ", "\n", "é", "日本", "😀", "▁", "<0x41>", "</s>", "ing", "tion", "x" * 40, "12", "​", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + ["ab" * 4000, " " * 900]
    with open(model, "rb") as f:
        machine = token_counts.Transducer(f.read())
    want = library_counts(model, texts)
    for chunk in (1, 3, 512):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        assert machine.count(texts).tolist() == want
    monkeypatch.setattr(token_counts, "MAX_STATES", 10)  # forgotten states are compiled again
    assert machine.count(texts).tolist() == want


def test_chunks_without_a_word_start_are_scanned_not_walked(model, monkeypatch):
    """Maps of long unbroken texts: the scan's exits are those of one walk, and few passes over the text find them."""
    rng = random.Random(5)
    unbroken = ["".join(rng.choice("abcdeistnrt") for _ in range(9000)), "a" * 5000, "ha" * 3000 + " end", "日本語中文" * 900, "é" * 2000 + "x" * 3000]
    texts = [t for u in unbroken for t in (u, "two words " + u, u + " " + u[:700])]
    with open(model, "rb") as f:
        machine = token_counts.Transducer(f.read())
    want = library_counts(model, texts)
    passes, tabulate = [], machine.run
    monkeypatch.setattr(machine, "run", lambda *a: passes.append(1) or tabulate(*a))
    for chunk in (7, 64, 512):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        passes.clear()
        assert machine.count(texts).tolist() == want
        assert len(passes) < 40  # the longest text has 1,286 chunks of 7


def test_maps_compose_to_the_walks_states():
    rng = np.random.default_rng(6)
    n, states = 400, 5
    constant = rng.random(n) < 0.1
    constant[0] = True
    table = rng.integers(0, states, (n, states))
    want = np.where(constant, rng.integers(0, states, n), -1)
    got = want.copy()
    rows = np.array([c << 32 | s for c in range(n) for s in range(states)])
    for c in np.flatnonzero(~constant):
        want[c] = table[c, want[c - 1]]
    token_counts.compose(rows, table.ravel(), constant, got)
    assert (got == want).all()


# Chat


def test_chat_round_trip_and_mask(spark):
    rng = random.Random(2)
    odd = ["<|im_end|>", "<|", "\\", "<\\|", "\\\\<|", "a\nb", "", "<\\n|", "é😀", "<|im_start|>assistant\nx<|im_end|>\n"]
    rows, want = [], {}
    for c in range(60):
        turns = [
            (rng.choice(["user", "assistant", "system", "a\nb", "<|x"]), "".join(rng.choice(odd) for _ in range(rng.randint(0, 5))))
            for _ in range(rng.randint(1, 7))
        ]
        want[c] = turns
        rows += [(c, k, r, t, 1) for k, (r, t) in enumerate(turns)]
    rows += [(100, 0, None, None, 1), (100, None, "user", "first", 1), (None, 0, "assistant", "no id", 1), (None, 0, "assistant", "no id", 1)]
    want[100] = [("user", "first"), ("", "")]
    want[None] = [("assistant", "no id")] * 2
    rng.shuffle(rows)
    examples = chat.chat_examples(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted int"))
    per = {}
    for r in examples.collect():
        per.setdefault(r["conv_id"], []).append(r)
        if r["target"] is not None:
            turns = want[r["conv_id"]]
            body = r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_length"]]
            assert body.replace("<\\|", "<|").replace("\\\\", "\\") == turns[r["target"]][1]
            assert r["formatted"].endswith(body + chat.END + "\n") and r["formatted"].count(chat.START) == r["target"] + 1
    assert all(sum(e["target"] is not None for e in per[c]) == sum(r == "assistant" for r, _ in t) for c, t in want.items())
    got = {r[0]: tuple(r)[1:] for r in chat.conversation_digests(examples).collect()}
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        length = sum(len(e["formatted"]) for e in per[c])
        assert got[c] == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), length)
    assert chat.chat_examples(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# SimHash


def fingerprint(text: str | None, size: int = 3) -> int:
    w = split(lower(text or ""))
    parts = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest_reachable(prints: list[int], ids: list, radius: int = 2) -> list:
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius).tolist():
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash_of_awkward_rows(spark):
    docs = awkward_texts()
    prints = [fingerprint(t) for _, t in docs]
    least = smallest_reachable(prints, [d for d, _ in docs])
    want = [(d, f"{p:016x}", c) for (d, _), p, c in zip(docs, prints, least, strict=True)]
    assert rows_of(simhash.near_duplicates(frame(spark, docs))) == sorted(want, key=repr)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("cell", [256, 2])
def test_links_of_crowded_and_small_cells(spark, monkeypatch, cell):
    """Dense clusters, with every cell too large for pairs in one of the two runs."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1, 1 << 63}
    for _ in range(400):
        p = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.choice([1, 2, 3])):
            p ^= 1 << b
        prints.add(p)
    signed = [p - (p >> 63 << 64) for p in sorted(prints)]
    df = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    links = {(r[0], r[1]) for r in simhash.fingerprint_links(df).collect()}
    mask = (1 << 64) - 1
    assert len(links) < (len(signed) * 12 if cell == 256 else len(signed) * 65)
    roots = {r[0]: r[1] for r in components(spark.createDataFrame(list(links), "u bigint, v bigint")).collect()}
    got = [roots.get(s, s) for s in signed]
    assert got == smallest_reachable([s & mask for s in signed], signed)


def test_embedding_bounds_the_distance(spark):
    rng = random.Random(7)
    pairs = [(rng.getrandbits(64) - (1 << 63), rng.getrandbits(64) - (1 << 63)) for _ in range(200)]
    for (a, b), r in zip(pairs, spark.createDataFrame(pairs, "a bigint, b bigint").select(simhash.segment_counts(F.col("a")), simhash.segment_counts(F.col("b")), "a", "b").collect(), strict=True):
        x, y = ([(v >> 2 * s) & 3 for s in range(32)] for v in r[:2])
        assert x == [((r[2] >> 2 * s) & 3).bit_count() for s in range(32)]
        assert sum(abs(p - q) for p, q in zip(x, y, strict=True)) <= (((r[2] ^ r[3]) & ((1 << 64) - 1)).bit_count())


def test_long_chain_is_one_component(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)]
    random.Random(3).shuffle(edges)
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


def test_one_row_of_each_group(spark):
    docs = awkward_texts()
    kept = simhash.one_of_each(frame(spark, docs))
    assert kept.columns == frame(spark, docs).columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {c for c in smallest_reachable([fingerprint(t) for _, t in docs], [d for d, _ in docs])}
    assert sorted(ids, key=repr) == sorted(want, key=repr)


# Repeated bytes and words


@pytest.mark.parametrize("bucket,heavy", [(anchors.BUCKET, anchors.HEAVY), (anchors.BUCKET, 20), (0, 1)])
@pytest.mark.parametrize("width", [400, 40])
def test_repeated_bytes(spark, monkeypatch, bucket, heavy, width):
    monkeypatch.setattr(anchors, "BUCKET", bucket)  # 0: every bucket is split by window
    monkeypatch.setattr(anchors, "HEAVY", heavy)  # all, some and no keys are broadcast
    docs = awkward_texts()
    assert rows_of(suffix_dedup.repeated_bytes(frame(spark, docs), width)) == kept_bytes(docs, width)


@pytest.mark.parametrize("bucket,heavy", [(anchors.BUCKET, anchors.HEAVY), (anchors.BUCKET, 20), (0, 1)])
@pytest.mark.parametrize("width", [50, 9])
def test_repeated_words(spark, monkeypatch, bucket, heavy, width):
    monkeypatch.setattr(anchors, "BUCKET", bucket)
    monkeypatch.setattr(anchors, "HEAVY", heavy)
    docs = awkward_texts()
    assert rows_of(substring.repeated_words(frame(spark, docs), width)) == kept_words(docs, width)


def test_no_documents_no_spans(spark):
    assert suffix_dedup.repeated_bytes(frame(spark, [])).count() == 0 and substring.repeated_words(frame(spark, [])).count() == 0


def test_given_documents_lose_what_repeats(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows_of(suffix_dedup.repeated_bytes(df)) == kept_bytes(docs, 400)
    assert rows_of(substring.repeated_words(df)) == kept_words(docs, 50)


def test_shared_buckets_of_any_width():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 2, 3000).astype(np.uint8)
    room = np.concatenate([np.arange(1000, 0, -1)] * 3)
    for width in (1, 5, 8, 11, 16, 29):
        bucket = suffix_dedup.shared_buckets(text, room, width)
        seen: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(room >= width).tolist():
            seen.setdefault(text[i : i + width].tobytes(), []).append(i)
        want = {i: g[0] for g in seen.values() if len(g) > 1 for i in g}
        assert set(np.flatnonzero(bucket >= 0).tolist()) == set(want)
        pairs = {(want[i], int(bucket[i])) for i in want}
        assert len(pairs) == len({p for p, _ in pairs}) == len({b for _, b in pairs})


def test_parse_finds_repetitions_across_factor_ends():
    index, lines = {}, []
    for first, line in ((1, list("abcdefgh")), (2, list("ghijklmn"))):
        for k in range(len(line) - 2):
            index.setdefault("".join(line[k : k + 3]).encode(), (first, len(lines), k))
        lines.append([x.encode() for x in line])
    text = "xabcdefghijkz"
    windows = [text[k : k + 3].encode() for k in range(len(text) - 2)]
    hit = substring.parse([x.encode() for x in text], windows, index, lines, 5, 3)
    assert hit.tolist() == [w in index for w in windows]


def test_cut_text_keeps_white_space(spark):
    passage = " ".join(f"w{k}" for k in range(50))
    docs = frame(spark, [(1, f"a  b\n{passage}"), (2, f"c\t\td {passage}  e\n"), (3, passage), (4, None)])
    got = {r["doc_id"]: r["text"] for r in substring.deduplicated(docs).collect()}
    assert got == {1: f"a  b\n{passage}", 2: "c\t\td   e\n", 3: "", 4: None}
    assert substring.deduplicated(docs).columns == docs.columns


# Decontamination


@pytest.mark.parametrize("limit", [decontaminate.PART_BYTES, 700])
def test_contamination(spark, limit, monkeypatch):
    docs = awkward_texts()
    items = [(i, " ".join(split(docs[k][1])[a:b])) for i, (k, a, b) in enumerate([(5, 0, 30), (8, 7, 19), (9, 100, 140), (13, 40, 90), (13, 41, 52)])]
    items += [(7, "Two, WORDS!"), (8, None), (9, ""), (None, "word"), (70, "word"), (70, "word"), (10, "日本語 text"), (11, "never seen here")]
    df = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, found int")
    monkeypatch.setattr(decontaminate, "PART_BYTES", limit)
    parts = list(decontaminate.benchmark_parts(df, limit=limit))
    assert (len(parts) > 1) == (limit == 700)
    monkeypatch.setattr(decontaminate, "benchmark_parts", lambda *a, **k: iter(parts))
    assert rows_of(decontaminate.contamination(frame(spark, docs), df)) == contamination(docs, items)
    clean = decontaminate.decontaminated(frame(spark, docs), df)
    again = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert clean.columns == frame(spark, docs).columns and len(again) == len(docs)
    untouched = {repr((d, t)) for (d, t) in docs if not contamination([(d, t)], items)[0][5]}
    assert untouched <= {repr(r) for r in again}


def test_empty_benchmark_finds_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert rows_of(decontaminate.contamination(frame(spark, awkward_texts()), none)) == contamination(awkward_texts(), [])
    assert decontaminate.contamination(frame(spark, []), none).count() == 0


def test_index_counts_and_locates():
    rng = np.random.default_rng(3)
    symbols = rng.integers(1, 4, 500)
    symbols[[0, 99, 250, 499]] = 0
    index = decontaminate.FmIndex(symbols)
    phrases = rng.integers(1, 4, (50, 5))
    lengths = rng.integers(1, 6, 50)
    low, high = index.search(phrases, lengths)
    for p, n, a, b in zip(phrases, lengths, low, high, strict=True):
        want = [i for i in range(len(symbols) - n + 1) if (symbols[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# Toxicity and languages


def toxic_rows(n: int = 600):
    rng = random.Random(5)
    bad = ["stupidword", "awfulword", "vileword", "nastyword"]
    rows, labels = [], []
    for d in range(n):
        text, toxic = words_text(d), d % 8 == 0
        if toxic:
            text += " " + " ".join(rng.sample(bad, 2)).title() + "!"
        rows.append((d, text))
        if d % 2 == 0:
            labels.append((d, int(toxic), d))
    return rows, labels


def words_text(seed: int) -> str:
    from llm_cases import words

    return " ".join(words(60, seed % 97, 300)) + f" tail{seed}"


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rows, labels = toxic_rows()
    extra = [(None, "null key"), (9001, None), (9002, ""), (3, "repeated key")]
    df = frame(spark, rows + extra)
    marks = spark.createDataFrame(labels + [(None, 1, 0), (77, None, 0), (8, 1, 1)], "doc_id bigint, toxic int, quality bigint")
    got = toxicity.toxicity(df, marks)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    seen = got.collect()
    assert len(seen) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in seen)
    by = {r["doc_id"]: r for r in seen}
    held = [d for d, _ in rows if by[d]["held_out"]]
    assert 60 < len(held) < 200
    right = [by[d]["predicted"] == (d % 8 == 0) for d in held]
    assert sum(right) / len(right) > 0.97
    assert by[9001]["score"] == by[9002]["score"] < 0.5
    assert rows_of(got) == rows_of(toxicity.toxicity(df.repartition(7), marks))  # the same model whatever the partitions
    clean = toxicity.without_toxic(df, marks)
    assert clean.columns == df.columns and clean.count() == sum(r["predicted"] == 0 for r in seen)


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(frame(spark, awkward_texts()), none).collect()} == {0}
    assert toxicity.toxicity(frame(spark, []), none).count() == 0


def test_given_labels_are_learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert sum(r["toxic"] == r["predicted"] for r in seen) / len(seen) > 0.9
    assert not any(r["predicted"] and not r["toxic"] for r in seen)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and 250 < len(held) < 420
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_awkward_rows(spark):
    docs = awkward_texts()
    got = langid.languages(frame(spark, docs))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(docs)
    for r in got.collect():
        letters = any(c.isalpha() for d, t in docs if d == r["doc_id"] for c in t or "")
        if r["doc_id"] is not None:
            assert (r["lang_pred"] in ("en", "de")) == letters and (letters or r["score"] == 0)
    unknown = frame(spark, docs).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.languages(unknown).collect()} == {"und"}
    assert langid.languages(frame(spark, [])).count() == 0


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = langid.train([b"abc def " * 40, "äöü ßä ".encode() * 40], ["x", "y"], epochs=1)
    x, y = rng.integers(0, 60, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        z = net.window_scores(x, [[r.astype(np.float64) for r in t] for t in net.tables()]).astype(float)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(4), y]))

    grads = langid._gradients(net, x, y)
    for p, g in zip([net.dense, net.offset], [grads[-2], grads[-1]], strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[at] += 1e-2
        up = loss()
        p[at] -= 2e-2
        down = loss()
        p[at] += 1e-2
        assert abs((up - down) / 2e-2 - g[at]) < 1e-2 * max(1, abs(g[at]))


# Search


@pytest.mark.parametrize("sizes", [(topk.RANGE, topk.CHUNK, topk.BLOCK), (16, 4, 4)])
def test_top_k_is_exact(spark, monkeypatch, sizes):
    for name, value in zip(("RANGE", "CHUNK", "BLOCK"), sizes, strict=True):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(0, 0.1, 6)], 1) for i in range(300)]
    rows += [(i, [0.25] * 6, 1) for i in range(300, 340)]  # ties
    rows += [(400, None, 1), (420, [0.1, None], 1), (440, [float("nan")] * 6, 1), (460, [float("inf")] * 6, 1), (480, [], 1)]
    rows += [(500, [1.0, 2.0], 1), (None, [9.0] * 6, 1), (520, [-1e9] * 6, 1), (540, [1e9] * 6, 1)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int"), F.col("vec_id") % 20 == 0, k=20)
    usable = {i: [int(np.floor(64 * x)) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in [i for i in usable if i % 20 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(usable[q], v, strict=False)), i) for i, v in usable.items() if i != q)
        want += [(q, r + 1, i, max(-(1 << 63) + 1, min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(scores[:20])]
    assert rows_of(got) == sorted(want, key=repr)


def test_blocks_below_the_threshold_are_skipped():
    rng = np.random.default_rng(2)
    vectors = np.repeat(rng.integers(-50, 50, (64, 8)), 64, axis=0) + rng.integers(0, 2, (64 * 64, 8))
    ids = np.arange(len(vectors))
    best = topk.Best(np.array([-1]), 20)
    assert topk.search_range(best, vectors[5:6], ids, vectors) < 20
    score = vectors @ vectors[5]
    assert sorted(zip(-best.score, best.vec, strict=True)) == sorted(zip(-score, ids, strict=True))[:20]


def test_no_vectors_and_too_few(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], kind), F.lit(True)).count() == 0
    got = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], kind), F.col("vec_id") == 0)
    assert rows_of(got) == [(0, 1, 1, 64 * 128)]


# Mixing


def levels():
    return {"source": F.col("source"), "lang": F.col("lang")}


def filled(budget, nodes):
    """Water-filling, step by step: {name: (weight, supply)} to shares."""
    share, open_ = dict.fromkeys(nodes, 0.0), {n for n, (w, s) in nodes.items() if w > 0}
    while budget > 1e-9 and open_:
        total = sum(nodes[n][0] for n in open_)
        part = {n: min(budget * nodes[n][0] / total, nodes[n][1] - share[n]) for n in open_}
        share = {n: share[n] + part.get(n, 0) for n in nodes}
        budget -= sum(part.values())
        open_ = {n for n in open_ if nodes[n][1] - share[n] > 1e-9}
    return share


def test_shortages_go_to_siblings_first(spark):
    rng = random.Random(8)
    leaves = [(f"d{d}", f"l{k}", float(rng.choice([0, 5, 50, 500, 5000]))) for d in range(4) for k in range(5)] + [(None, "l0", 70.0)]
    df = spark.createDataFrame(leaves, "d string, l string, tokens double")
    weights = {"d": {"d0": 3.0, "d1": 0.0}, "l": {"l1": 2.5}}
    for budget in (0.0, 100.0, 3000.0, 1e9):
        got = {(r["d"], r["l"]): r["budget"] for r in mixing.leaf_budgets(df, ["d", "l"], budget, weights, 2).collect()}
        tops = {d: (weights["d"].get(d, 1.0), 2 * sum(t for e, _, t in leaves if e == d)) for d in {x[0] for x in leaves}}
        for d, share in filled(budget, tops).items():
            inner = filled(share, {k: (weights["l"].get(k, 1.0), 2 * t) for e, k, t in leaves if e == d})
            for k, v in inner.items():
                assert got[d, k] == pytest.approx(v, abs=1e-6), (budget, d, k)


def test_mixture_spends_each_budget_on_seeded_epochs(spark):
    docs = [(d, " ".join(f"w{k}" for k in range(d % 7 + 1))) for d in range(200)] + awkward_texts()
    df = frame(spark, docs)
    got = mixing.mixed(df, levels(), mixing.word_count(F.col("text")), {"source": {"src0": 6.0}}, 0.9, 3, keep=df.columns)
    rows = got.collect()
    assert got.columns[:5] == ["doc_id", "source", "lang", "epoch", "n_tokens"] and {"text", "spans", "key"} <= set(got.columns)
    tokens = sum(len(split(t)) for _, t in docs)
    assert sum(r["n_tokens"] for r in rows) <= 0.9 * tokens and {r["epoch"] for r in rows} <= {0, 1, 2}
    # Each epoch but a leaf's last holds all its documents, and a prefix of the seeded order is in the last.
    import hashlib

    place = lambda e, d: hashlib.md5(f"17:{e}:{'' if d is None else d}".encode()).hexdigest()
    for leaf in {(r["source"], r["lang"]) for r in rows}:
        own = [d for d, _ in docs if (f"src{(d or 0) % 4}", "en" if d is None or d % 2 else "de") == leaf]
        by = {}
        for r in rows:
            if (r["source"], r["lang"]) == leaf:
                by.setdefault(r["epoch"], []).append(r["doc_id"])
        for e, ids in by.items():
            order = sorted(own, key=lambda d: place(e, d))
            assert sorted(ids, key=repr) == sorted(order[: len(ids)], key=repr)
            if e < max(by):
                assert len(ids) == len(own)
    assert mixing.mixed(frame(spark, []), levels(), mixing.word_count(F.col("text")), {}).count() == 0


def held_at_most(run) -> float:
    """MB that Python and numpy hold at most while ``run`` goes on, besides what was there."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def one_batch():
    """A stand-in for documents, on which operators that map batches give their function itself, and a batch for it."""

    class Docs:
        def mapInArrow(self, function, schema):
            return function

    texts = [" ".join(str((i * 7919 + k * k) % 9973) for k in range(400)) for i in range(3000)]
    ids = pa.array(range(len(texts)), pa.int64())
    return Docs(), pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["key", "mark", "text"])


@pytest.mark.parametrize("units,width,gram", [(anchors.Bytes, 400, 32), (anchors.Words, 50, 8)])
def test_runs_of_a_batch_take_little_memory(spark, units, width, gram):
    docs, batch = one_batch()
    work = anchors.document_runs(docs, units, width, gram, "long")
    assert held_at_most(lambda: [None for _ in work(iter([batch]))]) < 75


def test_one_slice_of_a_batch_is_held_at_a_time(spark):
    docs, batch = one_batch()
    made = []
    work = map_rows(docs, lambda rows: made.append(len(rows["text"])) or {"key": rows["key"]}, "key long", binary=True, limit=100_000)
    assert held_at_most(lambda: [None for _ in work(iter([batch]))]) < 2
    assert sum(made) == batch.num_rows and len(made) > 10


def test_the_largest_bucket_compared_whole_takes_little_memory():
    rng = np.random.default_rng(1)
    rows, base = [], rng.integers(97, 123, 760, dtype=np.uint8)
    for i in range(anchors.BUCKET):
        line = base.copy()
        line[rng.integers(0, 760, 3)] = rng.integers(97, 123, 3, dtype=np.uint8)
        rows.append((1, i, i, 1, line.tobytes()))
    found = []
    assert held_at_most(lambda: found.extend(suffix_dedup.refine_bytes(400)(rows))) < 200
    counts = Counter(hash(r[4][k : k + 400]) for r in rows for k in range(361))
    for r, ranges in list(zip(rows, found, strict=True))[::500]:
        hit = {k for a, b in ranges for k in range(a, b + 1)}
        assert hit == {k for k in range(361) if counts[hash(r[4][k : k + 400])] > 1}
