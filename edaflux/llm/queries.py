"""Registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from edaflux.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


CONTROL_TURN = "<|im_end|><|im_start|>assistant ok"

OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n|'))
      + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) OVER w AS upto
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op5_chat_format", OP5_SQL)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from edaflux.llm.chat import chat_examples, conversation_digests

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TURN).alias("text"),
    )
    return conversation_digests(chat_examples(turns.unionByName(control)))


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edaflux.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, list_slice(words, k, k + 9) AS win, least(len(words), 10) AS size
  FROM b, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS t(k) WHERE len(words) > 0
), sizes AS (SELECT DISTINCT size FROM wins), grams AS (
  SELECT doc_id, k, size, list_slice(words, k, k + size - 1) AS win FROM w, sizes, unnest(range(1, len(words) - size + 2)) AS t(k)
), hits AS (
  SELECT g.doc_id, g.k, g.size, i.item_id FROM grams g JOIN wins i ON g.win = i.win AND g.size = i.size
), n_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM hits, unnest(range(k, k + size)) AS t(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.names, '')) AS items_sha256, n_hit.n IS NOT NULL AS contaminated
FROM w LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op6_benchmark_decontamination", OP6_SQL)
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edaflux.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


@query("op8_suffix_array_dedup")
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edaflux.llm.suffix_dedup import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents"), width=400)


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), wins AS (
  SELECT doc_id, k, md5(array_to_string(list_slice(words, k, k + 49), ' ')) AS win
  FROM w, unnest(range(1, len(words) - 48)) AS t(k)
), firsts AS (SELECT win, min(doc_id) AS first FROM wins GROUP BY win),
hits AS (SELECT doc_id, k FROM wins JOIN firsts USING (win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM hits, unnest(range(k, k + 50)) AS t(p)),
kept AS (
  SELECT w.doc_id, len(words) AS n, count(g.p) AS removed,
    coalesce(string_agg(words[i], ' ' ORDER BY i) FILTER (g.p IS NULL AND i IS NOT NULL), '') AS text
  FROM w LEFT JOIN LATERAL (SELECT unnest(range(1, len(w.words) + 1)) AS i) ON true
  LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = i GROUP BY w.doc_id, len(words)
)
SELECT doc_id, n::BIGINT AS n_words, removed::BIGINT AS n_removed, sha256(text) AS kept_sha256 FROM kept
"""


@query("op10_substring_dedup", OP10_SQL)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edaflux.llm.substring import repeated_words

    return repeated_words(table(spark, sf_dir, "documents"), width=50)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edaflux.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edaflux.llm.langid import languages

    return languages(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""


@query("op3_exact_top_k", OP3_SQL)
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from edaflux.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


DOMAINS = {"web": "^src[0-4]$", "news": "^src[5-9]$"}
MIX_WEIGHTS = {"domain": {"web": 0.4, "news": 0.25, "books": 0.35}, "lang": {"en": 3.0}}
MIX_SEED = 17
MIX_EPOCHS = 4


def _level_sql(name: str, before: str, parents: list[str], child: str, weight: str) -> str:
    """One level of the budget: the children of each parent filled up to one level."""
    keys = ", ".join([*parents, child])
    by = f"PARTITION BY {', '.join(parents)}" if parents else ""
    same = " AND ".join(f"l.{c} IS NOT DISTINCT FROM s.{c}" for c in [*parents, child])
    return f"""
{name}_n AS (
  SELECT {keys}, budget, sum(tokens * {MIX_EPOCHS}.0::DOUBLE) AS supply, {weight} AS weight FROM {before} GROUP BY {keys}, budget
), {name}_r AS (SELECT *, CASE WHEN weight > 0 THEN supply / weight END AS ratio FROM {name}_n
), {name}_l AS (
  SELECT *, (budget - coalesce(sum(supply) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM {name}_r WINDOW w AS ({by} ORDER BY ratio NULLS LAST, {child} NULLS FIRST)
), {name}_s AS (
  SELECT {keys}, CASE WHEN weight > 0 THEN greatest(least(supply, coalesce(
    (max(CASE WHEN ratio >= level THEN level END) OVER ({by})) * weight, supply)), 0) ELSE 0 END AS budget FROM {name}_l
), {name} AS (SELECT l.* EXCLUDE (budget), s.budget FROM {before} l JOIN {name}_s s ON {same})"""


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-4]$') THEN 'web' WHEN regexp_matches(source, '^src[5-9]$') THEN 'news'
    ELSE 'books' END AS domain, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens, (SELECT sum(n_tokens)::DOUBLE FROM d) AS budget FROM d GROUP BY ALL
), {_level_sql("a", "leaves", [], "domain", "CASE domain WHEN 'web' THEN 0.4 WHEN 'news' THEN 0.25 WHEN 'books' THEN 0.35 ELSE 1 END::DOUBLE")},
{_level_sql("b", "a", ["domain"], "lang", "CASE lang WHEN 'en' THEN 3 ELSE 1 END::DOUBLE")},
{_level_sql("c", "b", ["domain", "lang"], "source", "1::DOUBLE")},
spent AS (SELECT *, least(floor(budget + 1e-6), tokens * {MIX_EPOCHS}) AS spent FROM c),
plan AS (
  SELECT *, CASE WHEN tokens > 0 THEN floor(spent / tokens) ELSE 0 END::INTEGER AS whole,
    spent - CASE WHEN tokens > 0 THEN floor(spent / tokens) ELSE 0 END * tokens AS remains FROM spent
), placed AS (
  SELECT d.*, p.whole, p.remains, md5(concat_ws(':', '{MIX_SEED}', p.whole::VARCHAR, coalesce(d.doc_id::VARCHAR, ''))) AS place
  FROM d JOIN plan p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source
), run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS upto FROM placed)
SELECT doc_id, domain, lang, source, epoch::INTEGER AS epoch, n_tokens FROM run, unnest(range(0, {MIX_EPOCHS})) AS t(epoch)
WHERE epoch < whole OR (epoch = whole AND upto <= remains)
"""


def mixture(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    from pyspark.sql import functions as F

    from edaflux.llm.mixing import mixed, word_count

    domain = F.lit("books")
    for name, pattern in DOMAINS.items():
        domain = F.when(F.col("source").rlike(pattern), name).otherwise(domain)
    levels = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    return mixed(docs, levels, word_count(F.col("text")), MIX_WEIGHTS, 1.0, MIX_EPOCHS, MIX_SEED, keep=keep)


@query("op2_source_mixing", OP2_SQL)
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


@query("op11_html_extraction")
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edaflux.llm.page_text import page_texts

    return page_texts(table(spark, sf_dir, "pages"))


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string: eight steps a byte, which is added at the first of them."""
    steps = f"flatten(list_transform(list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))), lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))"
    return (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform({steps}, lambda b: b::BIGINT)), lambda r, b: "
        "xor(xor(r, b) >> 1, 3988292384::BIGINT * (xor(r, b) & 1))), 4294967295::BIGINT)"
    )


OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS part, k, role, text FROM c JOIN t ON t.conv_id = base AND k <= h
  UNION ALL SELECT c.conv_id, 1, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND k > h
), p AS (
  SELECT conv_id, text, row_number() OVER w AS depth, string_agg(md5(length(role) || ':' || role || text), '') OVER (w ROWS UNBOUNDED PRECEDING) AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)
), f AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM (SELECT conv_id, depth, path, text FROM p UNION ALL SELECT conv_id, 0, '', '' FROM c)
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, max(octet_length(encode(text))) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM f GROUP BY path, depth
), kids AS (SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), sums AS (
  SELECT substr(n.path, 1, 32 * d) AS path, sum((n - 1) * bytes)::BIGINT AS saved_tokens, count(*) FILTER (k.path IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN kids k ON n.path = k.path, unnest(range(0, n.depth + 1)) AS u(d) GROUP BY 1
)
SELECT a.conv_id, a.depth::BIGINT AS depth, b.conv_id AS parent_conv_id, a.n AS n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, saved_tokens, a.ends_sha256
FROM nodes a JOIN sums USING (path) LEFT JOIN kids USING (path)
LEFT JOIN nodes b ON a.depth > 0 AND b.path = substr(a.path, 1, 32 * (a.depth - 1))
"""


@query("op12_conversation_prefix_trie", OP12_SQL)
def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edaflux.llm.prefix_trie import conversation_lists, trie_nodes, with_shared_heads

    lists = conversation_lists(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return trie_nodes(with_shared_heads(lists))


_S = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _add(value: str, cost: str, label: str) -> str:
    return f"(lpad((substr({value}, 1, 9)::INTEGER + {cost})::VARCHAR, 9, '0') || substr({value}, 10) || '{label}')"


def _repair_step() -> str:
    """States as strings of cost and edits, so that the least string is the cheapest and then the least of edits."""
    u = f"least(b.v2, {_add('b.v0', '2', 'I')}, {_add('b.v1', '2', 'I')}, {_add('b.v3', '2', 'I')})"
    a = f"least(b.v3, {_add('b.v2', '2', 'I')}, {_add('b.v0', '4', 'II')}, {_add('b.v1', '4', 'II')})"
    closed = f"SELECT b.conv_id, b.i, b.v0, b.v1, {u} AS v2, {a} AS v3 FROM b"
    free = "fault NOT IN (1, 2)"
    late = "(fault = 3)::INTEGER"

    def keep(role: str, value: str) -> str:
        return f"CASE WHEN {free} AND initial = '{role}' THEN {_add(value, late, 'K')} END"

    def turn(value: str) -> str:
        return f"CASE WHEN {free} THEN {_add(value, f'(2 + {late})', 'R')} END"

    new = [
        _add("c.v0", "3", "D"),
        f"least({_add('c.v1', '3', 'D')}, {keep('s', 'c.v0')})",
        f"least({_add('c.v2', '3', 'D')}, " + ", ".join(f"{keep('u', v)}, {turn(v)}" for v in ("c.v0", "c.v1", "c.v3")) + ")",
        f"least({_add('c.v3', '3', 'D')}, {keep('a', 'c.v2')}, {turn('c.v2')})",
    ]
    # The last row is a mark behind the conversation: only inserts come before it.
    ends = ["c.v0", "c.v1", "c.v2", "c.v3"]
    states = ", ".join(f"CASE WHEN f.fault IS NULL THEN {e} ELSE {n} END AS v{k}" for k, (e, n) in enumerate(zip(ends, new, strict=True)))
    return f"SELECT f.conv_id, f.i + 1 AS i, {states} FROM ({closed}) c JOIN f ON f.k = c.conv_id AND f.i = c.i"


OP13_SQL = f"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0,
    {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations
), d AS (
  SELECT conv_id, turn, copy, role0, text0, CASE kind WHEN 4 THEN 'user' ELSE role0 END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text
  FROM r, unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(copy)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, md5(text0), copy) AS i, rtrim(text, {_S}) AS bare FROM d
), g AS (
  SELECT conv_id, turn, i, role, text, substr(role, 1, 1) AS initial, CASE WHEN bare = '' THEN 1
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM g GROUP BY conv_id
), f AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, '') AS k, i, initial, fault FROM g
  UNION ALL SELECT conv_id, coalesce(conv_id::VARCHAR, ''), n + 1, NULL, NULL FROM s
), b AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS conv_id, 1::BIGINT AS i, '000000000' AS v0, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, NULL::VARCHAR AS v3 FROM s
  UNION ALL SELECT coalesce(conv_id::VARCHAR, ''), i, v0, v1, v2, v3 FROM ({_repair_step()})
), best AS (
  SELECT s.*, substr(v, 1, 9)::BIGINT AS cost, substr(v, 10) AS audit
  FROM s JOIN (SELECT conv_id AS k, i, least(v0, v3) AS v FROM b) x ON x.k = coalesce(s.conv_id::VARCHAR, '') AND x.i = s.n + 2
), edits AS (
  SELECT conv_id, p, substr(audit, p, 1) AS e, p - length(regexp_replace(substr(audit, 1, p), '[^I]', '', 'g')) AS i
  FROM best, unnest(range(1, length(audit) + 1)) AS t(p)
), kept AS (
  SELECT e.*, g.role, g.text, row_number() OVER w AS nth, first_value(CASE WHEN e.e = 'K' AND g.initial = 's' THEN 1 ELSE 0 END) OVER w AS led
  FROM edits e LEFT JOIN g ON e.e <> 'I' AND g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.i = e.i
  WHERE e.e <> 'D' WINDOW w AS (PARTITION BY e.conv_id ORDER BY p)
), lines AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END,
    chr(10) ORDER BY p) AS repaired FROM kept GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op13_conversation_structure_repair", OP13_SQL)
def op13_conversation_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edaflux.llm.structure_repair import damaged, structure_repairs

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return structure_repairs(damaged(turns), turns)
