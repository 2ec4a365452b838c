"""Registered queries of the document operators, each over its whole table, with DuckDB counterparts where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, exact, innertop, langid, negatives, packing, prefixtrie, quality, secrets, simhash, suffix,
               tokencount, toxicity)
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op7_quality")
def op7(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_scores(documents(spark, d), documents(spark, d, "labels"))


@query("op8_exact_dedup", r"""WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents),
g AS (SELECT doc_id, sha256(bare) AS text_sha256, count(*) OVER (PARTITION BY bare) AS group_size,
 first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""")
def op8(spark: SparkSession, d: str) -> DataFrame:
    return exact.exact_groups(documents(spark, d))


@query("op6_simhash")
def op6(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_components(documents(spark, d))


@query("op5_template_decontamination")
def op5(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contamination_report(documents(spark, d), documents(spark, d, "benchmark"))


@query("op3_packing")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(documents(spark, d))


@query("op9_token_counts")
def op9(spark: SparkSession, d: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, d))


@query("op2_toxicity")
def op2(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.severities(documents(spark, d), documents(spark, d, "labels"))


def _secret_sql() -> str:
    """Positions are running sums of the lengths between and of the matches, as texts are split by the same pattern."""
    parts = []
    for i, (kind, pattern, group, least) in enumerate((
        ("assign", """((?i:password|passwd|secret|token|api_?key))["\'\']?\\x20*[:=]\\x20*["\'\']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))):
        parts.append(f"""SELECT doc_id, {i} AS rank, '{kind}' AS kind, unnest(range(1, len(hit) + 1)) AS k, unnest(hit) AS m, unnest(val) AS v, unnest(gap[1:len(hit)]) AS g, {least} AS least
 FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS hit, regexp_extract_all(t, '{pattern}', {group}) AS val, regexp_split_to_array(t, '{pattern}') AS gap FROM d)""")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
p AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS stop FROM m),
s AS (SELECT doc_id, kind, rank, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM p WHERE length(v) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


@query("op4_secret_ledger", _secret_sql())
def op4(spark: SparkSession, d: str) -> DataFrame:
    return secrets.secret_report(documents(spark, d))


@query("op10_language")
def op10(spark: SparkSession, d: str) -> DataFrame:
    return langid.languages(documents(spark, d))


@query("op1_suffix_dedup")
def op1(spark: SparkSession, d: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, d))


#: Vectors that take part, as integers.
_VECTORS = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


@query("op11_hard_negatives", f"""WITH {_VECTORS},
l AS (SELECT vec_id, x, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label FROM v WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
 FROM l a JOIN l b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
 CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""")
def op11(spark: SparkSession, d: str) -> DataFrame:
    return negatives.hard_negatives(documents(spark, d, "embeddings"))


@query("op12_inner_products", f"""WITH {_VECTORS},
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
 FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op12(spark: SparkSession, d: str) -> DataFrame:
    return innertop.top_inner_products(documents(spark, d, "embeddings"))


#: A node's name is the list of its turns, each as a digest; a node counts for itself and for every beginning of it.
_TRIE_SQL = """WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
w AS (SELECT c, k, sha256(length(role) || ':' || role || text) AS d, octet_length(encode(text)) AS b FROM t),
own AS (SELECT c, list({'d': d, 'b': b} ORDER BY k) AS turns FROM w GROUP BY c),
crc AS (SELECT c, turns, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
 flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: list_prepend(CAST(ascii(x) AS BIGINT), list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))),
 lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 9 AS h FROM own),
r AS (SELECT a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns FROM crc a LEFT JOIN own b ON b.c = a.c - a.c % 5),
m AS (SELECT c, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
x AS (SELECT c, n, depth, list_transform(turns[1:depth], lambda y: y.d) AS key, CASE WHEN depth > 0 THEN turns[depth].b ELSE 0 END AS b FROM m),
g AS (SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, max(b) AS b,
 sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256 FROM x GROUP BY key, depth),
kids AS (SELECT key[1:depth - 1] AS key, count(*) AS n FROM g WHERE depth > 0 GROUP BY 1),
u AS (SELECT g.key, unnest(range(0, g.depth + 1)) AS up, (n_convs - 1) * b AS saved, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf FROM g LEFT JOIN kids ON kids.key = g.key),
s AS (SELECT key[1:up] AS key, sum(saved) AS saved, sum(leaf) AS leaves FROM u GROUP BY 1)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, coalesce(kids.n, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
 CAST(s.saved AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g JOIN s ON s.key = g.key LEFT JOIN kids ON kids.key = g.key LEFT JOIN g p ON g.depth > 0 AND p.key = g.key[1:g.depth - 1]"""


@query("op13_prefix_trie", _TRIE_SQL)
def op13(spark: SparkSession, d: str) -> DataFrame:
    return prefixtrie.prefix_trie(documents(spark, d, "conversations"))
