"""Secret scans over an incremental blob ledger, with built-in functions only.

Every historical version of every path is addressed by its content, so equal versions are one blob. A ledger says which
(blob, rule, rule version) has been scanned and what was found. A scan reads the text of one version of each blob
that misses some current rule version, applies just the missing rules, and appends rows (also those that found
nothing). Findings are then joined back to all versions of all paths.

Spans are in code points, end exclusive. A rule's matches are leftmost and do not overlap; matches whose value is too
short are dropped after matching, so they still cover what they matched. Positions are running sums of the
lengths between and of the matches, in one window per blob and rule, linear in the text.

Null texts count as the empty blob; empty texts have no findings; repeated rows and rows with null ids each get their
findings; an empty table gives an empty result and no ledger rows. Extra columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, stage, text_of


@dataclass(frozen=True)
class Rule:
    """``value`` is the group whose length must be ``least`` at least."""

    kind: str
    version: int
    pattern: str
    value: int
    least: int


#: The base rules, in the order that breaks ties.
RULES = (
    Rule("assign", 1, "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, "[0-9a-f]{16,}", 0, 16),  # a run of 16 or more is always matched whole, as by [0-9a-f]+
)
LEDGER = "blob string, kind string, version int, spans array<struct<start:bigint,stop:bigint>>"


def versions(history: DataFrame) -> DataFrame:
    """doc_id, row key and blob address of every version, written once."""
    return stage(history.select("doc_id", row_key().alias("rid"), F.sha2(text_of(), 256).alias("blob")), "versions")


def unseen(heads: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, one row key that has its text, and the kinds to scan it for."""
    blobs = heads.groupBy("blob").agg(F.min("rid").alias("rid"))
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    pairs = blobs.select("blob", "rid", F.inline(current))
    if ledger is not None:
        pairs = pairs.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
    return pairs.groupBy("blob", "rid").agg(F.collect_set("kind").alias("kinds"))  # as many as there are rules


def _matches(rule: Rule) -> Column:
    """Text before each match, the match, its value; the last entry has no match."""
    text, p = F.col("text"), F.lit(rule.pattern)
    found = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, p, 0).alias("hit"), F.regexp_extract_all(text, p, rule.value).alias("value"))
    wanted = F.array_contains("kinds", rule.kind) & text.rlike(rule.pattern)
    return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"), F.when(wanted, found).alias("found"))


def scan(history: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, heads: DataFrame | None = None) -> DataFrame:
    """New ledger rows for all unseen (blob, rule, version)."""
    heads = versions(history) if heads is None else heads
    todo = stage(unseen(heads, ledger, rules), "unseen")
    texts = history.select(row_key().alias("rid"), text_of().alias("text")).join(todo, "rid").select("blob", "kinds", "text")
    matched = texts.select("blob", F.explode(F.array(*[_matches(r) for r in rules])).alias("r"))
    hits = matched.where(F.col("r.found").isNotNull()).select("blob", "r.kind", "r.version", "r.least", F.posexplode("r.found").alias("k", "m")).where(F.col("m.hit").isNotNull())
    sized = hits.select("blob", "kind", "version", "k", F.length("m.gap").cast("long").alias("gap"), F.length("m.hit").cast("long").alias("size"), (F.length("m.value") >= F.col("least")).alias("good"))
    # repeated rows bring a blob's text more than once: one set of matches stays
    sized = stage(sized.dropDuplicates(["blob", "kind", "k"]), "matches")
    before = Window.partitionBy("blob", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(before)).where("good")
    spans = placed.groupBy("blob", "kind", "version").agg(F.array_sort(F.collect_list(F.struct((F.col("stop") - F.col("size")).alias("start"), "stop"))).alias("spans"))
    version = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    pairs = todo.select("blob", F.explode("kinds").alias("kind")).withColumn("version", version[F.col("kind")])
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return pairs.join(spans, ["blob", "kind", "version"], "left").select("blob", "kind", "version", F.coalesce("spans", none).alias("spans"))


def report(heads: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts by kind and all spans of every version, from the ledger rows of the current rule versions."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.struct(F.lit(i).alias("rank"), F.lit(r.version).alias("version")))])
    live = ledger.where(F.size("spans") > 0).withColumn("r", rank[F.col("kind")]).where(F.col("r.version") == F.col("version"))
    each = live.select("blob", "kind", "r.rank", F.inline("spans"))
    counts = [F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in rules]
    blobs = each.groupBy("blob").agg(*counts, F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "stop"))).alias("all"))
    spelt = F.transform("all", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string")))
    found = blobs.select("blob", *[f"n_{r.kind}" for r in rules], F.array_join(spelt, ",").alias("spans"))
    joined = heads.join(found, "blob", "left")
    return joined.select("doc_id", *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules], F.coalesce("spans", F.lit("")).alias("spans"), "blob")


def secret_report(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document (each a path with one version)."""
    heads = versions(docs)
    new = stage(scan(docs, ledger, heads=heads), "ledger")
    known = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    return report(heads, known).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")
