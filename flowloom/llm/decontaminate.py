"""Benchmark decontamination by template canonicalisation, with built-in functions only.

Texts become templates: capitalised names inside a sentence, numbers, and units after a number are replaced by typed
placeholders, everything is lower-cased and punctuation dropped. In a second form of the template every capitalised word
is a name, also at the start of a sentence, after a sign or a number; a place is hit when any form of the document's
window is any of the item's. Windows of WINDOW template words are hashed and
hash-joined with the windows of the benchmark. Hits of a document and an item with the same distance between their
places are one alignment. In an alignment every slot value of the item must stand for one value of the document; then the
question has been copied (all values equal) or re-parameterised (values replaced consistently, different ones by equal
ones too). Where a value stands for several, the most frequent holds, none on a tie, and the windows that contradict it do
not count; all others do. This is judged among the hits of the first forms and among all hits; a window counts if it does in either. A document is contaminated by an item if
SIMILARITY of the item's distinct windows are hit by windows that count.

A benchmark is broadcast only while its windows are at most MAX_BROADCAST; a larger one is joined by shuffle. Windows
made of placeholders alone, or with fewer than two words, say nothing and are left out on the item's side.

Null and empty texts have no window and are clean, as are all documents when the benchmark is empty; items of fewer
than WINDOW template words are not searched for; items with equal text are found each (a null item id is reported as such);
repeated documents are reported once, rows with null ids under the null id. Extra columns are passed over, or kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stage, text_of, whole_rows

WINDOW, SIMILARITY = 5, 0.8
#: Windows of a benchmark that may be broadcast (about 40 bytes each).
MAX_BROADCAST = 500_000
NUMBER, NAME, UNIT = "⟨num⟩", "⟨name⟩", "⟨unit⟩"
#: Units of measure that follow a number.
UNITS = ("km", "m", "cm", "mm", "mi", "miles", "mile", "ft", "feet", "inches", "kg", "g", "mg", "lb", "lbs", "pounds", "tons", "l", "ml", "litres", "liters",
         "s", "sec", "seconds", "min", "minutes", "h", "hours", "hour", "days", "day", "weeks", "months", "years", "mph", "kmh", "dollars", "euros", "cents", "percent", "degrees")
# possessive and without a repeated alternation, which Java walks recursively: a long number would overflow its stack
_NUMBER = "[0-9]++(?:[.,:/][0-9]++)*+"
# the capital is looked for first, so the text before it is looked at only there
_NAME = "\\p{Lu}(?<=\\p{Ll}[,;:]?\\x20\\p{Lu})\\p{Ll}+(?!\\p{L})"
# every capitalised word after a sign, a digit or nothing
_CAPITALISED = "\\p{Lu}(?<![^\\x00-\\x40\\x5B-\\x60\\x7B-\\xA9\\xAB-\\xB4\\xB6-\\xB9\\xBB-\\xBF\\xD7\\xF7\\u2000-\\u206F\\u3000-\\u303F]\\p{Lu})\\p{Ll}+(?!\\p{L})"
_UNIT = f"(?i:{'|'.join(UNITS)})(?!\\p{{L}})"
# what stands between words: ASCII and Latin-1 signs, general and CJK punctuation (ranges are far faster than a negated letter class)
_BETWEEN = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\xA9\\xAB-\\xB4\\xB6-\\xB9\\xBB-\\xBF\\xD7\\xF7\\u2000-\\u206F\\u3000-\\u303F]+"
#: How names are found in the first and in the second form.
FORMS = (_NAME, _CAPITALISED)


def template(text: Column, form: int = 0) -> Column:
    """Template words of a text, an array; as many, at the same places, in both forms."""
    t = F.regexp_replace(text, FORMS[form], NAME)
    # by the digit before the unit: a long number would be walked again from each of its digits
    t = F.regexp_replace(t, f"(?<=[0-9])\\x20?{_UNIT}", f" {UNIT} ")
    t = F.regexp_replace(t, _NUMBER, f" {NUMBER} ")
    return F.array_remove(F.split(F.lower(t), _BETWEEN), "")


def slot_values(text: Column, form: int = 0) -> Column:
    """The texts that stand at the placeholders, in order."""
    return F.regexp_extract_all(text, F.lit(f"({FORMS[form]}|{_NUMBER}|(?<=[0-9]\\x20?){_UNIT})"), 1)


def is_slot(word: Column) -> Column:
    return word.startswith("⟨")


def window_hashes(words: Column) -> Column:
    """Hashes of all windows, by place; empty where there are fewer words than a window."""
    at = F.sequence(F.lit(1), F.size(words) - WINDOW + 1)
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(WINDOW)]))
    return F.when(F.size(words) >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>"))


def form_windows(rows: DataFrame, *keep: str) -> DataFrame:
    """Place, form and hash of all windows of the text; the second form only where it differs. ``first`` is the first form's hash."""
    words = rows.select(*keep, template(F.col("text")).alias("w0"), template(F.col("text"), 1).alias("w1"))
    hashed = words.select(*keep, "w0", "w1", window_hashes(F.col("w0")).alias("h0"), window_hashes(F.col("w1")).alias("h1"))
    first = F.transform("h0", lambda h, i: F.struct(i.alias("at"), F.lit(0).alias("form"), h.alias("h"), h.alias("first")))
    second = F.transform("h1", lambda h, i: F.struct(i.alias("at"), F.lit(1).alias("form"), h.alias("h"), F.get("h0", i).alias("first")))
    return hashed.select(*keep, "w0", "w1", F.inline(F.concat(first, F.filter(second, lambda x: x["h"] != x["first"]))))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item (its row key), n_windows (distinct in the first form), place, form, hash of the windows that say something, and
    the hash of the first form, which names the window."""
    placed = form_windows(benchmark, "item")
    words = F.when(F.col("form") == 0, F.col("w0")).otherwise(F.col("w1"))
    telling = placed.where(F.size(F.filter(F.slice(words, F.col("at") + 1, WINDOW), lambda x: ~is_slot(x))) >= 2)
    sizes = telling.where("form = 0").groupBy("item").agg(F.countDistinct("first").alias("n_windows"))
    return telling.select("item", "at", F.col("form").alias("iform"), "h", "first").join(sizes, "item")


def _slots(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Per key, the template words and the slot values in both forms, for the few texts that were hit."""
    text, both = F.col("text"), range(len(FORMS))
    return rows.select(F.col(key), F.array(*[template(text, f) for f in both]).alias(f"{prefix}w"), F.array(*[slot_values(text, f) for f in both]).alias(f"{prefix}v"))


def _pairs(place: str, prefix: str) -> Column:
    """Slot values of the window at ``place``: as many as it has placeholders, after those before it."""
    words, values = (F.get(f"{prefix}{x}", F.col(f"{prefix}form")) for x in "wv")
    count = lambda a: F.size(F.filter(a, is_slot))
    before = count(F.slice(words, F.lit(1), F.col(place)))
    return F.slice(values, before + 1, count(F.slice(words, F.col(place) + 1, WINDOW)))


def _slot_places(place: str, prefix: str) -> Column:
    """Places of the placeholders of the window at ``place``."""
    words, at = F.get(f"{prefix}w", F.col(f"{prefix}form")), F.col(place)
    return F.filter(F.sequence(at, at + (WINDOW - 1)), lambda i: is_slot(F.get(words, i)))


def _agreeing(valued: DataFrame, alignment: list[str]) -> DataFrame:
    """Per alignment, place with slots and forms of the hit: does each hold what its item value mostly stands for (consistent), and is any
    not the item's own (changed)?"""
    pair = F.explode(F.arrays_zip("dv", "iv", "ip")).alias("slot")
    slots = valued.where(F.size("iv") > 0).select(*alignment, "at", "forms", pair).select(*alignment, "at", "forms", "slot.*")
    votes = slots.select(*alignment, "iv", "dv", "ip").distinct().groupBy(*alignment, "iv", "dv").agg(F.count(F.lit(1)).alias("n"))
    ranked = votes.groupBy(*alignment, "iv").agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "dv")))).alias("top"))
    clear = F.coalesce(F.col("top")[0]["n"] > F.get("top", F.lit(1))["n"], F.lit(True))
    means = ranked.select(*alignment, F.col("iv").alias("own"), F.col("top")[0]["dv"].alias("means"), clear.alias("clear"))
    slots, means = slots.alias("s"), means.alias("m")
    on = [F.col(f"s.{c}") == F.col(f"m.{c}") for c in alignment] + [F.col("s.iv").eqNullSafe(F.col("m.own"))]
    judged = slots.join(means, on).select("s.*", (F.col("clear") & F.col("dv").eqNullSafe(F.col("means"))).alias("fits"), (~F.col("dv").eqNullSafe(F.col("iv"))).alias("new"))
    return judged.groupBy(*alignment, "at", "forms").agg(F.min("fits").alias("consistent"), F.max("new").alias("changed"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows of the item, n_hit (of these, hit by windows that count) and reparameterised, one row per contaminated document and item.

    Also the row key ``rid`` of the document.
    """
    bench = benchmark.select(row_key("item_id").alias("item"), "item_id", text_of().alias("text")).dropDuplicates(["item"])
    windows = stage(benchmark_windows(bench), "benchmark-windows")
    small = windows.count() <= MAX_BROADCAST
    keyed = docs.select("doc_id", row_key().alias("rid"), text_of().alias("text"))
    spread = form_windows(keyed, "rid").select("rid", F.col("at").alias("p"), F.col("form").alias("dform"), "h")
    hits = spread.join(F.broadcast(windows) if small else windows, "h").select("rid", "item", "n_windows", "p", "at", "dform", "iform", "first")
    hits = stage(hits, "hits")
    # only documents with enough windows of an item go on to the slot check
    likely = hits.groupBy("rid", "item").agg(F.countDistinct("first").alias("n"), F.first("n_windows").alias("n_windows")).where(F.col("n") >= SIMILARITY * F.col("n_windows"))
    near = hits.join(likely.select("rid", "item"), ["rid", "item"], "left_semi")
    texts = keyed.join(likely.select("rid").distinct(), "rid", "left_semi")
    texts = stage(texts.dropDuplicates(["rid"]), "hit-texts")
    items = _slots(bench, "item", "i")
    # hits are written some 30 times smaller than they are in memory, so that the planner would broadcast too many of them
    full = near.hint("merge").join(_slots(texts.repartition("rid"), "rid", "d"), "rid").join(items, "item")
    alignment = ["rid", "item", "shift", "view"]
    views = F.when(F.col("dform") + F.col("iform") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    valued = full.select("rid", "item", "n_windows", "first", "at", (F.col("p") - F.col("at")).alias("shift"), F.concat("dform", "iform").alias("forms"), views.alias("views"), _pairs("p", "d").alias("dv"), _pairs("at", "i").alias("iv"), _slot_places("at", "i").alias("ip"))
    valued = valued.withColumn("view", F.explode("views")).drop("views")
    counted = valued.join(_agreeing(valued, alignment), [*alignment, "at", "forms"], "left").where(F.coalesce("consistent", F.lit(True)))
    found = counted.groupBy("rid", "item", "n_windows").agg(F.countDistinct("first").alias("n_hit"), F.max(F.coalesce("changed", F.lit(False))).alias("reparameterised"))
    found = found.where(F.col("n_hit") >= SIMILARITY * F.col("n_windows"))
    named = found.join(bench.select("item", "item_id"), "item").join(texts.select("rid", "doc_id"), "rid")
    return named.select("rid", "doc_id", "item_id", "n_windows", "n_hit", "reparameterised")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark).drop("rid")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones."""
    bad = stage(contaminated(docs, benchmark).select("rid").distinct(), "contaminated")
    return whole_rows(docs, rid=row_key()).join(bad, "rid", "left_anti").select("row.*")
