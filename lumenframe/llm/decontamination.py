"""Benchmark decontamination: template canonicalisation. Numbers, names and units become typed placeholders, windows of
template words are hash-joined, and the placeholders' values are checked for consistency, so that questions whose
parameters were changed are found too.

A number is a run of digits, with points or commas inside it (`1,200`, `3.5`), or a word of NUMBER_WORDS; a unit is a word of
UNITS after a number; a name is a run of capitalised words, at the beginning of a sentence too, but for the words of PLAIN.
Each is one placeholder. Other words, and the values of placeholders, are lower-cased. A window of placeholders alone says
nothing by its template and is compared with its values. A window that an item has twice counts once, where it comes first.

Capitals do not always tell names: texts are read in two ways. With names, where both sides have some; and without regard to
case, all names being plain words, so that a copy in small letters or capitals is found. Of the two, the one with the larger
share of the item's windows counts, with equal shares the first.

A document holds an item if at least `share` of the item's windows occur in it and each value in the item stands for one
value throughout these windows. The windows are judged over the whole document and in each occurrence: windows at one
distance from the item's own, and runs of distances less than half an item apart (words were put in or left out). If the
values disagree, the windows with the item's own values count alone. So a document may hold an item more than once, with
different values. An item of fewer than k words is one window of its own length and is found verbatim (but for case).

Windows that many items share (the same instructions before each question) do not multiply what a document meets: as an item
needs `share` of its windows, one of its rarest (1 - share) must be among them, and only pairs that meet in such a window are
looked at with all of them. The documents' windows that meet any item are written to the shared folder. Only DataFrame
functions are used.

Cases: a null or empty text holds nothing; an item of fewer than LEAST words, or of placeholders alone and shorter than k, is
held by nothing; rows with equal doc_id count as one document; rows with a null doc_id or item_id are left out; very long
texts are taken whole; extra columns are not read; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenframe.llm._shared import written

#: Units of measure that follow numbers (fixed values).
UNITS = "km|m|cm|mm|kg|g|mg|lb|oz|l|ml|s|ms|min|h|hours|minutes|seconds|days|weeks|months|years|miles|feet|inches|yards|meters|metres|kilometers|kilometres|centimeters|centimetres|grams|kilograms|pounds|ounces|liters|litres|gallons|dollars|euros|cents|degrees|percent|usd|eur"
NUMBER_WORDS = "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|dozen"
#: Words that are no names when they begin a sentence.
PLAIN = "a|about|above|after|all|also|although|always|an|and|another|any|are|as|assume|at|be|because|before|both|but|by|calculate|can|choose|compute|consider|could|determine|did|do|does|during|each|either|evaluate|every|explain|find|finally|first|for|from|given|had|has|have|he|her|here|his|how|however|i|if|in|into|is|it|its|let|like|many|most|my|neither|next|no|nor|not|now|of|on|once|only|or|other|our|over|she|should|show|simplify|since|so|solve|some|state|such|suppose|that|the|their|then|there|therefore|these|they|this|those|though|thus|to|under|until|was|we|were|what|when|where|whether|which|while|who|whose|why|will|with|without|would|write|yet|you|your"
_MARK = "\x01"
#: What counts as one word: a run of marked names, a number, a word (the same for Spark and SQL).
WORD = rf"{_MARK}m\p{{Lu}}\p{{L}}*(?: {_MARK}m\p{{Lu}}\p{{L}}*)*|[0-9]+(?:[.,][0-9]+)*|[\p{{L}}\p{{N}}]+"
#: A capital that begins a word; a marked word that is no name.
CAPITAL = r"(^|[^\p{L}\p{N}])(\p{Lu})"
NO_NAME = rf"{_MARK}m((?i:{PLAIN}|{NUMBER_WORDS})(?:[^\p{{L}}\p{{N}}]|$))"
MOST_BROADCAST = 500_000
LEAST = 3


def unmarked(text: Column) -> Column:
    return F.when(text.contains(_MARK), F.replace(text, F.lit(_MARK), F.lit(" "))).otherwise(F.coalesce(text, F.lit("")))


def named(text: Column) -> Column:
    """The text with \\x01m before each word of a name."""
    return F.regexp_replace(F.regexp_replace(text, CAPITAL, f"$1{_MARK}m$2"), NO_NAME, "$1")


def tokens(text: Column) -> Column:
    """The words in small letters; \\x01m marks names."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD.replace(")*", ")*+")), F.lit(0)), F.lower)  # possessive: no stack frame a repetition


def typed(raw: str) -> Column:
    """The words of the column with \\x01n before number words and \\x01u before units."""
    counted = lambda x: ((x >= "0") & (x < ":")) | x.isin(NUMBER_WORDS.split("|"))

    def mark(x: Column, i: Column) -> Column:
        unit = x.isin(UNITS.split("|")) & counted(F.get(raw, i - 1))
        return F.when(x.isin(NUMBER_WORDS.split("|")), F.concat(F.lit(f"{_MARK}n"), x)).when(unit, F.concat(F.lit(f"{_MARK}u"), x)).otherwise(x)

    return F.transform(raw, mark)


def is_slot(x: Column) -> Column:
    """Marks and ASCII digits sort before all letters."""
    return x < ":"


def template(x: Column) -> Column:
    return F.when(~is_slot(x), x).when(x.startswith(f"{_MARK}u"), F.lit("<unit>")).when(x.startswith(f"{_MARK}m"), F.lit("<name>")).otherwise(F.lit("<num>"))


def _words(texts: DataFrame, key: str) -> DataFrame:
    """key, part (one for each text of a key), form (0: with names, where there are any; 1: without), w."""
    df = texts.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.xxhash64("text").alias("part"), unmarked(F.col("text")).alias("x"))
    df = df.select(key, "part", "x", named(F.col("x")).alias("y"))
    forms = [F.struct(F.lit(1).alias("form"), F.col("x")), F.struct(F.lit(0).alias("form"), F.col("y").alias("x"))]
    df = df.select(key, "part", F.inline(F.when(F.col("y").contains(_MARK), F.array(*forms)).otherwise(F.array(forms[0]))))
    return df.select(key, "part", "form", tokens(F.col("x")).alias("raw")).select(key, "part", "form", typed("raw").alias("w"))


def windows(words: DataFrame, k: int, leads: DataFrame | None = None) -> DataFrame:
    """The columns of words with at, lead (hash of the first two template words from there on), h (hash of the form and the k
    template words), v (all words' values, null without any placeholder). With `leads`, windows that begin otherwise are left
    out before k words are hashed."""
    slots = F.size(F.filter("w", is_slot))
    value = F.transform("w", lambda x: F.when(is_slot(x), F.concat(x, F.lit("\x02"))).otherwise(F.lit("")))
    rest = [c for c in words.columns if c != "w"]
    df = words.where(F.size("w") >= k).select(*rest, "w", F.transform("w", lambda x: F.xxhash64(template(x))).alias("t"), F.when(slots > 0, value).alias("v"), slots.alias("n"))
    df = df.select(*rest, "t", "v", "n", F.posexplode_outer("t").alias("at", "first")).where(F.col("at") <= F.size("t") - k)  # outer: the inner form would compute t for a filter too
    df = df.withColumn("lead", F.xxhash64("first", F.get("t", F.col("at") + 1)))
    if leads is not None:
        df = df.join(leads, "lead", "left_semi")
    hashed = lambda c: F.xxhash64(F.slice(c, F.col("at") + 1, k), "form")
    own = (F.col("n") >= k) & ~F.array_contains(F.slice("v", F.col("at") + 1, k), "")
    return df.select(*rest, "v", "at", "lead", F.when(own, hashed("v")).otherwise(hashed("t")).alias("h"))


def _slots(k: int) -> Column:
    """The values of the window, in order; made behind the join, for windows that meet an item only."""
    return F.when(F.col("v").isNotNull(), F.array_join(F.slice("v", F.col("at") + 1, k), "")).otherwise(F.lit(""))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """About 50 bytes a row; beyond MOST_BROADCAST rows Spark chooses by its own measure."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def _short(docs: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """Items of fewer words than a window, word for word."""
    plain = F.transform("w", lambda x: F.regexp_replace(x, f"^{_MARK}[un]", ""))
    docs, items = docs.where("form = 1"), items.where("form = 1")
    items = items.where(F.size("w").isin(lengths) & F.exists("w", lambda x: ~is_slot(x))).select("item_id", F.xxhash64(plain).alias("h")).distinct()

    def cut(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size("x") - (n - 1)), lambda i: F.xxhash64(F.slice("x", i, n)))
        return F.when(F.size("x") >= n, every).otherwise(F.array().cast("array<bigint>"))

    own = docs.select("doc_id", plain.alias("x")).select("doc_id", F.explode_outer(F.flatten(F.array(*map(cut, lengths)))).alias("h"))
    found = own.join(_bounded(items, items.count()), "h").select("doc_id", "item_id").distinct()
    one = F.lit(1).cast("long")
    return found.select("doc_id", "item_id", one.alias("n_windows"), one.alias("item_windows"), F.lit("exact").alias("kind"))


def _asked(items: DataFrame, k: int, share: float) -> DataFrame:
    """The items' windows: item_id, form, h, lead, item_at, item_slots, item_windows, rare (one of these must be found)."""
    item = windows(items, k).groupBy("item_id", "form", "h", "lead").agg(F.min(F.struct("at", _slots(k).alias("slots"))).alias("o"))
    item = item.join(item.groupBy("h").agg(F.count("*").alias("items")), "h")
    own = Window.partitionBy("item_id", "form")
    item = item.withColumn("item_windows", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("items", "h")))
    rare = F.col("r") <= F.col("item_windows") - F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("item_windows"))) + 1
    return item.select("item_id", "form", "h", "lead", F.col("o.at").alias("item_at"), F.col("o.slots").alias("item_slots"), "item_windows", rare.alias("rare"))


def meetings(docs: DataFrame, item: DataFrame, k: int) -> DataFrame:
    """The documents' windows beside the items' for all pairs that share a rare window."""
    known = item.select("h").distinct()
    n = known.count()
    leads = F.broadcast(item.select("lead").distinct()) if n <= MOST_BROADCAST else None  # a larger benchmark has most beginnings
    hits = windows(docs, k, leads).join(_bounded(known, n), "h").select("doc_id", "part", "h", "at", _slots(k).alias("slots"))
    hits = written(hits, "template-hits")
    rare = item.where("rare").select("item_id", "form", "h")
    pairs = hits.select("doc_id", "h").distinct().join(rare, "h").select("doc_id", "item_id", "form").distinct()
    return hits.join(pairs.join(item.drop("rare", "lead"), ["item_id", "form"]), ["doc_id", "h"])


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 8, share: float = 0.5) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text. Returns doc_id, item_id, n_windows (of the item, found in the
    document or, if values disagree there, in its best occurrence), item_windows, kind: `exact` if all placeholder values
    agree, else `reparameterised`."""
    items, docs = _words(benchmark, "item_id"), _words(docs, "doc_id")
    lengths = sorted(r["n"] for r in items.where("form = 1").select(F.size("w").alias("n")).where(F.col("n").between(LEAST, k - 1)).distinct().collect())  # fewer than k
    found = meetings(docs, written(_asked(items, k, share), "template-items"), k)
    pairs = F.arrays_zip(F.split("item_slots", "\x02").alias("i"), F.split("slots", "\x02").alias("d"))
    by = found.groupBy("doc_id", "item_id", "form", "item_windows", "part", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set("item_at").alias("all"),
        F.collect_set(F.when(F.col("item_slots") == F.col("slots"), F.col("item_at"))).alias("own"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("item_slots") != "", pairs)))).alias("pairs"),
    )
    order = Window.partitionBy("doc_id", "item_id", "form").orderBy("part", "shift")
    apart = F.col("shift") - F.lag("shift").over(order) >= (F.col("item_windows") + (k - 1)) / 2
    by = by.withColumn("new", F.coalesce(apart | (F.col("part") != F.lag("part").over(order)), F.lit(True)).cast("int"))
    by = by.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    levels = [(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long")), (F.lit(1), F.lit(0).cast("long"), F.col("run")), (F.lit(2), F.col("part"), F.col("shift").cast("long"))]
    by = by.withColumn("o", F.explode(F.array(*(F.struct(a.alias("level"), b.alias("part"), c.alias("at")) for a, b, c in levels))))
    joined = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    by = by.groupBy("doc_id", "item_id", "form", "item_windows", "o").agg(joined("all"), joined("own"), joined("pairs"))
    same = F.forall("pairs", lambda p: p["i"] == p["d"])
    agree = same | (F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))))
    by = by.select("doc_id", "item_id", "form", "item_windows", (agree & (F.col("o.level") == 0)).alias("whole"), (same | ~agree).alias("exact"), F.size(F.when(agree, F.col("all")).otherwise(F.col("own"))).cast("long").alias("n"))
    by = by.where(F.col("n") >= F.lit(share) * F.col("item_windows")).groupBy("doc_id", "item_id", "form", "item_windows").agg(F.max(F.struct("whole", "exact", "n")).alias("b"))
    larger = F.struct(F.col("b.n") / F.col("item_windows"), -F.col("form"))
    by = by.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("b", "item_windows"), larger).alias("r")).select("doc_id", "item_id", "r.*")
    out = by.select("doc_id", "item_id", F.col("b.n").alias("n_windows"), "item_windows", F.when(F.col("b.exact"), "exact").otherwise("reparameterised").alias("kind"))
    return out.union(_short(docs, items, lengths)) if lengths else out
