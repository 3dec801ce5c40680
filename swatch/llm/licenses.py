"""Licence detections by ordered signature rules.  DataFrame functions only.

* A text is searched only if it has one of the rules' anchors (plain substring tests), and a rule is tried only if all of
  its keywords are in the text: each keyword is tested once for a text, however many rules share it.
* The matches of a rule that is tried are taken with their places.  Only places are shuffled, never text.
* Overlaps: a detection goes if its interval lies within that of a detection of a better tier, or of its own
  tier, there of a longer one or of an earlier rule.  Sorted by start, running furthest ends tell; no pairs are made.
* The base phrases stand by themselves, whatever the rules suppress.

Words are runs of ASCII letters, digits and anything beyond ASCII; letters match in either case (A-Z only).
Positions of words count from 0, those of ``parts`` are code points with exclusive ends.  ``score`` is the best
confidence of what was found, 0 if nothing was.  Null is an empty text: no words, no labels.  A row of the input gives
a row of the output, also when ids repeat or are null (rows are told apart by a row key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatch.llm.license_rules import ANCHORS, GAP, GENERIC, TAG, WEIGHT, WORD, rules

# Label, the words of the phrase, and the confidence that it alone gives.
PHRASES = [("cc-by", "cc by", 0.5), ("gpl", "general public license", 0.6), ("reserved", "all rights reserved", 0.4)]
_SEPARATORS = rf"[^{WORD}]+"
_PHRASE = (rf"(?i)(?<![{WORD}])(?:" + "|".join(p.replace(" ", _SEPARATORS) for _, p, _ in PHRASES) + rf")(?![{WORD}])")
_CC_BY = rf"[cC][cC]{_SEPARATORS}[bB][yY]"


def count_words(text: Column) -> Column:
    """Each word with the separators around it shrinks to one character."""
    shrunk = F.regexp_replace(text, rf"[^{WORD}]*+[{WORD}]++[^{WORD}]*+", "w")
    return F.when(text.rlike(f"[{WORD}]"), F.length(shrunk)).otherwise(0).cast("long")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, also inside of nested functions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _base(text: Column, n_words: Column) -> Column:
    """Places of the phrases: their number, the first and last start in words, and labels."""
    # Phrases share no words, so none overlaps another and one pass finds all places.
    def places(p: Column) -> Column:
        last = F.element_at(p["found"], -1)
        initial = lambda m: F.lower(F.left(m, F.lit(1)))
        by = lambda m, values: F.element_at(F.create_map(*[
            x for (_, phrase, _), v in zip(PHRASES, values) for x in (F.lit(phrase[0]), F.lit(v))]), initial(m))
        labels = F.array_sort(F.array_distinct(F.transform(p["found"], lambda m: by(m, [x[0] for x in PHRASES]))))
        size = by(last, [len(x[1].split()) for x in PHRASES])
        return F.when(F.size(p["found"]) > 0, F.struct(
            F.size(p["found"]).cast("long").alias("n_base"), count_words(F.element_at(p["gaps"], 1)).alias("first_word"),
            (n_words - count_words(F.element_at(p["gaps"], -1)) - size).alias("last_word"), labels.alias("labels")))

    return bound(F.struct(F.regexp_extract_all(text, F.lit(_PHRASE), F.lit(0)).alias("found"),
                          F.split(text, _PHRASE, -1).alias("gaps")), places)


def _detections(text: Column, cc_by: Column) -> Column:
    """Matches of the rules whose keywords are there: rule, how many before it, gap to the last one, length."""
    table = rules()
    words = sorted({k for r in table for k in r.keywords})
    known = F.array(*[F.lit(w) for w in words])
    every = F.array(*[F.struct(F.lit(i).alias("rule"), F.array(*[F.lit(k) for k in r.keywords]).alias("keywords"),
                               F.lit(r.pattern).alias("pattern")) for i, r in enumerate(table)])

    def matches(rule: Column) -> Column:
        found = F.arrays_zip(F.regexp_extract_all(text, rule["pattern"], F.lit(0)).alias("m"),
                             F.split(text, rule["pattern"], -1).alias("gap"))
        return F.transform(F.filter(found, lambda x: x["m"].isNotNull()), lambda x, i: F.struct(
            rule["rule"].alias("rule"), i.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("size")))

    def tried(low: Column) -> Column:
        has = F.filter(known, lambda w: F.contains(low, w) & ((w != "cc") | cc_by))
        return bound(has, lambda h: F.filter(every, lambda r: F.forall(r["keywords"], lambda k: F.array_contains(h, k))))

    return F.flatten(F.transform(bound(F.lower(text), tried), matches))


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels`` and ``labels`` (sorted arrays), ``score`` and
    ``parts``, an array of ``struct<start, end, rule, tier, label>`` of the detections that stay, sorted by start."""
    table = rules()
    anchors = F.array(*[F.lit(a) for a in ANCHORS if a != "cc"])
    slim = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias(id_col),
                       F.coalesce(docs[text_col], F.lit("")).alias("text"))
    text = F.col("text")
    gated = slim.withColumn("gate", bound(F.lower(text), lambda low: F.struct(
        F.exists(anchors, lambda a: F.contains(low, a)).alias("rules"),
        ((F.contains(low, F.lit("license")) & F.contains(low, F.lit("public")))
         | (F.contains(low, F.lit("reserved")) & F.contains(low, F.lit("rights")))).alias("phrases"))))
    gated = gated.withColumn("cc_by", text.rlike(_CC_BY)).withColumn("n_words", count_words(text))
    base = F.when(F.col("gate.phrases") | F.col("cc_by"), _base(text, F.col("n_words")))
    found = F.when(F.col("gate.rules") | F.col("cc_by"), _detections(text, F.col("cc_by")))
    each = (gated.select("row", F.struct(id_col, "n_words", base.alias("base")).alias("own"), found.alias("found"))
            .select("row", "own", F.posexplode_outer("found").alias("at", "d"))
            # A row's own columns ride on its first detection only.
            .select("row", F.when(F.coalesce(F.col("at"), F.lit(0)) == 0, F.col("own")).alias("own"), "d.*")
            .repartition("row"))
    before = Window.partitionBy("row", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = (each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
              .withColumn("start", F.col("end") - F.col("size"))
              .withColumn("tier", F.element_at(F.array(*[F.lit(r.tier) for r in table]), F.col("rule") + 1)))
    sofar = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    covered = F.lit(False)
    for tier in range(TAG, GENERIC):  # the furthest end of what starts no later, in this tier or a better one
        furthest = F.max(F.when(F.col("tier") <= tier, F.col("end"))).over(sofar)
        covered = covered | ((F.col("tier") == tier + 1) & F.coalesce(furthest >= F.col("end"), F.lit(False)))
    equals = Window.partitionBy("row", "tier").orderBy("start", F.desc("end"), "rule").rowsBetween(
        Window.unboundedPreceding, -1)
    covered = covered | F.coalesce(F.max("end").over(equals) >= F.col("end"), F.lit(False))
    label = F.element_at(F.array(*[F.lit(r.label) for r in table]), F.col("rule") + 1)
    part = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "rule", "tier",
                    label.alias("label"))
    kept = F.col("rule").isNotNull() & ~F.col("covered")
    grouped = placed.withColumn("covered", covered).groupBy("row").agg(
        F.first("own", ignorenulls=True).alias("own"), F.array_sort(F.collect_list(F.when(kept, part))).alias("parts"),
        F.min(F.when(kept, F.col("tier"))).alias("best"))
    names = lambda of, column: F.coalesce(column, F.array().cast("array<string>"))
    base_labels = names(None, F.col("own.base.labels"))
    own = F.transform("parts", lambda p: p["label"])
    weight = F.create_map(*[x for t, w in WEIGHT.items() for x in (F.lit(t), F.lit(w))])
    phrase = F.greatest(F.lit(0.0), *[F.when(F.array_contains(base_labels, n), F.lit(w)).otherwise(0.0)
                                      for n, _, w in PHRASES])
    return grouped.select(
        F.col(f"own.{id_col}").alias(id_col), "own.n_words", F.coalesce("own.base.n_base", F.lit(0).cast("long")).alias("n_base"),
        "own.base.first_word", "own.base.last_word", base_labels.alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(base_labels, own))).alias("labels"),
        F.greatest(phrase, F.coalesce(weight[F.col("best")], F.lit(0.0))).alias("score"), "parts")
