"""Document fingerprints after I-Match.  DataFrame functions only.

* Terms are the distinct runs of ASCII letters, digits and anything beyond ASCII.
* The lexicon keeps terms within a band of inverse document frequency: document frequency from
  ``low`` to ``high`` of all documents (2 documents at least).  If a document has d distinct terms on average, at
  most d / low terms can reach the lower bound, however large the corpus is: the lexicon does not
  grow with it.  It is broadcast after its count is checked, and joined by shuffle beyond ``BROADCAST_TERMS``.
* Subsets of the lexicon are drawn at random (a hash of term and subset number), ``PER_RATE`` at
  each of the rates 1 in ``RATES``, so that texts short and long have subsets of which they hold only a
  few terms.
* A signature is the hash of a document's sorted distinct terms in one subset; the first signature
  takes the whole lexicon.  A fingerprint is all of them in hex.

Likeness of two fingerprints: equal signatures over signatures that are not empty in both.  Null
text is empty; a text without a term of the lexicon gets the hash of its text as first
signature and no others, so equal texts always have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swatch.session import materialize

LOW, HIGH = 0.0005, 0.05
RATES = [4, 16, 48, 128, 320, 800, 2000]
PER_RATE = 9  # 63 subsets fit the bits of a long
SUBSETS = len(RATES) * PER_RATE
BROADCAST_TERMS = 2_000_000
QUANTILES, BUCKET = 256, 1024  # the first a power of two
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WIDTH = 6  # hex digits of a signature
EMPTY = "0" * WIDTH


def _words(text: Column) -> Column:
    """Distinct terms, and always the empty string, which keeps texts without terms in the joins."""
    return F.array_union(F.split(text, SEPARATORS, -1), F.array(F.lit("")))


def build_lexicon(texts: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Terms in the band with their hash and the bit mask of the subsets they belong to."""
    n = texts.count()
    df = (texts.select(F.explode(_words(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
          .where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    kept = df.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n)))
    rate = F.element_at(F.array(*[F.lit(r) for r in RATES for _ in range(PER_RATE)]), F.col("subset") + 1)
    member = F.pmod(F.xxhash64("term", "subset"), rate) == 0
    # One row per term and subset, folded to a mask; the rows are bounded like the lexicon.
    masks = (kept.select("term", F.explode(F.sequence(F.lit(0), F.lit(SUBSETS - 1))).alias("subset"))
             .groupBy("term").agg(F.bit_or(F.when(member, F.expr("shiftleft(1L, subset)")).otherwise(F.lit(0).cast("long")))
                                  .alias("mask")))
    return materialize(masks.select("term", F.xxhash64("term").alias("h"), "mask"), "imatch-lexicon")


def _signatures(terms: Column, fallback: Column) -> Column:
    """Fingerprint of an array of distinct ``struct<h, mask>``."""

    def fingerprint_of(ordered: Column) -> Column:
        def signature(of: Column, r: Column) -> Column:
            own = F.transform(F.filter(of, lambda t: F.bit_get(t["mask"], r) == 1), lambda t: t["h"])
            return F.when(F.size(own) > 0, F.right(F.concat(F.lit(EMPTY), F.lower(F.hex(F.xxhash64(own)))), F.lit(WIDTH))
                          ).otherwise(F.lit(EMPTY))

        def of_rate(k: int) -> Column:
            # Few terms are in any subset of a low rate: they are picked out once for all subsets of the rate.
            bits = F.lit(((1 << PER_RATE) - 1) << (k * PER_RATE))
            some = F.filter(ordered, lambda t: t["mask"].bitwiseAND(bits) != 0)
            subsets = F.sequence(F.lit(k * PER_RATE), F.lit((k + 1) * PER_RATE - 1))
            return F.element_at(F.transform(F.array(some), lambda of: F.array_join(
                F.transform(subsets, lambda r: signature(of, r)), "")), 1)

        whole = F.when(F.size(ordered) > 0, F.xxhash64(F.transform(ordered, lambda t: t["h"]))).otherwise(fallback)
        first = F.right(F.concat(F.lit(EMPTY), F.lower(F.hex(whole))), F.lit(WIDTH))
        return F.concat(first, *[of_rate(k) for k in range(len(RATES))])

    # Bound as the one element of an array, so that the terms are sorted once and not once per subset.
    return F.element_at(F.transform(F.array(F.sort_array(terms)), fingerprint_of), 1)


def fingerprint(df: DataFrame, texts: list[str], lexicon: DataFrame, keys: list[str],
                carry: list[str]) -> DataFrame:
    """Fingerprints ``<name>_fp`` of the text columns ``texts``; one row per value of ``keys``, which
    must tell rows apart, with the columns ``carry``.

    Terms are exploded in place and grouped by the keys again, without a shuffle if ``df`` is already
    partitioned by a part of them.  Carried columns ride on the one empty term of a row only."""
    lex = lexicon.select(F.col("term").alias("l_term"), "h", "mask")
    bounded = lexicon.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    lex = lex.unionByName(df.sparkSession.sql("SELECT '' AS l_term, 0L AS h, 0L AS mask"))
    plain = [f"{t}_plain" for t in texts]
    # Computed below the explode; in the same select they would be worked out anew for every term.
    for t in texts:
        df = df.withColumn(f"{t}_plain", F.xxhash64(F.coalesce(F.col(t), F.lit(""))))
    df = df.withColumn("meta", F.struct(*carry, *plain))

    def sided(i: int, t: str) -> Column:
        return F.transform(_words(F.coalesce(F.col(t), F.lit(""))), lambda w: F.struct(
            F.lit(i).alias("side"), w.alias("term"), F.when((w == "") & F.lit(i == 0), F.col("meta")).alias("meta")))

    words = F.concat(*[sided(i, t) for i, t in enumerate(texts)])
    each = df.select(*keys, F.explode(words).alias("w")).select(*keys, "w.*")
    joined = each.join(F.broadcast(lex) if bounded else lex, F.col("term") == F.col("l_term"))
    term = F.struct("h", "mask")
    grouped = joined.groupBy(*keys).agg(
        F.first("meta", ignorenulls=True).alias("meta"),
        *[F.collect_list(F.when((F.col("side") == i) & (F.col("term") != ""), term)).alias(f"{t}_terms")
          for i, t in enumerate(texts)])
    return grouped.select(*keys, "meta.*", *[f"{t}_terms" for t in texts]).select(
        *keys, *carry, *[_signatures(F.col(f"{t}_terms"), F.col(f"{t}_plain")).alias(f"{t}_fp") for t in texts])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures among those that are not empty in both; 0 to 1."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS)), lambda i: F.struct(
        F.substring(a, i * WIDTH + 1, F.lit(WIDTH)).alias("a"), F.substring(b, i * WIDTH + 1, F.lit(WIDTH)).alias("b")))
    some = F.filter(parts, lambda p: (p["a"] != EMPTY) | (p["b"] != EMPTY))
    same = F.filter(some, lambda p: p["a"] == p["b"])
    return F.when(F.size(some) == 0, (a == b).cast("double")).otherwise(F.size(same) / F.size(some))


def _bucketed(rows: DataFrame) -> DataFrame:
    """Adds ``bucket``, a struct that orders like ``doc_id`` and holds about ``BUCKET`` rows: quantiles of the ids
    (a bounded number, found by binary search), each cut into parts of equal width."""
    n = rows.count()
    points = [(i + 1) / QUANTILES for i in range(QUANTILES - 1)]
    found = rows.agg(F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", points, 10_000)).first()
    if found[0] is None:
        return rows.withColumn("bucket", F.struct(F.lit(-1).alias("q"), F.lit(0).cast("long").alias("part")))
    low, high = found[0], found[1]
    cuts = (found[2] + [high + 1] * QUANTILES)[:QUANTILES - 1]
    bounds = F.array(*[F.lit(x).cast("long") for x in cuts])
    edges = F.array(*[F.lit(x).cast("long") for x in [low, *cuts, high + 1]])
    # Number of bounds at or below the id.
    search = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(QUANTILES.bit_length() - 1))]), F.lit(0), lambda at, step: F.when(
        F.element_at(bounds, at + step) <= F.col("doc_id"), at + step).otherwise(at))
    parts = max(1, n // (QUANTILES * BUCKET))
    out = rows.withColumn("q", F.coalesce(F.when(F.col("doc_id").isNotNull(), search), F.lit(-1)))
    if parts == 1:
        part = F.lit(0).cast("long")
    else:
        lo, hi = F.element_at(edges, F.col("q") + 1), F.element_at(edges, F.col("q") + 2)
        share = (F.col("doc_id") - lo).cast("double") / F.greatest(hi - lo, F.lit(1).cast("long"))
        part = F.when(F.col("q") < 0, F.lit(0).cast("long")).otherwise(F.least(F.floor(share * parts), F.lit(parts - 1).cast("long")))
    return out.withColumn("bucket", F.struct("q", part.alias("part"))).drop("q")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``bucket, wrap, doc_id, row, text, halo``: documents dealt to buckets of neighbouring ids, and the rows of
    the first id of each bucket once more (``halo``) in the bucket before, so that each row finds the next one beside it.

    The last bucket gets the very first row, after all others (``wrap``).  Rows with one id follow in the
    order of the input, null ids come first, in one bucket.  Texts are shuffled once; the first ids (one
    per bucket) are broadcast below a checked count.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = _bucketed(rows)
    order = Window.orderBy("bucket")  # over one row per bucket
    firsts = rows.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = materialize(firsts.select(
        "first_id", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(everything)).alias("before"),
        F.lag("bucket").over(order).isNull().alias("wraps")), "imatch-firsts")
    small = firsts.count() <= BROADCAST_TERMS
    marked = rows.join(F.broadcast(firsts) if small else firsts, F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    own = F.struct("bucket", F.lit(False).alias("halo"), F.lit(False).alias("wrap"))
    halo = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("halo"), F.col("wraps").alias("wrap"))
    copies = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, halo))
    return marked.select("row", "doc_id", "text", F.explode(copies).alias("c")).select("c.*", "row", "doc_id", "text")


NEXT = ["wrap", "halo", "doc_id", "row"]


def half_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``with_next`` with ``edited``: the last floor(n / 2) of n code points are replaced by the first as many,
    or all, of the next document."""
    rows = with_next(docs, id_col, text_col)
    after = F.lead("text").over(Window.partitionBy("bucket").orderBy(*NEXT))
    half = F.floor(F.length("text") / 2).cast("int")
    kept = F.substring("text", F.lit(1), F.length("text") - half)
    return rows.withColumn("after", after).withColumn(
        "edited", F.concat(kept, F.substring(F.coalesce("after", F.lit("")), F.lit(1), half))).drop("after")


def compare_with_edit(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_chars, edited_sha256``, the fingerprints ``text_fp``, ``edited_fp`` and that of the next
    document, ``next_fp``.  One shuffle of the texts, by bucket, serves windows and grouping."""
    pairs = (half_edited(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
             .withColumn("edited_sha256", F.sha2("edited", 256)))
    # Buckets are small: a task keeps the groups of some of them, more fall back to sorting.
    docs.sparkSession.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(2 * BUCKET))
    prints = fingerprint(pairs, ["text", "edited"], lexicon, ["bucket", *NEXT], ["n_chars", "edited_sha256"])
    following = F.lead("text_fp").over(Window.partitionBy("bucket").orderBy(*NEXT))
    return prints.withColumn("next_fp", following).where(~F.col("halo")).select(
        F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", "text_fp", "edited_fp", "next_fp")
