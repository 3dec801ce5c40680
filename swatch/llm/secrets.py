"""Secret spans, and weak candidates linked by proximity.  DataFrame functions only.

Base kinds (``assign``, ``access``, ``hex``) stand by themselves.  Weak kinds (``ident``: a named
access identifier, ``key``: a bare 40 character token, ``endpoint``: a service address) are reported only when
complementary parts lie in the same scope, at most ``scope`` code points between the end of one and the start of the other: an ``ident`` needs a
secret, a ``key`` an identifier, an ``endpoint`` both.  A base ``access`` is an identifier; the other
base kinds are secrets.

The interval join of parts within a scope is an ordered sweep: per document, parts sorted by start, and per role
the furthest end of the parts up to here and the first start from here on, which tell whether a partner
is in the scope.  It is linear in the parts; no pairs are made.
Only parts are shuffled, never text.

Positions are code points, ends exclusive.  Null and empty texts have no parts; a row of the input
gives a row of the output, also when ids repeat (rows are told apart by a row key, not by id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = 300

# The base patterns, the group that must have the least length, and that length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the longest runs, of which shorter ones fail anyway
# Weak parts.
IDENT = (r"""(?i:access_?key_?id|access_?key|client_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?"""
         r"""[A-Za-z0-9@._+-]{3,}""")
KEY = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
ENDPOINT = r"""(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20"'<>]+"""

# name, order, pattern, group that is measured, least length, is a secret, is an identifier
KINDS = [
    ("assign", 0, ASSIGN, 2, 8, 1, 0),
    ("access", 1, ACCESS, 0, 16, 0, 1),
    ("hex", 2, HEX, 0, 32, 1, 0),
    ("ident", 3, IDENT, 0, 0, 0, 1),
    ("key", 4, KEY, 0, 0, 1, 0),
    ("endpoint", 5, ENDPOINT, 0, 0, 0, 0),
]
BASE = ("assign", "access", "hex")


def _parts(text: Column, order: int, pattern: str, group: int, least: int, given: Column) -> Column:
    """Matches of one kind in order: (kind, nth, characters before it since the last one, length, kept)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.transform(
        F.arrays_zip(whole.alias("m"), measured.alias("v"), F.split(text, pattern, -1).alias("gap")),
        lambda x, i: F.struct(F.lit(order).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("gap"),
                              F.length(x["m"]).alias("size"), (F.length(x["v"]) >= least).alias("kept")))
    # The text after the last match comes as one more gap without a match.
    rows = F.filter(rows, lambda x: x["size"].isNotNull())
    return F.when(given, rows).otherwise(F.filter(rows, lambda x: F.lit(False)))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: ``id_col`` and ``parts``, an array of ``struct<start, kind_no, kind, end>`` sorted by start
    and kind, of all base spans and all linked weak ones."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Tests that cost little and hold wherever the pattern can match.
    given = {
        "assign": text.rlike(r"(?i:password|passwd|secret|token|api_?key)"), "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike(r"[0-9a-f]{32}"), "ident": text.rlike(r"(?i:access_?key|client_?id|account|user|login)"),
        "key": text.rlike(r"[A-Za-z0-9+/]{40}"), "endpoint": F.contains(text, F.lit("://")),
    }
    slim = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias(id_col),
                       docs[text_col].alias("text"))
    every = F.concat(*[_parts(text, no, pattern, group, least, given[name])
                       for name, no, pattern, group, least, *_ in KINDS])
    found = (slim.select("row", id_col, every.alias("part"))
             .select("row", id_col, F.explode_outer("part").alias("part"))
             .select("row", id_col, "part.*")
             .repartition("row"))
    # Where a match ends: the characters of the gaps and matches of its kind so far.
    own = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = (found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(own))
              .withColumn("start", F.col("end") - F.col("size"))
              .withColumn("kind", F.when(F.col("kept"), F.col("kind"))))  # a failing match is no part
    roles = {"secret": [k[1] for k in KINDS if k[5]], "identifier": [k[1] for k in KINDS if k[6]]}
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    near = placed
    for role, nos in roles.items():
        of_role = lambda col: F.when(F.col("kind").isin(nos), F.col(col))  # noqa: B023, E731
        near = near.withColumn(role, F.coalesce(F.max(of_role("end")).over(before) >= F.col("start") - scope, F.lit(False))
                               | F.coalesce(F.min(of_role("start")).over(after) <= F.col("end") + scope, F.lit(False)))
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind") + 1)
    named = near.withColumn("name", name)
    reported = (F.col("name").isin(*BASE)
                | ((F.col("name") == "ident") & F.col("secret"))
                | ((F.col("name") == "key") & F.col("identifier"))
                | ((F.col("name") == "endpoint") & F.col("secret") & F.col("identifier")))
    part = F.struct(F.col("start").cast("long").alias("start"), F.col("kind").alias("kind_no"),
                    F.col("name").alias("kind"), F.col("end").cast("long").alias("end"))
    return (named.groupBy("row", id_col)
            .agg(F.array_sort(F.collect_list(F.when(reported, part))).alias("parts"))
            .select(id_col, "parts"))


def spell(parts: Column) -> Column:
    """``kind:start:end`` of each part, comma-joined."""
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",")
