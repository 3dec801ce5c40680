"""Scalar column expressions shared by the operators.

All of them are built-in Catalyst expressions, so they stay inside whole-stage codegen; there is no
Python UDF anywhere in the package.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text accepted as a number: optional sign, digits with an optional fraction (or a bare fraction),
# optional exponent, or infinity / nan in any case.  Spark's own cast would also take "1.0d" or "1f"; this guard
# keeps those out.
NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*)|(\.\d+))(e[+-]?\d+)?\s*$|^\s*[+-]?(inf|infinity|nan)\s*$"

# Cell texts that stand for a missing value, compared as they are.
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                  "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Date text is rewritten to the ISO form and cast once.  First layout that fits:
#   year first, with "-", "/" or "." between the fields, or none (yyyyMMdd);
#   day first, where the first number cannot be a month; month first otherwise;
#   named month, "4 Feb 2025" or "February 4, 2025".
# Then an optional time h:m[:s[.fraction]] with AM or PM, and an optional zone, which is converted to UTC.
_BETWEEN = r"[/.\-]"
DATE_LAYOUTS = [
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?!\d)", "$1-$2-$3"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (rf"^(1[3-9]|2\d|3[01]){_BETWEEN}(\d{{1,2}}){_BETWEEN}(\d{{4}})(?!\d)", "$3-$2-$1"),
    (rf"^(\d{{1,2}}){_BETWEEN}(\d{{1,2}}){_BETWEEN}(\d{{4}})(?!\d)", "$3-$1-$2"),
]
_MONTH = (r"(?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
          r"(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?)")
NAMED_LAYOUTS = [
    (rf"^(\d{{1,2}})[ \-]{_MONTH}\.?,?[ \-](\d{{4}})(?!\d)", "$3-$2-$1"),
    (rf"^{_MONTH}\.? (\d{{1,2}}),? (\d{{4}})(?!\d)", "$3-$1-$2"),
]
_TIME = r"[ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?"
ISO_DATE_PATTERN = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}({_TIME})?$"
ZONED_PATTERN = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}{_TIME} ?(Z|UTC|[+-]\d{{2}}:?\d{{2}})$"
HALF_DAY_PATTERN = rf"^(\d{{4}}-\d{{1,2}}-\d{{1,2}}[ T])(0?[1-9]|1[0-2])(:\d{{1,2}}(?::\d{{1,2}}(?:\.\d{{1,9}})?)?) ?[AaPp][Mm]"


def c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_blank(col: str | Column) -> Column:
    """Python truthiness of an optional string: null and "" are blank."""
    col = c(col)
    return col.isNull() | (col == F.lit(""))


def is_sample(order_type: str | Column, marker: str) -> Column:
    """Sample classification: the type contains the marker; a null type is not a sample."""
    return F.coalesce(F.contains(c(order_type).cast("string"), F.lit(marker)), F.lit(False))


def in_types(order_type: str | Column, types: Sequence[str]) -> Column:
    """Route membership; a null type belongs to no route."""
    return F.coalesce(c(order_type).isin(list(types)), F.lit(False))


def percent_text(ratio: str | Column) -> Column:
    """``"50.00%"``: the ratio times 100, rounded half-even to two places."""
    return F.format_string("%.2f%%", F.bround(c(ratio) * F.lit(100.0), 2))


def whole_days(start: str | Column, end: str | Column) -> Column:
    """Whole 24-hour periods from ``start`` to ``end`` (not calendar-day boundaries)."""
    return F.timestamp_diff("DAY", c(start), c(end))


def bin_index(value: str | Column, edges: Sequence[float]) -> Column:
    """Index of the (edges[i], edges[i+1]] bin holding ``value``; null when in none."""
    value = c(value)
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = value > F.lit(float(lo))
        if hi != float("inf"):
            cond = cond & (value <= F.lit(float(hi)))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def to_double(col: str | Column) -> Column:
    """Numeric text to double; anything else to null.  Doubles pass through, NaN becomes null."""
    col = c(col)
    text = col.cast("string")
    parsed = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    return F.nanvl(parsed, F.lit(None).cast("double"))


def to_int_or_zero(col: str | Column) -> Column:
    """Number text to int, truncated toward zero; null, bad text, infinity or overflow to 0."""
    d = to_double(col)
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    return F.coalesce(F.when(finite, d.try_cast("int")), F.lit(0))


def missing_to_null(col: str | Column) -> Column:
    """Text that stands for a missing value becomes null."""
    col = c(col)
    return F.when(~col.isin(*MISSING_TOKENS), col)


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _iso_text(text: Column) -> Column:
    """Date text of any known layout with its date in the ISO form; other text as it is."""
    numeric = named = text
    for pattern, to in DATE_LAYOUTS:
        numeric = F.regexp_replace(numeric, pattern, to)
    for pattern, to in NAMED_LAYOUTS:
        named = F.regexp_replace(named, pattern, to)

    def numbered(named: Column) -> Column:
        month = F.lower(F.regexp_extract(named, r"^\d{4}-([A-Za-z]{3})-", 1))
        number = ((F.position(month, F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3).cast("int").cast("string")
        return F.when(month == "", named).otherwise(F.regexp_replace(
            named, F.lit(r"^(\d{4})-[A-Za-z]{3}-"), F.concat(F.lit("$1-"), number, F.lit("-"))))

    def whole_day(iso: Column) -> Column:
        hour = F.regexp_extract(iso, HALF_DAY_PATTERN, 2).try_cast("int") % 12 + F.when(iso.rlike(r"[Pp][Mm]"), 12).otherwise(0)
        return F.when(iso.rlike(HALF_DAY_PATTERN), F.regexp_replace(iso, F.lit(HALF_DAY_PATTERN), F.concat(
            F.lit("$1"), F.lpad(hour.cast("string"), 2, "0"), F.lit("$3")))).otherwise(iso)

    # A letter that begins a month's name ("UTC" has none), and the last letter of AM and PM.
    iso = F.when(text.rlike(r"[A-Sa-s][A-Za-z]{2}"), once(named, numbered)).otherwise(numeric)
    return F.when(text.rlike(r"[AaPp][Mm]\b"), once(iso, whole_day)).otherwise(iso)


def to_timestamp_ntz(col: str | Column) -> Column:
    """Date text to ``timestamp_ntz``; text that is not a date (or an impossible one) becomes null.

    Text is rewritten layout by layout and cast once behind a pattern test, so bad text never reaches the
    parser: no per-format attempts, no exception per failed row.  Only text that is not in the ISO form
    already goes through the rewriting.
    """

    def cast(iso: Column) -> Column:
        # For the cast, an offset needs its colon and the time its seconds.
        zoned = F.regexp_replace(F.regexp_replace(iso, r" ?UTC$", "Z"), r" ?([+-]\d{2}):?(\d{2})$", "$1:$2")
        zoned = F.regexp_replace(zoned, r"([ T]\d{1,2}:\d{1,2}) ?([Z+-])", "$1:00$2")
        return F.when(iso.rlike(ISO_DATE_PATTERN), iso.try_cast("timestamp_ntz")).when(
            iso.rlike(ZONED_PATTERN), zoned.try_cast("timestamp").cast("timestamp_ntz"))

    text = F.trim(c(col).cast("string"))
    plain = text
    for pattern, to in DATE_LAYOUTS[:2]:  # year first: the common case, without further layouts
        plain = F.regexp_replace(plain, pattern, to)
    return F.when(plain.rlike(ISO_DATE_PATTERN), plain.try_cast("timestamp_ntz")).otherwise(once(_iso_text(text), cast))


def as_timestamp_ntz(col: str | Column, data_type: T.DataType) -> Column:
    """Typed date column as ``timestamp_ntz``: text is parsed, timestamps and dates are cast."""
    if isinstance(data_type, T.StringType):
        return to_timestamp_ntz(col)
    return c(col).cast("timestamp_ntz")


def as_double(col: str | Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return to_double(col)
    return F.nanvl(c(col).cast("double"), F.lit(None).cast("double"))
