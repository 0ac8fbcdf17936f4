"""Cleaning of raw identity and activity columns, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for "nothing", compared trimmed and lower-cased.
BLANK_TOKENS = ("", "-", "--", "na", "n/a", "null", "none")
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


#: White space of any script, as text columns from spreadsheets have it (tab, newline, no-break space and the like).
_SPACE = r"[\s\p{Z}\x1C-\x1F\x85]+"


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", "")


def is_blank(c: Column, tokens: Sequence[str] = BLANK_TOKENS) -> Column:
    return c.isNull() | F.lower(stripped(c)).isin(*tokens)


def unless_blank(c: Column, tokens: Sequence[str] = BLANK_TOKENS) -> Column:
    return F.when(~is_blank(c, tokens), c)


def number(c: Column) -> Column:
    """A text as double; null where it isn't a plain decimal number ("5d", "nan" and "inf" aren't)."""
    return F.when(stripped(c).rlike(_NUMBER), stripped(c).try_cast("double"))


def mobile(c: Column, length: int = 10, keep_last: int | None = 10) -> Column:
    """struct(id, digits, valid, issue) of a raw phone number: one trailing ".0" goes, then all but digits; more digits
    than `length` are cut to the last `keep_last`; other lengths are kept, but not valid."""
    digits = F.regexp_replace(F.regexp_replace(stripped(c), r"\.0$", ""), r"\P{Nd}", "")
    size = F.char_length(digits)
    blank, none, good = is_blank(c), size == 0, size == length
    long = (size > length) & F.lit(keep_last is not None)
    cut = F.right(digits, F.lit(keep_last or length))
    some = ~(blank | none)
    return F.struct(
        F.when(some & long, cut).when(some, digits).alias("id"),
        F.when(some, digits).alias("digits"),
        (some & (good | long)).alias("valid"),
        F.when(blank, "blank").when(none, "no_digits").when(good, "valid").when(long, f"trimmed_to_last_{keep_last}")
        .otherwise(F.concat(F.lit("invalid_length_"), size.cast("string"))).alias("issue"),
    )


def squeezed(c: Column) -> Column:
    """White space collapsed and trimmed; null if nothing is left or it is blank."""
    x = F.trim(F.regexp_replace(unless_blank(c), _SPACE, " "))
    return F.when(x != "", x)


def state(c: Column) -> Column:
    return F.upper(squeezed(c))


def none_if_blank(c: Column) -> Column:
    """Null where nothing stands, or "nan", as other programs write a missing value."""
    return F.when(~F.lower(c.cast("string")).isin("", "nan"), c)


def safe_number(c: Column) -> Column:
    """As double; null where it is no number or none at all (NaN)."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def truth(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def entity_id(mobile_id: Column, valid: Column, *lineage: Column) -> Column:
    """The mobile if valid, else INVALID:: and the row's lineage, so that invalid rows never merge."""
    return F.when(valid & mobile_id.isNotNull(), mobile_id).otherwise(F.concat_ws("::", F.lit("INVALID"), *(F.coalesce(x.cast("string"), F.lit("")) for x in lineage)))


def clean(raw: DataFrame, months: Sequence[str], length: int = 10) -> DataFrame:
    """Raw wide rows (State, Name, MobileNo1 and months, all text) cleaned, with mobile_* columns; months as double."""
    m = F.col("__mobile")
    return raw.withColumn("__mobile", mobile(F.col("MobileNo1"), length, length)).select(
        state(F.col("State")).alias("State"), squeezed(F.col("Name")).alias("Name"), unless_blank(F.col("MobileNo1")).alias("MobileNo1"),
        m.digits.alias("mobile_digits"), m.id.alias("mobile_id"), m.valid.alias("mobile_is_valid"), m.issue.alias("mobile_cleaning_issue"),
        *[c for c in raw.columns if c.startswith("source_")], *(number(unless_blank(F.col(c))).alias(c) for c in months),
    )


def counters(values: Sequence[str]) -> list[Column]:
    """Aggregates: rows, blanks, texts in these columns that are no numbers, and mobiles by outcome. Values of a row are
    added up before the sum, so that they may be observed too."""
    count = lambda c, name: F.count_if(c).alias(name)
    issue = mobile(F.col("MobileNo1")).issue
    odd = sum((F.when(~is_blank(F.col(f"`{c}`")) & number(F.col(f"`{c}`")).isNull(), 1).otherwise(0) for c in values), F.lit(0))
    return [
        F.count(F.lit(1)).alias("row_count"),
        *(count(is_blank(F.col(c)), f"blank_{c.lower()}") for c in ("State", "Name", "MobileNo1")),
        F.sum(odd).alias("not_numeric"),
        count(issue == "valid", "mobile_valid"), count(issue.startswith("trimmed"), "mobile_trimmed"),
        count(~(issue == "valid") & ~issue.startswith("trimmed"), "mobile_invalid"),
    ]


def quality(raw: DataFrame, months: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """`counters` of each group, in one pass."""
    return raw.groupBy(*by).agg(*counters(months))
