"""Text, number and aggregate expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITESPACE = " \t\n\r\f\v"
UNKNOWN = "Unknown"

MICRO = 1_000_000


def clean_code(c: Column) -> Column:
    """Item code: text without outer blanks, upper case."""
    return F.upper(F.btrim(c.cast("string"), F.lit(WHITESPACE)))


def clean_text(c: Column) -> Column:
    """Dimension text: outer blanks removed; missing and the text ``nan`` become Unknown."""
    t = F.btrim(c.cast("string"), F.lit(WHITESPACE))
    return F.when(t.isNull() | t.isin("nan", "NAN"), F.lit(UNKNOWN)).otherwise(t)


def to_number0(c: Column, dtype: T.DataType) -> Column:
    """Number, with 0 for missing, unreadable and non-finite input."""
    x = c.try_cast("double")
    if isinstance(dtype, T.StringType):
        # Java also reads '1d' and '1f' as numbers; data files do not mean that.
        x = F.when(~c.rlike(r"[dDfF]\s*$"), x)
    finite = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)
    return F.coalesce(finite, F.lit(0.0))


def number_or_zero(df: DataFrame, name: str) -> Column:
    """``to_number0`` of a column, or 0 when the frame does not have it."""
    if name not in df.columns:
        return F.lit(0.0)
    return to_number0(F.col(f"`{name}`"), df.schema[name].dataType)


def text_or_unknown(df: DataFrame, name: str) -> Column:
    """``clean_text`` of a column, or Unknown when the frame does not have it."""
    if name not in df.columns:
        return F.lit(UNKNOWN)
    return clean_text(F.col(f"`{name}`"))


def exact_sum(c: Column | str) -> Column:
    """Sum that does not depend on row order, partitioning or retried tasks.

    Whole parts, millionths and millionths of these are added as three BIGINT sums, which are exact, stay in
    generated code and take 24 bytes in the shuffle. Values are read to twelve decimals below a thousand, to nine
    below a million and to six beyond, which is as far as the fifteen digits of a double go. The group's total is put together in DECIMAL. A whole part beyond 2^63 raises instead of wrapping.
    """
    return exact_total(exact_parts(c))


def exact_parts(c: Column | str) -> list[Column]:
    """The three BIGINT numbers of a value whose sums ``exact_total`` puts together."""
    c = F.col(c) if isinstance(c, str) else c
    whole = F.floor(c)
    rest = (c - whole) * MICRO
    millionths = F.floor(rest)
    grain = F.when(F.abs(c) < 1e3, 1.0).when(F.abs(c) < 1e6, 1e3).otherwise(1e6)
    finest = (F.floor((rest - millionths) * MICRO / grain + 0.5) * grain).cast("bigint")
    return [whole, millionths, finest]


def exact_total(parts: list[Column]) -> Column:
    """``exact_sum`` out of the parts of the values, or out of sums of these."""
    whole, millionths, finest = (F.sum(part) for part in parts)
    fractions = millionths.cast("decimal(20,0)") * F.expr("0.000001BD") + finest.cast("decimal(20,0)") * F.expr("0.000000000001BD")
    return (whole.cast("decimal(38,12)") + fractions).cast("double")


def ratio0(a: Column, b: Column) -> Column:
    """a / b, with 0 where the quotient is not defined."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def add(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Add or replace columns given as SQL expressions. All of them see the columns of ``df``."""
    return df.withColumns({name: F.expr(text) for name, text in exprs.items()})


def side_by_side(parts: list[DataFrame]) -> DataFrame:
    """One-row frames put together into one row, by union and ``first`` instead of a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.first(F.col(c), ignorenulls=True).alias(c) for c in stacked.columns])


def hashed_uniform(seed: int, *keys: Column) -> Column:
    """Uniform number in [0, 1) that depends on the keys and the seed only: 32 bits of the MD5 of their texts."""
    text = F.concat_ws("|", *(k.cast("string") for k in keys), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def hashed_normal(seed: int, *keys: Column) -> Column:
    """Standard normal number (Box-Muller) that depends on the keys and the seed only."""
    u1 = hashed_uniform(seed, *keys, F.lit("radius"))
    u2 = hashed_uniform(seed, *keys, F.lit("angle"))
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1))
    return radius * F.cos(F.lit(6.283185307179586) * u2)
