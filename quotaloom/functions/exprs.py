"""Column helpers: ladders, exact sums, guarded ratios, one-row lookups.

Everything returns a JVM-side ``Column`` so that whole-stage codegen is kept.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str
LIMB = 1_000_000


def c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def cases(pairs: Iterable[tuple[Column, object]], otherwise=None) -> Column:
    """First matching predicate wins; null predicates do not match."""
    chain = None
    for test, value in pairs:
        chain = F.when(test, _value(value)) if chain is None else chain.when(test, _value(value))
    return chain.otherwise(_value(otherwise))


def at_most(x: ColumnLike, steps, beyond) -> Column:
    """``steps`` = ((bound, value), ...) in rising order, compared with <=."""
    return cases(((c(x) <= b, v) for b, v in steps), beyond)


def at_least(x: ColumnLike, steps, under) -> Column:
    """``steps`` = ((bound, value), ...) in falling order, compared with >=."""
    return cases(((c(x) >= b, v) for b, v in steps), under)


def under(x: ColumnLike, steps, rest) -> Column:
    return cases(((c(x) < b, v) for b, v in steps), rest)


def over(x: ColumnLike, steps, rest) -> Column:
    return cases(((c(x) > b, v) for b, v in steps), rest)


def by_value(x: ColumnLike, table: Mapping, rest=None) -> Column:
    return cases(((c(x) == k, v) for k, v in table.items()), rest)


def yes(flag: ColumnLike) -> Column:
    """A nullable flag read as false when unknown."""
    return F.coalesce(c(flag), F.lit(False))


def nvl(x: ColumnLike, default) -> Column:
    return F.coalesce(c(x), _value(default))


def tally(test: ColumnLike) -> Column:
    """Number of rows for which the predicate holds (bigint, 0 on empty input)."""
    return F.count_if(c(test))


def exact_sum(x: ColumnLike, digits: int = 2, where: Column | None = None) -> Column:
    """Order-independent sum of a fixed-point double; 0 when nothing matches.

    Summing scaled bigints gives the same bits whatever the partitioning or
    task retries, which a plain double sum does not.  The sum is kept in two
    limbs so that it cannot overflow on large tables.
    """
    return F.coalesce(_limbs(_scaled(x, digits, where)), F.lit(0.0)) / F.lit(float(10**digits))


def _fixed(x: ColumnLike, digits: int) -> Column:
    return F.round(c(x) * (10**digits)).cast("bigint").cast("decimal(38,0)")


def exact_stddev(x: ColumnLike, digits: int = 4) -> Column:
    """Sample standard deviation of ``x`` in fixed point (``digits`` decimals), the same bits under any partitioning.

    n, the sum and the sum of squares of s = round(x * 10**digits) are whole numbers summed exactly (decimal(38,0),
    an overflow raises), so n*sum(s^2) - sum(s)^2 is exact; one division, a square root and the scale follow in
    double.  Null below two values.
    """
    s = _fixed(x, digits)
    n = F.count(s)
    spread = n.cast("decimal(38,0)") * F.sum(s * s) - F.sum(s) * F.sum(s)
    return F.when(n > 1, F.sqrt(spread.cast("double") / (n * (n - 1)).cast("double")) / float(10**digits))


def exact_corr(y: ColumnLike, x: ColumnLike, y_digits: int = 0, x_digits: int = 2) -> Column:
    """Pearson correlation from exact fixed-point sums, products and squares of the rows where both are present;
    null when either side does not vary.  The same bits under any partitioning."""
    both = c(x).isNotNull() & c(y).isNotNull()
    a, b = F.when(both, _fixed(x, x_digits)), F.when(both, _fixed(y, y_digits))
    n = F.count(a).cast("decimal(38,0)")
    sxy = n * F.sum(a * b) - F.sum(a) * F.sum(b)
    sxx = n * F.sum(a * a) - F.sum(a) * F.sum(a)
    syy = n * F.sum(b * b) - F.sum(b) * F.sum(b)
    return F.when((sxx > 0) & (syy > 0), sxy.cast("double") / F.sqrt(sxx.cast("double") * syy.cast("double")))


def _scaled(x: ColumnLike, digits: int, where: Column | None) -> Column:
    scaled = F.round(c(x) * (10**digits)).cast("bigint")
    return scaled if where is None else F.when(where, scaled)


def _limbs(scaled: Column) -> Column:
    """Sum of bigints as a double, of sums of their upper and lower parts; null of nothing."""
    low = F.pmod(scaled, F.lit(LIMB))
    high = F.sum(F.round((scaled - low) / LIMB).cast("bigint")).cast("double")
    return high * float(LIMB) + F.sum(low).cast("double")


def exact_avg(x: ColumnLike, digits: int = 2, where: Column | None = None) -> Column:
    scaled = _scaled(x, digits, where)
    return F.try_divide(_limbs(scaled), F.count(scaled)) / F.lit(float(10**digits))


def ratio(num: ColumnLike, den: ColumnLike, scale: float | None = None, digits: int | None = None, empty=None) -> Column:
    """num / den * scale; ``empty`` when the denominator is null or not positive."""
    q = c(num) / c(den)
    if scale is not None:
        q = q * F.lit(float(scale))
    if digits is not None:
        q = F.round(q, digits)
    return F.when(c(den) > 0, q).otherwise(F.lit(empty).cast("double"))


def day(as_of: dt.date) -> Column:
    return F.lit(as_of)


def age_days(as_of: dt.date, x: ColumnLike) -> Column:
    """Days from ``x`` to the evaluation date."""
    return F.datediff(F.lit(as_of), c(x))


def days_ahead(as_of: dt.date, x: ColumnLike) -> Column:
    return F.datediff(c(x), F.lit(as_of))


def quarter_label(x: ColumnLike) -> Column:
    return F.concat(F.lit("Q"), F.quarter(c(x)).cast("string"), F.lit(" "), F.year(c(x)).cast("string"))


def quarter_bounds(as_of: dt.date) -> tuple[dt.date, dt.date]:
    first = dt.date(as_of.year, 3 * ((as_of.month - 1) // 3) + 1, 1)
    nxt = dt.date(first.year + (first.month == 10), (first.month + 2) % 12 + 1, 1)
    return first, nxt - dt.timedelta(days=1)


def in_quarter(as_of: dt.date, x: ColumnLike) -> Column:
    return c(x).between(*[F.lit(d) for d in quarter_bounds(as_of)])


def present(*flags: Column) -> Column:
    """Array of the non-null entries; an empty array, never null."""
    return F.array_compact(F.array(*flags))


def row_of(df: DataFrame) -> Column:
    """A one-row DataFrame as a struct-valued scalar subquery (no join needed)."""
    return df.select(F.struct(*[F.col(n) for n in df.columns]).alias("r")).scalar()


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One row holding the columns of several one-row DataFrames."""
    spark = frames[0].sparkSession
    holder = spark.range(1).select(*[row_of(f).alias(f"r{i}") for i, f in enumerate(frames)])
    return holder.select(*[f"r{i}.*" for i in range(len(frames))])


def stack_rows(df: DataFrame, rows: list[Column], keep: list[str] = ()) -> DataFrame:
    """Emit one output row per non-null struct in ``rows`` for each input row."""
    return df.select(*keep, F.inline(F.array_compact(F.array(*rows))))
