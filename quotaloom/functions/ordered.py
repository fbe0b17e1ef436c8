"""Ordered operations that stay distributed when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_time(df: DataFrame, key: str, time: str, tie: str, out: str, carry: str | None = None) -> DataFrame:
    """Time of the following row of the same key; with ``carry``, a struct of its time and that column.

    A plain ``lead`` sorts a whole key in one task.  Here the window covers one
    key and hour; the last row of an hour takes the first time of the key's next
    active hour from a (key, hour) summary, so a hot key spreads over its hours.
    """
    slot = ["_slot_day", "_slot_hour"]
    seen = F.struct(time, carry) if carry else F.col(time)
    first = F.min_by(seen, F.struct(time, tie)) if carry else F.min(time)
    dated = df.withColumns({"_slot_day": F.to_date(time), "_slot_hour": F.hour(time)})
    within = Window.partitionBy(key, *slot).orderBy(time, tie)
    per_slot = dated.groupBy(key, *slot).agg(first.alias("_first"))
    following = per_slot.select(
        key, *slot, F.lead("_first").over(Window.partitionBy(key).orderBy(*slot)).alias("_next_slot_first")
    )
    return (
        dated.withColumn("_in_slot", F.lead(seen).over(within))
        .join(following, [key, *slot], "left")
        .withColumn(out, F.coalesce("_in_slot", "_next_slot_first"))
        .drop(*slot, "_in_slot", "_next_slot_first")
    )


def rank_from_counts(df: DataFrame, value: str, out: str, within: tuple[str, ...] = (), grain: Column | None = None) -> DataFrame:
    """``rank() over (partition by within order by value desc)`` without one big window.

    Rows are counted per coarse value band; a band's rank starts after all rows
    of higher bands, and rows are ranked exactly inside their band.  The only
    window over a whole ``within`` group runs on the per-band counts.
    """
    band = grain if grain is not None else F.floor(F.col(value))
    keys = [*within, "_band"]
    banded = df.withColumn("_band", band)
    counts = banded.groupBy(*keys).agg(F.count("*").alias("_n"))
    higher = Window.partitionBy(*within).orderBy(F.col("_band").desc_nulls_last())
    start = counts.select(
        *keys,
        F.coalesce(F.sum("_n").over(higher.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    inside = F.rank().over(Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last()))
    ranked = banded.withColumn("_inside", inside)
    start = start.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_before")
    on = None
    for k in keys:
        test = ranked[k].eqNullSafe(start[f"_k_{k}"])
        on = test if on is None else on & test
    return (
        ranked.join(start, on, "left")
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_band", "_inside", "_before", *[f"_k_{k}" for k in keys])
    )


def number_from_counts(df: DataFrame, order: list[Column], out: str, grain: Column) -> DataFrame:
    """Global ``row_number`` in the given (descending, unique) order without one global window.

    ``grain`` must fall as the order falls; it may be a struct of bands.  Only
    the per-band counts are numbered in one task.
    """
    banded = df.withColumn("_band", grain)
    start = banded.groupBy("_band").agg(F.count("*").alias("_n")).select(
        F.col("_band").alias("_start_band"),
        F.coalesce(
            F.sum("_n").over(Window.orderBy(F.col("_band").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    inside = F.row_number().over(Window.partitionBy("_band").orderBy(*order))
    numbered = banded.withColumn("_inside", inside)
    return (
        numbered.join(start, numbered["_band"].eqNullSafe(start["_start_band"]), "left")
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_band", "_inside", "_before", "_start_band")
    )


def totals_before(queries: DataFrame, events: DataFrame, key: str, query_day: str, event_day: str, values: dict[str, Column]) -> DataFrame:
    """``queries`` with, per name of ``values``, its sum over ``events`` of the same key on days before the query's.

    An as-of join whose time differs per row, split by month so that no window holds more than a calendar's rows
    of one key: events are summed per (key, day) and per (key, month); a key's running monthly totals give what
    lay before each query's month (one window per key over its months and the months it is asked about), and the
    at most 31 daily rows of the query's own month add the days before the query's day (an equality join on key
    and month).  A hot key is thus summed map-side and spread over its months.  Distinct (key, day) pairs are
    looked up once.  Sums are null where nothing came before, and for null keys or days.
    """
    names = list(values)
    month = lambda c: F.trunc(F.col(c), "month")
    daily = (
        events.where(F.col(key).isNotNull() & F.col(event_day).isNotNull())
        .groupBy(F.col(key).alias("_k"), F.to_date(event_day).alias("_d"))
        .agg(*[F.sum(v).alias(n) for n, v in values.items()])
        .withColumn("_m", month("_d"))
    )
    asked = queries.select(F.col(key).alias("_k"), F.to_date(query_day).alias("_q")).where("_k IS NOT NULL AND _q IS NOT NULL").distinct().withColumn("_m", month("_q"))
    upto = Window.partitionBy("_k").orderBy("_m", "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    monthly = daily.groupBy("_k", "_m").agg(*[F.sum(n).alias(n) for n in names])
    running = monthly.withColumn("_asked", F.lit(1)).select("_k", "_m", "_asked", *[F.sum(n).over(upto).alias(n) for n in names])
    months = asked.select("_k", "_m").distinct().select("_k", "_m", F.lit(0).alias("_asked"), *[F.lit(None).cast(running.schema[n].dataType).alias(n) for n in names])
    before_month = (
        running.unionByName(months)
        .select("_k", "_m", "_asked", *[F.last(n, ignorenulls=True).over(upto).alias(n) for n in names])
        .where("_asked = 0")
        .drop("_asked")
    )
    within = asked.join(daily, ["_k", "_m"]).where(F.col("_d") < F.col("_q")).groupBy("_k", "_q").agg(*[F.sum(n).alias("_w_" + n) for n in names])
    found = (
        asked.join(before_month, ["_k", "_m"], "left")
        .join(within, ["_k", "_q"], "left")
        .select(F.col("_k").alias(key), F.col("_q").alias("_asof_day"), *[F.when(F.col(n).isNotNull() | F.col("_w_" + n).isNotNull(), F.coalesce(n, F.lit(0)) + F.coalesce("_w_" + n, F.lit(0))).alias(n) for n in names])
    )
    return queries.withColumn("_asof_day", F.to_date(query_day)).join(found, [key, "_asof_day"], "left").drop("_asof_day")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], bands: int = 4096) -> DataFrame:
    """(keys, one column per name of ``probs``): the value of rank ceil(n * p) of each group, as ``quantile_disc``.

    Distributed selection in two passes, without a window over a whole group: rows are counted per (group, band)
    of ``bands`` equal bands between the group's least and largest value (map-side partial counts); running
    counts over a group's bands (at most ``bands`` rows) give the band that holds each wanted rank and the rank
    inside it; then only the rows of those bands are counted per distinct value and ranked.  Exact at every size:
    the second pass holds one band's distinct values, not the group's.  Ranks use p as the exact decimal it
    prints as.  Null values are ignored; a group without values has no row.
    """
    from fractions import Fraction

    rows = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    stats = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = []
    for name, p in probs.items():
        f = Fraction(str(p))
        rank = F.greatest(F.lit(1), F.floor((F.col("_n") * f.numerator + (f.denominator - 1)) / f.denominator)).cast("long")
        wanted.append(F.struct(F.lit(name).alias("_name"), rank.alias("_r")))
    targets = stats.select(*keys, F.inline(F.array(*wanted)))
    lo, hi = F.col("_lo").cast("double"), F.col("_hi").cast("double")
    band = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((F.col("_v").cast("double") - lo) / ((hi - lo) / bands)), F.lit(bands - 1))).cast("int")
    placed = rows.join(stats.select(*keys, "_lo", "_hi"), keys).withColumn("_b", band).drop("_lo", "_hi")
    counted = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = counted.withColumn("_upto", upto)
    chosen = targets.join(running, keys).where((F.col("_upto") - F.col("_c") < F.col("_r")) & (F.col("_r") <= F.col("_upto"))).select(
        *keys, "_name", "_b", (F.col("_r") - (F.col("_upto") - F.col("_c"))).alias("_rr")
    )
    values = placed.join(chosen.select(*keys, "_b").distinct(), [*keys, "_b"]).groupBy(*keys, "_b", "_v").agg(F.count("*").alias("_c"))
    ranked = values.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = chosen.join(ranked, [*keys, "_b"]).where((F.col("_upto") - F.col("_c") < F.col("_rr")) & (F.col("_rr") <= F.col("_upto")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in probs])
