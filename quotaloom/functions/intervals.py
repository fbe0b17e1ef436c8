"""Interval (range) joins by time bins: an equality join on key and bin, then the exact condition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, *, end_inclusive: bool = False, how: str = "left") -> DataFrame:
    """Each row of ``points`` with every row of ``intervals`` of equal ``keys`` whose interval holds ``at``.

    An interval holds t when start <= t and t < end (t <= end with ``end_inclusive``); a null end is open; a null
    start holds nothing.  Each interval is dealt to the months it overlaps (an open one up to the last month of
    any point), each point to its month; rows meet by an equality join on keys and month, and the exact condition
    is part of the join, so the plan has no nested loop and a point meets only intervals of its own month.  The
    work per interval grows with its span in months, not with the data.  Both sides are shuffled and sorted unless
    ``intervals`` itself asks to be broadcast: the dealt rows outnumber the intervals by months, which the size
    estimate of a plan doesn't see, and would otherwise be collected by the driver.  ``how``: "left" keeps points that meet
    nothing, with nulls; "inner" drops them.  Interval columns other than the keys keep their names.
    """
    bin_of = lambda c: F.trunc(F.to_date(c), "month")
    last = points.agg(F.max(bin_of(at))).first()[0]
    last_bin = F.lit(last).cast("date")
    first, stop = bin_of(start), F.least(F.coalesce(bin_of(end), last_bin), last_bin)
    spans = intervals.where(F.col(start).isNotNull() & (first <= stop))
    dealt = spans.withColumn("_bin", F.explode(F.sequence(first, stop, F.expr("INTERVAL 1 MONTH")))).withColumnRenamed(start, "_iv_start").withColumnRenamed(end, "_iv_end")
    for k in keys:
        dealt = dealt.withColumnRenamed(k, "_iv_" + k)
    placed = points.withColumn("_bin", bin_of(at))
    t = F.col(at)
    holds = (t >= F.col("_iv_start")) & (F.col("_iv_end").isNull() | ((t <= F.col("_iv_end")) if end_inclusive else (t < F.col("_iv_end"))))
    cond = _and([F.col(k) == F.col("_iv_" + k) for k in keys] + [F.col("_bin") == F.col("_iv_bin"), holds])
    joined = placed.hint("merge").join(dealt.withColumnRenamed("_bin", "_iv_bin"), cond, how)
    return joined.drop("_bin", "_iv_bin", *("_iv_" + k for k in keys)).withColumnRenamed("_iv_start", start).withColumnRenamed("_iv_end", end)


def _and(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out
