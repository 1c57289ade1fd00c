"""Aggregate functions: plain, and weighted by validity intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeweave.functions.temporal import micros


def duration_us(start: Column, end: Column) -> Column:
    return micros(end) - micros(start)


def temporal_avg(value: Column, start: Column, end: Column) -> Column:
    """Mean weighted by interval length; rows without an interval weigh 1; null if the weights are zero."""
    weight = F.when(value.isNotNull(), F.coalesce(duration_us(start, end).cast("double"), F.lit(1.0)))
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def temporal_duration(start: Column, end: Column) -> Column:
    return F.coalesce(F.sum(duration_us(start, end)), F.lit(0))


AGGREGATES: dict[str, Callable[..., Column]] = {
    "approx_count_distinct": F.approx_count_distinct,
    "avg": F.avg,
    "collect": lambda x: F.array_sort(F.collect_list(x)),
    "count": F.count,
    "duration": temporal_duration,
    "max": F.max,
    "min": F.min,
    "percentile": lambda x, p: F.percentile(x, p),
    "stdev": F.stddev_samp,
    "sum": lambda x: F.coalesce(F.sum(x), F.lit(0)),
    "temporal_avg": temporal_avg,
    "temporal_count": F.count_distinct,
    "window_avg": F.avg,
    "window_count": F.count,
    "window_sum": lambda x: F.coalesce(F.sum(x), F.lit(0)),
}
