"""Ordered computations that stay spread out when one key holds a large share of the rows.

A window partitioned by project puts a whole project into one task. That is the right plan for ordinary
projects, so they keep it. Projects above ``HOT_ROWS`` are cut into ordered slices instead: each slice is
scanned on its own, one summary row per slice carries the running state forward, and the two are joined back.
Both ways give the same rows. All keys above the limit are sliced, however many; their list is a stored table, so
Spark knows its size and broadcasts it only if it is small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from landpulse.session import durable

HOT_ROWS = 1_000_000
ID_RANGES = 64
FEW_ROWS, MANY_ROWS = 25_000, 250_000
UNSORTED_TASKS, MOST_ROWS = 200, 5_000_000  # rows for up to 200 tasks are written straight to their files; for more, Spark gathers them in memory
SLICE = "__slice"


@dataclass(frozen=True)
class Scan:
    """One running value: over a whole key, and as local part + carried part when a key is sliced."""

    over: Callable[[WindowSpec], Column]
    summary: Callable[[Column], Column]
    carry: Callable[[Column, WindowSpec], Column]
    merge: Callable[[Column, Column, Column, Column], Column]


def _so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def running_sum(x: Column) -> Scan:
    return Scan(
        over=lambda w: F.sum(x).over(_so_far(w)),
        summary=lambda order: F.sum(x),
        carry=lambda s, w: F.sum(s).over(_before(w)),
        merge=lambda local, carried, first, last: F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0)),
    )


def running_count() -> Scan:
    return running_sum(F.lit(1).cast("bigint"))


def running_min(x: Column) -> Scan:
    return Scan(
        over=lambda w: F.min(x).over(_so_far(w)),
        summary=lambda order: F.min(x),
        carry=lambda s, w: F.min(s).over(_before(w)),
        merge=lambda local, carried, first, last: F.least(local, carried),
    )


def running_max(x: Column) -> Scan:
    return Scan(
        over=lambda w: F.max(x).over(_so_far(w)),
        summary=lambda order: F.max(x),
        carry=lambda s, w: F.max(s).over(_before(w)),
        merge=lambda local, carried, first, last: F.greatest(local, carried),
    )


def max_before(x: Column) -> Scan:
    return Scan(
        over=lambda w: F.max(x).over(_before(w)),
        summary=lambda order: F.max(x),
        carry=lambda s, w: F.max(s).over(_before(w)),
        merge=lambda local, carried, first, last: F.greatest(local, carried),
    )


def last_known_before(x: Column) -> Scan:
    """The latest non-null value of ``x`` on an earlier row."""
    return Scan(
        over=lambda w: F.last(x, ignorenulls=True).over(_before(w)),
        summary=lambda order: F.max_by(x, F.when(x.isNotNull(), order)),
        carry=lambda s, w: F.last(s, ignorenulls=True).over(_before(w)),
        merge=lambda local, carried, first, last: F.coalesce(local, carried),
    )


def previous(x: Column) -> Scan:
    return Scan(
        over=lambda w: F.lag(x).over(w),
        summary=lambda order: F.max_by(x, order),
        carry=lambda s, w: F.lag(s).over(w),
        merge=lambda local, carried, first, last: F.when(first, carried).otherwise(local),
    )


def following(x: Column) -> Scan:
    return Scan(
        over=lambda w: F.lead(x).over(w),
        summary=lambda order: F.min_by(x, order),
        carry=lambda s, w: F.lead(s).over(w),
        merge=lambda local, carried, first, last: F.when(last, carried).otherwise(local),
    )


Apply = Callable[[DataFrame, dict[str, Scan]], DataFrame]


def _sort_keys(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def _whole(key: list[str], order: list[str]) -> Apply:
    window = Window.partitionBy(*key).orderBy(*_sort_keys(order))
    return lambda df, scans: df.withColumns({name: scan.over(window) for name, scan in scans.items()})


def _sliced(key: list[str], order: list[str]) -> Apply:
    inside = Window.partitionBy(*key, SLICE).orderBy(*_sort_keys(order))
    across = Window.partitionBy(*key).orderBy(SLICE)
    position = F.struct(*[part for c in order for part in (F.col(c).isNull(), F.col(c))])

    def apply(df: DataFrame, scans: dict[str, Scan]) -> DataFrame:
        local = df.withColumns(
            {f"__local_{name}": scan.over(inside) for name, scan in scans.items()}
            | {"__first": F.lag(F.lit(1)).over(inside).isNull(), "__last": F.lead(F.lit(1)).over(inside).isNull()}
        )
        summaries = df.groupBy(*key, SLICE).agg(
            *[scan.summary(position).alias(f"__sum_{name}") for name, scan in scans.items()]
        )
        carried = summaries.select(
            *key, SLICE,
            *[scan.carry(F.col(f"__sum_{name}"), across).alias(f"__carry_{name}") for name, scan in scans.items()],
        )
        return match(local, carried, [*key, SLICE]).select(
            *[F.col(c) for c in df.columns],
            *[
                scan.merge(F.col(f"__local_{name}"), F.col(f"__carry_{name}"), F.col("__first"), F.col("__last")).alias(name)
                for name, scan in scans.items()
            ],
        )

    return apply


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Rows for work that is dear per row: a task for every ``FEW_ROWS`` rows while cores are idle, and never one above ``MANY_ROWS``.

    A table of few bytes would otherwise be read by one task however many models each row meets.
    """
    tasks = max(min(df.sparkSession.sparkContext.defaultParallelism, ceil(rows / FEW_ROWS)), ceil(rows / MANY_ROWS))
    return df.repartition(tasks) if tasks > 1 else df


def share(df: DataFrame, rows: int, jobs: int) -> DataFrame:
    """Fewer tasks for one of several ``jobs`` that run side by side and in many rounds: its part of the cores, none above ``MANY_ROWS``."""
    return df.coalesce(max(ceil(df.sparkSession.sparkContext.defaultParallelism / jobs), ceil(rows / MANY_ROWS)))


def bounded(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the same ``key`` in one task, of about ``MANY_ROWS`` rows up to ``UNSORTED_TASKS`` tasks and ``MOST_ROWS`` beyond.

    Aggregates and joins by the key then sort a task's rows only: a split of a well compressed table holds many more rows than its
    bytes tell, and adaptive execution merges shuffled ones by their compressed size too. Counts the rows first.
    """
    rows = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(cores, ceil(rows / FEW_ROWS)), min(UNSORTED_TASKS, ceil(rows / MANY_ROWS)), ceil(rows / MOST_ROWS), 1)
    return df.repartition(tasks, *key)


def match(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Join on ``key`` with null equal to null; the key columns are those of ``left``."""
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in key})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in key])
    return left.join(other, same, how).drop(*[f"__right_{k}" for k in key])


def hot_keys(df: DataFrame, key: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with ``hot_rows`` rows or more."""
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__rows"))
    return counted.filter(F.col("__rows") >= hot_rows).select(*key)


def date_id_slice(date: str, ident: str) -> Column:
    """Ordered slice of a hot key: its day, then the range of its ids between ``id_bounds``."""
    id_range = F.size(F.filter("__bounds", lambda b: b <= F.col(ident)))
    return F.coalesce(F.unix_date(F.col(date)), F.lit(10_000_000)).cast("bigint") * ID_RANGES + id_range


def id_bounds(ident: str) -> list[Column]:
    """Bounds of ``ID_RANGES`` ranges with about as many ids each, so that an outlying id does not stretch them."""
    return [F.percentile_approx(ident, [k / ID_RANGES for k in range(1, ID_RANGES)]).alias("__bounds")]


def scan_by_key(df: DataFrame, key: list[str], order: list[str], steps: Callable[[DataFrame, Apply], DataFrame],
                slice_of: Column, measures: list[Column] | None = None, hot_rows: int = HOT_ROWS, source: DataFrame | None = None) -> DataFrame:
    """Run ``steps`` on ordinary keys as plain windows and on hot keys slice by slice.

    ``steps(rows, apply)`` calls ``apply(rows, {column: scan})`` as often as it needs. ``slice_of`` must not
    decrease along ``order``; it may use ``measures``, which are computed per hot key. Rows are counted per key first;
    only if a key is hot are they tagged and stored, so the input is read twice at most.
    If ``df`` is dear to make, ``source`` may be a cheaper table with at least as many rows of each key: ``df`` is then made
    once, in the same pass as the windows if no key of ``source`` is hot.
    """
    if source is not None:
        if hot_keys(source, key, hot_rows).isEmpty():
            return steps(df, _whole(key, order))
        df = durable(df)
    hot = durable(hot_keys(df, key, hot_rows))
    if hot.isEmpty():
        return steps(df, _whole(key, order))
    tagged = durable(match(df, hot.withColumn("__hot", F.lit(True)), key, "left"))
    ordinary = steps(tagged.filter("__hot is null").drop("__hot"), _whole(key, order))
    heavy = tagged.filter("__hot").drop("__hot")
    if measures:
        heavy = match(heavy, heavy.groupBy(*key).agg(*measures), key)
    sliced = heavy.select(*[F.col(c) for c in df.columns], slice_of.alias(SLICE))
    return ordinary.unionByName(steps(sliced, _sliced(key, order)).drop(SLICE))


def lookup(df: DataFrame, facts: DataFrame, key: list[str], how: str = "left") -> DataFrame:
    """Join many rows to ``facts``, which has one row per key; adaptive execution splits the rows of a hot key."""
    return df.join(facts, key, how)


def prefix_sums(df: DataFrame, group: list[str], order: list[Column], weights: dict[str, Column]) -> DataFrame:
    """For each weight add ``<name>_before`` (its sum over rows sorted before this one) and ``<name>_total``.

    A total order without a single-task sort: rows are range-partitioned and written once (so the ranges stay the
    same however often they are read), each range is summed on its own, and the range totals give the offsets.
    Ranges follow (group, order), so there are at most partitions + groups range totals; groups must be few.
    Adaptive execution may merge neighbouring ranges, which keeps their order.
    """
    ranged = durable(df.repartitionByRange(*group, *order).withColumn(SLICE, F.spark_partition_id()))
    inside = Window.partitionBy(*group, SLICE).orderBy(*order)
    across, whole = Window.partitionBy(*group).orderBy(SLICE), Window.partitionBy(*group)
    sums = ranged.groupBy(*group, SLICE).agg(*[F.sum(w).alias(f"__{name}") for name, w in weights.items()])
    offsets = sums.select(
        *group, SLICE,
        *[F.coalesce(F.sum(f"__{name}").over(_before(across)), F.lit(0)).alias(f"__{name}_offset") for name in weights],
        *[F.sum(f"__{name}").over(whole).alias(f"{name}_total") for name in weights],
    )
    local = ranged.withColumns({f"__{name}_local": F.coalesce(F.sum(w).over(_before(inside)), F.lit(0)) for name, w in weights.items()})
    return local.join(F.broadcast(offsets), [*group, SLICE]).select(
        *df.columns,
        *[(F.col(f"__{name}_local") + F.col(f"__{name}_offset")).alias(f"{name}_before") for name in weights],
        *[f"{name}_total" for name in weights],
    )


def positions(df: DataFrame, group: list[str], order: list[Column], weight: Column | None = None) -> DataFrame:
    """``before`` and ``total``: rows (or weight) sorted before each row of its group, and in the whole group."""
    weight = F.lit(1).cast("bigint") if weight is None else weight
    return prefix_sums(df, group, order, {"w": weight}).withColumnsRenamed({"w_before": "before", "w_total": "total"})


def exact_quantiles(df: DataFrame, group: list[str], value: str, probabilities: list[float], weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: (group..., probability, quantile); ``weight`` repeats rows."""
    times = F.sum(weight) if weight else F.count(F.lit(1))
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(times.alias("__n"))
    ranked = positions(counted, group, [F.col(value).asc()], F.col("__n"))
    wanted = F.array(*[
        F.struct(F.lit(p).alias("probability"), ((F.col("total") - 1) * F.lit(p)).alias("at")) for p in probabilities
    ])
    inside = lambda at: (at >= F.col("before")) & (at < F.col("before") + F.col("__n"))
    hits = F.filter(wanted, lambda w: inside(F.floor(w["at"])) | inside(F.ceil(w["at"])))
    found = ranked.select(*group, value, "before", "__n", F.explode(hits).alias("w"))
    at = F.col("w.at")
    ends = found.groupBy(*group, F.col("w.probability").alias("probability"), at.alias("at")).agg(
        F.min(F.when(inside(F.floor(at)), F.col(value))).alias("low"),
        F.min(F.when(inside(F.ceil(at)), F.col(value))).alias("high"),
    )
    share = F.col("at") - F.floor("at")
    return ends.select(*group, "probability", (F.col("low") + (F.col("high") - F.col("low")) * share).alias("quantile"))
