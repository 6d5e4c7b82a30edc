"""Exact order statistics and quantiles of very large, very uneven groups.

``percentile`` and ``row_number`` put a whole group into one task.  Here a group
is cut into many value slots by a fixed monotone function, so that

1. one map-side-combined count per (group, slot) locates the slot that holds
   each wanted position, and
2. only the rows of those slots are regrouped by value and counted up to the
   position.

A wanted slot that still holds many rows of different values is cut again, into equal
steps between its own least and largest value, until few are left.  Nothing but slot
counts and the few rows of the wanted slots is shuffled, and repeated values are combined
before the shuffle, so neither a hot group, a hot value nor a narrow range of values lands in
one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import interpolate
from ..session import attach, materialize
from .sketches import sketch_quantiles, sketch_table

SLOTS_PER_OCTAVE = 256
SLOT_SCALE = 2.0**20
SLOT_LIMIT = 1e9
SLOT_ROWS = 100_000
STEPS = 65_536


def slot(value: Column) -> Column:
    """Bucket number that never decreases with ``value``.

    256 slots per factor of two (equal steps close to zero), the same for all groups, so
    no range has to be known first.
    """
    steps = F.log1p(F.abs(value) * SLOT_SCALE) * (SLOTS_PER_OCTAVE / 0.6931471805599453)
    size = F.floor(F.least(steps, F.lit(SLOT_LIMIT))).cast("bigint")
    return F.when(value < 0, -size).otherwise(size)


@dataclass(frozen=True)
class Position:
    """A 0-based position in a group's sorted values, as a function of group size."""

    name: str
    column: str
    at: str  # SQL over the group's size ``__n`` and its keys


def _quoted(names: list[str]) -> list[str]:
    return [f"`{c}`" for c in names]


def _over(total: str, keys: list[str], order: str | None = None) -> str:
    """SQL of a total per group, running up to a row if ``order`` is given."""
    by = f"partition by {', '.join(_quoted(keys))}" if keys else ""
    run = f"order by `{order}` rows between unbounded preceding and current row" if order else ""
    return f"{total} over ({by} {run})"


def _running(keys: list[str], order: str) -> Window:
    return (
        Window.partitionBy(*keys)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def running_count(runs: DataFrame, keys: list[str], value: str, count: str, name: str) -> DataFrame:
    """Add ``name``: how many rows of the group have a value up to this run's.

    ``runs`` holds one row per group and value.  They are sorted over the tasks by group and
    value, counted inside each task, and topped up with the totals of the tasks before, so
    no group is sorted in one task.  The sorted runs are written once.
    """
    ranged = runs.repartitionByRange(*keys, value).withColumn("__pid", F.spark_partition_id())
    ranged = materialize(ranged)
    totals = ranged.groupBy(*keys, "__pid").agg(F.sum(count).alias("__c"))
    past = F.sum("__c").over(_running(keys, "__pid")) - F.col("__c")
    totals = totals.select(*keys, "__pid", past.alias("__past"))
    inside = F.sum(count).over(_running([*keys, "__pid"], value))
    return (
        attach(ranged, totals, [*keys, "__pid"])
        .withColumn(name, F.col("__past") + inside)
        .drop("__pid", "__past")
    )


def select_positions(df: DataFrame, keys: list[str], positions: list[Position], kind: str = "double") -> DataFrame:
    """Values at the wanted positions.

    One row per group and position that exists: keys, ``position`` (its name),
    ``value``, ``n`` (group size) and ``run_offset`` (how many equal values come
    before the position).  Values are compared as ``kind``, double or bigint.
    """
    columns = sorted({p.column for p in positions})
    # Plans are written as SQL text here: one call to the JVM for each, not one for each part of it.
    each = [f"cast(`{c}` as {kind}) as `__{i}`" for i, c in enumerate(columns)]
    present = "__v is not null" + " and not isnan(__v)" * (kind == "double")
    values = [f"__{i}" for i in range(len(columns))]
    long = df.selectExpr(*_quoted(keys), *each).unpivot([F.col(k) for k in _quoted(keys)], values, "__m", "__v").where(present)
    long = long.withColumn("__slot", slot(F.col("__v").cast("double")))

    group = [*keys, "__m"]
    totals = [F.expr(x) for x in ("count(1) as __c", "min(__v) as __slot_lo", "max(__v) as __slot_hi")]
    wanted = " or ".join(f"(__m = '__{columns.index(p.column)}' and __upto - __c <= {p.at} and {p.at} < __upto)" for p in positions)
    large = f"__c > {SLOT_ROWS} and __slot_lo < __slot_hi"

    def kept(counts: DataFrame) -> DataFrame:
        shown = [*_quoted([*group, "__slot"]), "__upto - __c as __before", "__n", "__c", "__slot_lo", "__slot_hi"]
        return materialize(counts.where(wanted).selectExpr(*shown))

    counts = long.groupBy(*group, "__slot").agg(*totals)
    slots = kept(counts.selectExpr("*", _over("sum(__c)", group, "__slot") + " as __upto", _over("sum(__c)", group) + " as __n"))
    part = [*group, "__slot", "__before", "__n"]

    def near() -> DataFrame:
        # Most rows lie in slots that no group wants: a look at the slot's number alone tells, before the keys are compared.
        some = long.join(F.broadcast(slots.select("__slot").distinct()), "__slot", "left_semi")
        return attach(some, slots, [*group, "__slot"]).where("__v between __slot_lo and __slot_hi")

    half = (lambda c: f"{c} / 2") if kind == "double" else (lambda c: f"cast({c} as decimal(20,0))")  # no overflow
    at = f"cast(({half('__v')} - {half('__slot_lo')}) / ({half('__slot_hi')} - {half('__slot_lo')}) as double)"
    step = f"case when {large} then floor({at} * {STEPS}) else 0L end as __step"
    while slots.where(large).take(1):
        counts = near().groupBy(*part, F.expr(step)).agg(*totals)
        slots = kept(counts.selectExpr("*", f"__before + {_over('sum(__c)', part, '__step')} as __upto"))

    runs = near().groupBy(*part, "__v").agg(F.expr("count(1) as __c"))
    runs = runs.selectExpr("*", f"__before + {_over('sum(__c)', part, '__v')} as __upto")
    choices = ", ".join(
        f"named_struct('position', '{p.name}', 'm', '__{columns.index(p.column)}', 'k', cast({p.at} as bigint))" for p in positions
    )
    hits = f"filter(array({choices}), s -> s.m = __m and __upto - __c <= s.k and s.k < __upto)"
    found = runs.selectExpr(*_quoted(keys), f"explode({hits}) as __h", "__v", "__n", "__upto - __c as __first")
    return found.selectExpr(
        *_quoted(keys), "__h.position as position", "__v as value", "__n as n", "__h.k - __first as run_offset"
    )


def quantiles(
    df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], accuracy: int | None = None
) -> DataFrame:
    """Linear-interpolation quantiles per group.

    ``wanted`` maps output column -> (input column, probability).  NULL and NaN
    are left out.  Returns one row per group that has any value.  With ``accuracy`` they
    come from sketches of that size instead, in one scan.
    """
    if accuracy is not None:
        columns = sorted({c for c, _ in wanted.values()})
        found = sketch_quantiles(sketch_table(df, keys, columns, accuracy), keys, wanted)
        return found.dropna(how="all", subset=list(wanted))

    places = {name: f"(__n - 1) * double('{float(q)!r}')" for name, (_, q) in wanted.items()}
    positions = []
    for name, (column, _) in wanted.items():
        positions.append(Position(f"{name}|lo", column, f"floor({places[name]})"))
        positions.append(Position(f"{name}|hi", column, f"least(floor({places[name]}) + 1, __n - 1)"))
    found = select_positions(df, keys, positions)
    picked = [
        F.expr(f"max(case when position = '{name}|{end}' then {what} end) as `__{short}_{name}`")
        for name in wanted
        for end, what, short in (("lo", "value", "lo"), ("hi", "value", "hi"), ("lo", "n", "n"))
    ]
    wide = found.groupBy(*keys).agg(*picked)
    out = []
    for name, (_, q) in wanted.items():
        at = f"((`__n_{name}` - 1) * double('{float(q)!r}'))"
        out.append(interpolate(F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), F.expr(f"{at} - floor({at})")).alias(name))
    return wide.select(*keys, *out)
