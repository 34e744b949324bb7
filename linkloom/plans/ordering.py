"""Order-dependent work on groups of any size.

One site may hold a third of all rows. ``first_per`` and ``top_per`` are safe as
they are: Spark keeps at most k rows per group on the map side. Ranking a whole
group, or scanning it from the first row to the last, is done in slices, so no
task ever holds more than one slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.session import cut_lineage

SLICE = "_slice"


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each group in ``order``."""
    name = rank or "_rank"
    ranks = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = df.withColumn(name, ranks).filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per(df, keys, order, 1)


def ranked(df: DataFrame, keys: list[str], order: list[Column], rank: str) -> DataFrame:
    """Number the rows of every group 1..n in ``order``, a total order.

    Rows are split by range on (keys, order): a slice is a run of neighbours, so the
    rank is the place in the slice plus the size of the group's earlier slices. A
    group of any size is spread over as many slices as it fills.
    """
    # Written down, because range bounds are sampled anew on every run.
    sliced = cut_lineage(
        df.repartitionByRange(*keys, *order).withColumn(SLICE, F.spark_partition_id()), "ranked"
    )
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy(*keys, SLICE).count()
    offsets = sizes.withColumn("_before_slice", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    return (
        sliced.withColumn("_in_slice", F.row_number().over(inside))
        .join(offsets, [*keys, SLICE])
        .withColumn(rank, F.col("_in_slice") + F.col("_before_slice"))
        .drop("_in_slice", "_before_slice", SLICE)
    )


def next_ids(df: DataFrame, order: list[Column], taken: DataFrame, name: str = "id") -> DataFrame:
    """Give the rows of ``df`` the ids after the greatest ``id`` of ``taken``, in ``order``.

    The numbers are dense, so they never collide, and the same rows get the same ones.
    """
    start = taken.agg(F.max("id")).first()[0] or 0
    return ranked(df, [], order, "_number").withColumn(name, (F.col("_number") + start).cast("bigint")).drop("_number")


def time_slice(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    slice_by: Column,
    sums: dict[str, Column],
    marks: dict[str, tuple[Column, str]] | None = None,
    latest: dict[str, Column] | None = None,
    first: dict[str, Column] | None = None,
) -> DataFrame:
    """Running values per group, this row included, computed slice by slice.

    ``slice_by`` must never decrease along ``order``.

    sums    name -> term added up
    marks   name -> (condition, sum): the sum as it stood at the last row that met the condition
    latest  name -> value that never decreases; NULLs are skipped
    first   name -> value whose minimum so far is kept

    Each slice is scanned by itself; its totals are combined along the group
    (one row per slice) and joined back on (keys, slice).
    """
    marks, latest, first = marks or {}, latest or {}, first or {}
    sliced = df.withColumn(SLICE, slice_by)
    scan = (
        Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = sliced.withColumns(
        {n: F.sum(c).over(scan) for n, c in sums.items()}
        | {n: F.max(c).over(scan) for n, c in latest.items()}
        | {n: F.min(c).over(scan) for n, c in first.items()}
    )
    local = local.withColumns(
        {n: F.max(F.when(cond, F.col(total))).over(scan) for n, (cond, total) in marks.items()}
    )
    upper = [*sums, *latest, *marks]
    totals = local.groupBy(*keys, SLICE).agg(
        *[F.max(n).alias(f"_{n}") for n in upper], *[F.min(n).alias(f"_{n}") for n in first]
    )
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumns({f"_{n}_in": F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)) for n in sums})
    carry = carry.withColumns(
        {f"_{n}_in": F.max(f"_{n}").over(before) for n in latest}
        | {f"_{n}_in": F.min(f"_{n}").over(before) for n in first}
        | {
            f"_{n}_in": F.max(F.col(f"_{n}") + F.col(f"_{total}_in")).over(before)
            for n, (_, total) in marks.items()
        }
    ).select(*keys, SLICE, *[f"_{n}_in" for n in (*upper, *first)])
    # A left join adds no filter, so both uses of the scan share one shuffle.
    joined = local.join(carry, [*keys, SLICE], "left")
    whole = (
        {n: F.coalesce(F.col(n) + F.col(f"_{total}_in"), F.col(f"_{n}_in")) for n, (_, total) in marks.items()}
        | {n: F.col(n) + F.col(f"_{n}_in") for n in sums}
        | {n: F.greatest(n, f"_{n}_in") for n in latest}
        | {n: F.least(n, f"_{n}_in") for n in first}
    )
    return joined.withColumns(whole).drop(SLICE, *[f"_{n}_in" for n in (*upper, *first)])
