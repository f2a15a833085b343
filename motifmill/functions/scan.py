"""Running values along a sequence, without putting a whole sequence into one task.

A window ``partition by piece`` would hand a huge piece to a single task.  Here the sequence
is cut into blocks; the window runs per block, a one-row-per-block summary is scanned per
piece, and the carry is joined back on ``(piece, block)`` - the partitioning the rows already
have.  Only the summary, bounded by the number of blocks of a piece, is grouped by piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from motifmill.session import stage

TOKEN_BLOCK = 4096


def token_block(seq="seq") -> Column:
    return F.call_function("div", F.col(seq), F.lit(TOKEN_BLOCK)).alias("_block")


def ranked(df: DataFrame, column: str, name: str) -> DataFrame:
    """``(column, name)``: ranks from 0 in the order of ``column``.

    A range sort, ranks within each partition, and the partitions' sizes added up: no window
    over all rows.
    """
    ordered = stage(df.select(column).orderBy(column).withColumns({
        "_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ranked")
    parts = ordered.groupBy("_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    # One row per partition of the sort.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return ordered.join(F.broadcast(offsets), "_part").select(
        column, (F.col("_place") - F.col("_first") + F.col("_offset")).alias(name))


def running(df: DataFrame, key: list[str], order: list[str], block: Column,
            sums: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None,
            previous: dict[str, Column] | None = None,
            maxes: dict[str, Column] | None = None) -> DataFrame:
    """Add running columns to ``df``, in the given order within each key.

    ``sums`` (inclusive running sum), ``maxes`` (inclusive running maximum), ``lasts`` (latest
    non-null value, own row included) and ``previous`` (latest non-null value before the row).
    ``block`` must be non-decreasing along ``order``.
    """
    sums, lasts, previous, maxes = sums or {}, lasts or {}, previous or {}, maxes or {}
    base = df.withColumn("_block", block)
    group = [*key, "_block"]
    inside = Window.partitionBy(*group).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)

    local = base.withColumns({
        **{f"_l_{n}": F.sum(e).over(upto) for n, e in sums.items()},
        **{f"_l_{n}": F.max(e).over(upto) for n, e in maxes.items()},
        **{f"_l_{n}": F.last(e, True).over(upto) for n, e in lasts.items()},
        **{f"_l_{n}": F.last(e, True).over(before) for n, e in previous.items()},
    })
    # One number as the order keeps the summary a hash aggregate: its pass over the rows sorts nothing.
    position = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    latest = {**lasts, **previous}
    summary = base.groupBy(*group).agg(
        *[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()],
        *[F.max(e).alias(f"_t_{n}") for n, e in maxes.items()],
        *[F.max_by(e, F.when(e.isNotNull(), position)).alias(f"_t_{n}") for n, e in latest.items()],
    )
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *group,
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in maxes],
        *[F.last(f"_t_{n}", True).over(earlier).alias(f"_c_{n}") for n in latest],
    )
    done = local.join(carry, group)
    results = {
        **{n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.col(f"_c_{n}") for n in sums},
        **{n: F.greatest(f"_l_{n}", f"_c_{n}") for n in maxes},
        **{n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in latest},
    }
    return done.select(*df.columns, *[c.alias(n) for n, c in results.items()])
