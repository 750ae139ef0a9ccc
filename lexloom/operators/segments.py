"""Ordered scans over long groups: blocks, carries of blocks, and a local pass.

A group (a document's lines, a video's entries) is cut into blocks by a column ``_block`` that rises with the group's order.
Windows run inside blocks only; what a block hands on (a sum, the last value, its first rows) is one carry row a block, and
only carries are scanned over the whole group. So a group with a third of all rows is as many tasks as it has blocks.
Rows need a group; rows whose group is null don't belong to any and are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of numbered lines, at most.
BLOCK = 4096


def blocked(rows: DataFrame, pos: str = "pos", size: int | None = None) -> DataFrame:
    """``rows`` with _block from a position that counts rows of a group."""
    return rows.withColumn("_block", F.floor(F.col(pos) / F.lit(size or BLOCK)))


def _keys(by: list[str]) -> list[str]:
    return [*by, "_block"]


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """Running sums, and last values that aren't null, from the start of the group up to each row.

    ``sums`` are integer columns (null counts as 0), ``lasts`` any. ``rows`` has _block; within a group ``order`` tells rows apart.
    """
    sums, lasts = sums or {}, lasts or {}
    local = Window.partitionBy(*_keys(by)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(*order)
    carries = rows.groupBy(*_keys(by)).agg(
        *[F.sum(F.coalesce(c, F.lit(0))).alias(f"_c_{n}") for n, c in sums.items()],
        *[F.max_by(F.struct(c.alias("v")), F.when(c.isNotNull(), at)).alias(f"_c_{n}") for n, c in lasts.items()],
    )
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carries = carries.select(
        *_keys(by),
        *[F.coalesce(F.sum(f"_c_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.last(F.when(F.col(f"_c_{n}.v").isNotNull(), F.col(f"_c_{n}")), ignorenulls=True).over(before).alias(f"_b_{n}") for n in lasts],
    )
    inside = rows.withColumns({f"_l_{n}": F.sum(F.coalesce(c, F.lit(0))).over(local) for n, c in sums.items()} | {f"_l_{n}": F.last(c, ignorenulls=True).over(local) for n, c in lasts.items()})
    joined = inside.join(carries, _keys(by))
    out = {n: F.col(f"_l_{n}") + F.col(f"_b_{n}") for n in sums} | {n: F.coalesce(f"_l_{n}", f"_b_{n}.v") for n in lasts}
    return joined.withColumns(out).drop(*[f"_{p}_{n}" for n in (*sums, *lasts) for p in "lb"])


def ahead(rows: DataFrame, by: list[str], order: list[str], value: Column, n: int, name: str = "_ahead") -> DataFrame:
    """``rows`` with an array of struct(v): the values of the next ``n`` rows of the group (fewer at its end)."""
    keys, local = _keys(by), Window.partitionBy(*_keys(by)).orderBy(*order)
    inside = rows.withColumns({"_next": F.collect_list(F.struct(value.alias("v"))).over(local.rowsBetween(1, n)), "_rn": F.row_number().over(local)})
    first = F.array_sort(F.collect_list(F.when(F.col("_rn") <= n, F.struct("_rn", value.alias("v")))))  # n of a block at most
    carries = inside.groupBy(*keys).agg(F.transform(first, lambda x: F.struct(x["v"].alias("v"))).alias("_first"))
    blocks = Window.partitionBy(*by).orderBy("_block")  # every block has a row at least, so n blocks hold the next n rows
    later = F.flatten(F.array(*[F.coalesce(F.lead("_first", i).over(blocks), F.slice("_first", 1, 0)) for i in range(1, n + 1)]))
    joined = inside.join(carries.select(*keys, F.slice(later, 1, n).alias("_later")), keys)
    return joined.withColumn(name, F.slice(F.concat("_next", "_later"), 1, n)).drop("_next", "_later", "_rn")
