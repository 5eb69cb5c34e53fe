"""Running sums and last values in the order of a long group, without the group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of the order that one stretch spans.
STRETCH = 4096


def scanned(rows: DataFrame, group: list[str], order: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, mins: dict[str, Column] | None = None, stretch: int | Column = STRETCH) -> DataFrame:
    """Adds what the rows of ``group`` before each row come to: for each name in ``sums`` the sum of its column, in ``lasts`` the last value that isn't null, in ``mins`` the least.

    ``order`` is a whole number, unique in its group. Groups are cut into stretches of so many places, or by a column that rises with the order; windows run
    inside a stretch, and one row a stretch carries what the stretches before it come to, so a group of any length is spread. Columns of
    ``group`` have no nulls.
    """
    sums, lasts, mins = sums or {}, lasts or {}, mins or {}
    names = [*sums, *lasts, *mins]
    rows = rows.withColumn("_stretch", F.floor(F.col(order) / stretch) if isinstance(stretch, int) else stretch)
    rows = rows.withColumns({f"_of_{n}": c for n, c in {**sums, **lasts, **mins}.items()})

    def over(prefix: str, window: Window) -> dict[str, Column]:
        return {**{n: F.sum(prefix + n).over(window) for n in sums}, **{n: F.last(prefix + n, True).over(window) for n in lasts}, **{n: F.min(prefix + n).over(window) for n in mins}}
    inside = Window.partitionBy(*group, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = {**{n: F.sum(f"_of_{n}") for n in sums}, **{n: F.max_by(f"_of_{n}", F.when(F.col(f"_of_{n}").isNotNull(), F.col(order))) for n in lasts}, **{n: F.min(f"_of_{n}") for n in mins}}
    totals = rows.groupBy(*group, "_stretch").agg(*[c.alias(f"_all_{n}") for n, c in whole.items()])
    carried = totals.select(*group, "_stretch", *[c.alias(f"_all_{n}") for n, c in over("_all_", before).items()])
    rows = rows.withColumns({f"_in_{n}": c for n, c in over("_of_", inside).items()}).join(carried, [*group, "_stretch"])
    rows = rows.withColumns({**{n: F.coalesce(f"_in_{n}", F.lit(0)) + F.coalesce(f"_all_{n}", F.lit(0)) for n in sums}, **{n: F.coalesce(f"_in_{n}", f"_all_{n}") for n in lasts}, **{n: F.least(f"_in_{n}", f"_all_{n}") for n in mins}})
    return rows.drop("_stretch", *[f"_{k}_{n}" for k in ("of", "in", "all") for n in names])
