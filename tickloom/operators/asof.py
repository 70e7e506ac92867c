"""As-of lookups over integers without a window that grows with one key's rows.

Numbers are cut into digits to the base ``FANOUT``. A window looks for the neighbour within one lowest node only; where there is
none, the answer comes from the nearest node beside it, found in the same way one level up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FANOUT = 4096


def nearest(df: DataFrame, keys: list[str], number: str, value: str, out: str, after: bool = True, levels: int = 3, unit: int = 1) -> DataFrame:
    """Adds ``out``: the ``value`` of the nearest row beyond ``number`` (after or before it) whose value isn't null.

    ``value`` is null for rows that only ask, else a struct beginning with the number, or the number itself. Rows with the same
    number are in no defined order, so of rows that ask and answer at one number, make the number unique first."""
    nodes = [f"_node{i}" for i in range(1, levels + 1)]
    for i, name in enumerate(nodes):
        df = df.withColumn(name, F.expr(f"floor({nodes[i - 1]} / {FANOUT}L)" if i else f"floor({number} / {FANOUT * unit}L)"))
    pick = F.min if after else F.max

    def beside(rows: DataFrame, by: list[str], order: str) -> DataFrame:
        # From the far end on, so that the frame only grows: a frame that shrinks is computed anew for each row.
        far_first = F.col(order).desc() if after else F.col(order).asc()
        return rows.withColumn("_beside", F.last("_value", ignorenulls=True).over(Window.partitionBy(*by).orderBy(far_first).rowsBetween(Window.unboundedPreceding, -1)))

    level, heads = df.select(*keys, *nodes, F.col(value).alias("_value")), []
    for i in range(levels):
        level = level.groupBy(*keys, *nodes[i:]).agg(pick("_value").alias("_value"))
        heads.append(level)
    done = beside(heads[-1], keys, nodes[-1]).select(*keys, nodes[-1], F.col("_beside").alias("_far"))
    for i in range(levels - 2, -1, -1):
        on = [*keys, nodes[i + 1]]
        done = beside(heads[i], on, nodes[i]).join(done, on, "left").select(*keys, nodes[i], F.coalesce("_beside", "_far").alias("_far"))
    on = [*keys, nodes[0]]
    rows = beside(df.withColumn("_value", F.col(value)), on, number).join(done, on, "left")
    return rows.withColumn(out, F.coalesce("_beside", "_far")).drop("_beside", "_far", "_value", *nodes)
