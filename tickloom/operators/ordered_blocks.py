"""Order-dependent work in blocks of equal size, whatever the keys' shares of the data.

Rows are range-partitioned by the full order, written once, and numbered from 0 without a gap. Consecutive blocks of the numbers
then hold the same number of rows each, plus copies of the ``halo`` rows before and after, so one key's rows are spread over
as many tasks as they fill blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.plans import written

BLOCK_ROWS = 32768
_POSITION = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """``df`` in the order of the columns ``order`` with its row number, from 0, in ``_at``."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id: the partition above bit 33, the position in it below.
    kept = written(ranged.withColumn("_id", F.monotonically_increasing_id()), label)
    kept = kept.withColumn("_part", F.shiftrightunsigned("_id", 33)).withColumn("_pos", F.col("_id").bitwiseAND(F.lit(_POSITION)))
    sizes = kept.groupBy("_part").agg((F.max("_pos") + 1).alias("_n"))
    # One row per partition of the sort, so the unpartitioned window is as small as a task list.
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return kept.join(F.broadcast(before), "_part").withColumn("_at", F.col("_before") + F.col("_pos")).drop("_id", "_part", "_pos", "_before")


def ordered_blocks(df: DataFrame, order: list[str], label: str, halo: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows with ``_block`` and ``_at``; a row within ``halo`` of a block's edge is also copied to the neighbour block.

    In block b the numbers from ``b * block_rows`` to ``(b + 1) * block_rows - 1`` are its own rows, the others its halo."""
    rows = numbered(df, order, label)
    block, within = F.floor(F.col("_at") / block_rows), F.col("_at") % block_rows
    copies = F.array_compact(F.array(block, F.when((within < halo) & (block > 0), block - 1), F.when(within >= block_rows - halo, block + 1)))
    return rows.withColumn("_block", F.explode(copies))
