"""Problem 5: the differences between two copies of a dataset, row by row and field by field.

Both sides are brought to one row per key (partial aggregation before the shuffle, so a repeated row costs nothing) and hashed by
key into buckets of bounded size. The buckets of both sides are cogrouped as Arrow tables: keys are aligned by a sorted search,
fields are compared through null-aware masks over whole columns, and only the masked cells come out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.plans import EXPANSION, estimated_bytes, shuffle_partitions

#: Memory of one side's bucket that is aimed at.
BUCKET_BYTES = 16 * 1024 * 1024
MISSING_LEFT, MISSING_RIGHT = "missing_in_reference", "missing_in_candidate"

_NUMBER = r"^[+-]?(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)$"


def number_text(text: Column) -> Column:
    """One text for each numeric value, of any length: no plus sign, commas, leading zeros or trailing fraction zeros.

    Null and blank texts are null, other texts that are no numbers stay as they are without blanks around; a power of ten is
    written out within decimal(38,12)."""
    t = F.btrim(text, F.lit(" \t\r\n "))
    t = F.when(t.rlike(r"^[+-]?[0-9.]+[eE][+-]?[0-9]+$"), F.coalesce(t.try_cast("decimal(38,12)").cast("string"), t)).otherwise(t)
    body = F.replace(F.ltrim(t, F.lit("+-")), F.lit(","), F.lit(""))
    whole, fraction = F.ltrim(F.split_part(body, F.lit("."), F.lit(1)), F.lit("0")), F.rtrim(F.split_part(body, F.lit("."), F.lit(2)), F.lit("0"))
    size = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)))
    signed = F.when(t.startswith("-") & (size != "0"), F.concat(F.lit("-"), size)).otherwise(size)
    return F.when(t.rlike(_NUMBER), signed).when(t != "", t)


def day_text(text: Column) -> Column:
    """``yyyy.MM.dd`` of a day written year first with dots, dashes, slashes or nothing between; null for others and non-days."""
    t = F.btrim(text, F.lit(" \t\r\n "))
    digits = F.regexp_replace(t, r"^(\d{4})([-./]?)(\d{2})\2(\d{2})$", "$1-$3-$4")
    return F.date_format(F.when(digits.rlike(r"^\d{4}-\d{2}-\d{2}$"), digits).try_cast("date"), "yyyy.MM.dd")


def _codes(left: pa.Table, right: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One integer per row such that equal keys, nulls included, have equal integers on both sides."""
    total = np.zeros(left.num_rows + right.num_rows, np.int64)
    for k in keys:
        both = pa.chunked_array([*left[k].chunks, *right[k].chunks], left[k].type).combine_chunks()
        codes = pc.fill_null(both.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        total = total * (codes.max(initial=0) + 1) + codes
        total = np.unique(total, return_inverse=True)[1].astype(np.int64)
    return total[: left.num_rows], total[left.num_rows :]


def _cell_differences(left: pa.Table, right: pa.Table, keys: list[str], fields: list[str], schema: pa.Schema) -> pa.Table:
    a, b = _codes(left, right, keys)
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b[order], a)
    inside = at < len(b)
    hit = np.zeros(len(a), bool)
    hit[inside] = b[order][at[inside]] == a[inside]
    mine, other = np.flatnonzero(hit), order[at[hit]]
    seen = np.zeros(len(b), bool)
    seen[other] = True

    def cells(side: pa.Table, rows: np.ndarray, difference: str, x: pa.Array | None, y: pa.Array | None) -> pa.Table:
        n = len(rows)
        empty = pa.nulls(n, pa.string())
        return pa.table([*(side[k].take(pa.array(rows)) for k in keys), pa.array([difference] * n, pa.string()), empty if x is None else x, empty if y is None else y], schema=schema)

    out = [cells(left, np.flatnonzero(~hit), MISSING_RIGHT, None, None), cells(right, np.flatnonzero(~seen), MISSING_LEFT, None, None)]
    for f in fields:
        x, y = left[f].take(pa.array(mine)), right[f].take(pa.array(other))
        unequal = pc.or_(pc.xor(pc.is_null(x), pc.is_null(y)), pc.fill_null(pc.not_equal(x, y), False))
        rows = np.flatnonzero(unequal.to_numpy())
        pick = pa.array(rows)
        out.append(cells(left, mine[rows], f, x.take(pick), y.take(pick)))
    return pa.concat_tables(out)


def differences(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], buckets: int | None = None) -> DataFrame:
    """(keys, difference, left_value, right_value) of rows missing on a side and of unequal fields of rows on both.

    ``fields`` are compared as they are: normalise them first (``number_text``). Equal keys, null keys among them, match; of several
    rows of one key on a side the first by ``source_line``, if there is such a column, then by the fields, is taken, so repeated
    rows count once. ``difference`` is the field's name, ``missing_in_candidate`` (right) or ``missing_in_reference`` (left). With
    an empty side every row of the other is missing; other columns are ignored."""
    size = max(estimated_bytes(left), estimated_bytes(right)) * EXPANSION
    n = buckets or max(shuffle_partitions(left.sparkSession), math.ceil(size / BUCKET_BYTES))

    def one(df: DataFrame) -> DataFrame:
        # Two exchanges: the first is fed by the partial aggregate, so that any number of copies of a row costs one row a task; a
        # single one by bucket would send every copy.
        order = ["source_line"] if "source_line" in df.columns else []
        texts = [F.col(f).cast("string").alias(f) for f in fields]
        rows = df.select(*keys, *order, *texts).groupBy(*keys).agg(F.min(F.struct(*order, *fields)).alias("_v"))
        return rows.select(F.pmod(F.xxhash64(*keys), F.lit(n)).alias("_bucket"), *keys, *(F.col(f"_v.{f}").alias(f) for f in fields))

    a, b = one(left), one(right)
    types = {f.name: f.dataType.simpleString() for f in a.schema}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "difference string, left_value string, right_value string"])
    arrow = pa.schema([*((k, _arrow(types[k])) for k in keys), ("difference", pa.string()), ("left_value", pa.string()), ("right_value", pa.string())])
    return a.groupBy("_bucket").cogroup(b.groupBy("_bucket")).applyInArrow(lambda x, y: _cell_differences(x, y, keys, fields, arrow), schema)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "date": pa.date32()}[kind]
