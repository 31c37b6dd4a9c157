"""Positions and running sums in an order, without a task that holds a whole group.

Rows are dealt into ranges of the order over the session's partitions. Each range numbers its own rows;
one row a range (and group) with its size says where it begins. So a group of a third of all rows,
and one order over all rows, are work of many tasks. The bounds of ranges come from Spark's sample of
the rows; they decide only where a row is worked on, never its position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from winnowlane.scratch import input_bytes, materialize, parts

#: Estimated bytes up to which groups are not shared among tasks; a sixteenth of it where all rows are one group.
FEW_BYTES = 1 << 24


def ranges(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows dealt by ranges of an order, with the number of their range (``_part``). Rows equal in all of ``order`` share one."""
    return rows.repartitionByRange(parts(rows.sparkSession), *order).withColumn("_part", F.spark_partition_id())


def running(rows: DataFrame, by: list[str], order: list[Column], amount: str, few_bytes: int | None = None) -> DataFrame:
    """Adds upto (the sum of ``amount`` over rows of the group up to this one in the order) and n (the group's sum).

    ``order`` must tell the rows of a group apart. Null groups are a group. Rows that are few, by Catalyst's estimate, are
    summed by a window; the result is the same.
    """
    if 0 < input_bytes(rows) <= (few_bytes if few_bytes is not None else FEW_BYTES if by else FEW_BYTES // 16):
        line = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
        whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        return rows.select(*[F.col(f"`{c}`") for c in rows.columns], F.sum(amount).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum(amount).over(whole).alias("n"))
    dealt = materialize(ranges(rows, [*map(F.col, by), *order]), "ranges")
    own = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # one row for each range and group: as many as partitions and groups together, as ranges follow the order
    sums = dealt.groupBy("_part", *by).agg(F.sum(amount).alias("_sum"))
    line = Window.partitionBy(*by).orderBy("_part") if by else Window.orderBy("_part")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    starts = sums.withColumn("_before", F.sum("_sum").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).withColumn("n", F.sum("_sum").over(whole)).drop("_sum")
    met = [F.col("l._part") == F.col("r._part"), *[F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}")) for b in by]]
    condition = met[0]
    for m in met[1:]:
        condition = condition & m
    out = dealt.withColumn("_run", F.sum(amount).over(own)).alias("l").join(starts.alias("r"), condition)
    return out.select(*[F.col(f"l.`{c}`") for c in rows.columns], (F.col("_before") + F.col("_run")).alias("upto"), F.col("r.n").alias("n"))


def positions(rows: DataFrame, unit: str | None, order: list[Column]) -> DataFrame:
    """Adds pos (from 0, in the order, within the unit or over all rows) and _n (rows of the unit)."""
    out = running(rows.withColumn("_one", F.lit(1).cast("long")), [unit] if unit else [], order, "_one")
    return out.withColumn("pos", F.col("upto") - 1).withColumnRenamed("n", "_n").drop("upto", "_one")


def none(schema: str) -> pd.DataFrame:
    """No rows of a schema of plain types, typed as Spark expects: an empty column without a type counts as one of floats."""
    kinds = {"long": "int64", "bigint": "int64", "int": "int32", "double": "float64", "boolean": "bool"}
    return pd.DataFrame({n: pd.Series([], dtype=kinds.get(k, "object")) for n, k in (f.split(" ", 1) for f in schema.split(", "))})


def arrow_schema(schema: str) -> pa.Schema:
    """A schema's Arrow types, for batches that may be empty. To be called on the driver."""
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields])


def fold_units(rows: DataFrame, unit: str, order: list[str | Column], work: Callable[[object, dict[str, list]], dict[str, list]], schema: str, columns: list[str] | None = None) -> DataFrame:
    """work(unit, columns as lists in the order) of every unit, one after another in its task; it gives columns of ``schema``.

    For folds over very many small units: nothing is set up anew for each. A task holds one unit at a time, and what
    a batch of them gives. Null units are one unit. ``columns`` are those that work() sees, all if not given.
    """
    columns = columns or rows.columns
    dealt = rows.repartition(parts(rows.sparkSession), unit).sortWithinPartitions(unit, *order).select(*columns)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in columns}

        def give(found: list[dict[str, list]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({n: [x for f in found for x in f[n]] for n in names}, schema=kinds)

        for batch in batches:
            got, known = batch.to_pydict(), len(held[unit])  # what is held is one unit
            for c in columns:
                held[c] += got[c]
            u, at, found = held[unit], 0, []
            for i in range(max(1, known), len(u)):
                if u[i] != u[at]:
                    found.append(work(u[at], {c: held[c][at:i] for c in columns}))
                    at = i
            held = {c: held[c][at:] for c in columns}
            if found:
                yield give(found)
        if held[unit]:
            yield give([work(held[unit][0], held)])

    return dealt.mapInArrow(run, schema)
