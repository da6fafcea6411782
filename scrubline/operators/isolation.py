"""Steps in Python that may fail on a row: the row is told apart, and the others go on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..ship import ship

Step = Callable[[pa.RecordBatch], dict[str, list]]


def bisected(batch: pa.RecordBatch, step: Step, names: list[str]) -> tuple[dict[str, list], list[str | None]]:
    """(values of the new columns, errors): a batch that fails is halved until the rows that fail stand alone.

    A batch with k bad rows of n costs about k log n more calls.
    """
    try:
        out = step(batch)
        if all(len(out[n]) == batch.num_rows for n in names):
            return {n: list(out[n]) for n in names}, [None] * batch.num_rows
        raise ValueError("a step must give a value for each row")
    except Exception as e:  # noqa: BLE001 - whatever a step raises belongs to its row
        if batch.num_rows <= 1:
            return {n: [None] * batch.num_rows for n in names}, [f"{type(e).__name__}: {e}"[:500]] * batch.num_rows
    half = batch.num_rows // 2
    (a, ea), (b, eb) = (bisected(part, step, names) for part in (batch.slice(0, half), batch.slice(half)))
    return {n: a[n] + b[n] for n in names}, ea + eb


def isolated(df: DataFrame, name: str, step: Step, schema: str) -> DataFrame:
    """df with the columns of ``schema`` that a step gives, and error and audit of the rows that it fails on.

    step takes an Arrow batch and returns a list for each new column; it must be a function of the rows alone, as it runs again on
    parts of a batch. A failed row keeps its values, and has nulls in the new columns, an error (if it had none) and
    an entry in audit. df may have error and audit already; rows that have an error aren't given to the step.
    """
    ship(df.sparkSession)
    entry = "array<struct<skill: string, field: string, original: string, corrected: string, confidence: double>>"
    base = df if "error" in df.columns else df.withColumn("error", F.lit(None).cast("string"))
    base = base if "audit" in base.columns else base.withColumn("audit", F.array().cast(entry))
    new = StructType.fromDDL(schema)
    names = new.names
    kinds = StructType([*base.schema.fields, *new.fields]).add("_failed", "string")
    arrow = [pa.field(f.name, t) for f, t in zip(new.fields, _arrow_types(new), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            well = batch.column(batch.schema.names.index("error")).is_null()
            at = [i for i, ok in enumerate(well.to_pylist()) if ok]
            values, errors = bisected(batch.take(pa.array(at, pa.int64())), step, names)
            place = dict(zip(at, range(len(at)), strict=True))
            columns = [pa.array([values[f.name][place[i]] if i in place else None for i in range(batch.num_rows)], f.type) for f in arrow]
            failed = pa.array([errors[place[i]] if i in place else None for i in range(batch.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, failed], [*batch.schema.names, *names, "_failed"])

    out = base.mapInArrow(run, kinds)
    said = F.struct(F.lit(name).alias("skill"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("original"), F.col("_failed").alias("corrected"), F.lit(0.0).alias("confidence"))
    return out.withColumns({"error": F.coalesce("error", "_failed"), "audit": F.when(F.col("_failed").isNotNull(), F.array_append("audit", said)).otherwise(F.col("audit"))}).drop("_failed")


def _arrow_types(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]
