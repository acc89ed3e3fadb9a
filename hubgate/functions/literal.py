"""Tables of a few rows as literals of the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of plain values. No Python runs for it: the rows of ``createDataFrame`` are read by a second set of
    Python workers, which stays alive beside that of the passes over pairs."""
    fields = StructType.fromDDL(schema)
    own = [F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(r, fields, strict=True)]) for r in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*own).cast(ArrayType(fields))))
