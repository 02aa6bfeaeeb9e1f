"""Table functions for SQL: plans of copies.

``register(spark)`` makes ``plan_copies`` known; then ::

    SELECT * FROM plan_copies(TABLE(SELECT id, category, n_copies, done FROM rows)
                              PARTITION BY category ORDER BY id)

gives a row for each copy that is still to be made: the original (``_o00``) and ``n_copies`` variants
(``_v00`` and on) of every row, without the copies in ``done``, numbered inside the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_COPIES = (StructField("copy_id", StringType()), StructField("kind", StringType()), StructField("number", IntegerType()))


class PlanCopies:
    """Rows ``(id, ..., n_copies, done)``: all columns but the last two stay. A null id has no copy, a null count is none."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("plan_copies takes a table")
        names = [f.name for f in rows.dataType.fields]
        missing = [n for n in ("id", "n_copies", "done") if n not in names]
        if missing:
            raise ValueError(f"plan_copies: no column {', '.join(missing)}")
        kept = [f for f in rows.dataType.fields if f.name not in ("n_copies", "done")]
        return AnalyzeResult(schema=StructType([*kept, *_COPIES]))

    def __init__(self) -> None:
        self.planned = 0

    def eval(self, rows: Row) -> Iterator[tuple]:
        if rows["id"] is None:
            return
        kept = [rows[f] for f in rows.__fields__ if f not in ("n_copies", "done")]
        done = set(rows["done"] or ())
        for suffix, kind in (("o00", "original"), *((f"v{k:02d}", "variant") for k in range(max(0, rows["n_copies"] or 0)))):
            name = f"{rows['id']}_{suffix}"
            if name not in done:
                yield (*kept, name, kind, self.planned)
                self.planned += 1


def register(spark: SparkSession) -> None:
    spark.udtf.register("plan_copies", udtf(PlanCopies))
