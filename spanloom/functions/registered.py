"""SQL functions of this library, registered by name for use in `spark.sql`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

# name, parameters, result, body: SQL bodies that the optimizer inlines
FUNCTIONS = (
    ("valid_rt", "no_go INT, response INT, rt DOUBLE", "DOUBLE", "CASE WHEN no_go = 0 AND response = 1 AND rt >= 150 THEN rt END"),
    ("decision_of", "p DOUBLE", "STRING", "CASE WHEN p >= 0.65 THEN 'positive' WHEN p <= 0.35 THEN 'negative' ELSE 'indeterminate' END"),
    ("clamped_sigmoid", "x DOUBLE", "DOUBLE", "1 / (1 + exp(-least(greatest(x, -60D), 60D)))"),
    ("block_windows", "lo BIGINT, hi BIGINT, guard BIGINT, width BIGINT, step BIGINT", "ARRAY<BIGINT>",
     "CASE WHEN lo + guard + width <= hi - guard THEN sequence(lo + guard, hi - guard - width, step) ELSE array() END"),
)


class GatedAnchor:
    """gated_anchor(TABLE(...)): the anchor of each key in order, as a table function.

    The table has the columns session, step, value and confidence, and the function itself asks for it by session and in the order of step, so no
    query can forget to. The first value sets a session's anchor; later ones move it by a fifth of the way if their confidence reaches 0.12. One
    number is held for the session at hand, and its rows pass one by one.
    """

    def __init__(self) -> None:
        self.anchor: float | None = None

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"session", "step", "value", "confidence"} <= set(rows.dataType.names):
            raise ValueError("gated_anchor takes a table with session, step, value and confidence")
        schema = StructType([rows.dataType["session"], rows.dataType["step"]]).add("anchor", DoubleType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("session")], orderBy=[OrderingColumn("step")])

    def eval(self, row: Row) -> Iterator[tuple]:
        value, confidence = row["value"], row["confidence"]
        if value is not None and value == value:
            if self.anchor is None:
                self.anchor = float(value)
            elif confidence is not None and confidence >= 0.12:
                self.anchor += 0.2 * (value - self.anchor)
        yield row["session"], row["step"], self.anchor


def register(spark: SparkSession) -> None:
    """Make the functions known to a session; again is no harm."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("gated_anchor", udtf(GatedAnchor))
