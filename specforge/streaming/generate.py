"""Generation as a stream: rows of a table without parents, rules or keys, as fast as a rate source numbers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.engine import Engine
from ..plans.spec import Spec, SpecError


def stream_table(spark: SparkSession, spec: Spec, table: str, rows_per_second: int = 1000) -> DataFrame:
    """A streaming DataFrame of the table. Its rows depend on their number only, so a restart repeats none differently."""
    engine = Engine(spark, spec)
    t = engine.spec.table(table)
    if t is None or t.relationships or t.rules:
        raise SpecError(f"{table}: only tables without relationships and rules can be streamed")
    keys = [t.key, *t.unique_constraints, *[[c.name] for c in t.columns if c.constraints.get("unique")]]
    if any(k and all(t.column(c).generator not in ("sequence", "uuid") for c in k) for k in keys):
        raise SpecError(f"{table}: a stream cannot keep keys unique unless a sequence or uuid is part of them")
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    ids = rate.select((F.col("value") + 1).alias("_rid"), F.lit(0).alias("_attempt"))
    return engine._columns(ids, t).select(*[f"`{c.name}`" for c in t.columns])


def run_stream(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    w = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 second")).start()
