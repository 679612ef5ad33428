"""The bookmark op log as a stream: state by key, and a published state that grows by what each batch changed.

The fold is two maxima and a count, so the stream keeps one small state for each key and a batch
touches the states of its own keys only. What it changed is written as one delta, in a folder of
the batch's number, so that a batch that runs again replaces its delta. The published state is the
base and the newest delta of each key; ``compact`` makes a new base of both now and then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholion.operators.merge import fold_op_log
from scholion.sources import sinks

SCHEMA = "user_id long, k long, seq long, op string, ts timestamp"
KEYS = ["user_id", "k"]
_STATE = "user_id long, k long, added_at timestamp, deleted_at timestamp, pending long, active boolean"


def _deltas(root: str) -> str:
    return f"{root}/deltas"


def _base(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """The base, and the last batch that it holds; nothing and -1 before the first."""
    if not sinks.current_version(spark, root):
        return spark.createDataFrame([], f"{_STATE}, batch long"), -1
    tables = sinks.read_tables(spark, root)
    return tables["state"], tables["upto"].first()["batch"]


def _newest(states: DataFrame) -> DataFrame:
    rest = [x for x in states.columns if x not in (*KEYS, "batch")]
    return states.groupBy(*KEYS).agg(F.max_by(F.struct(*rest, "batch"), "batch").alias("x")).select(*KEYS, "x.*")


def _all(spark: SparkSession, root: str) -> DataFrame:
    base, upto = _base(spark, root)
    names = [x for x, _ in sinks._names(spark, _deltas(root)) if x.startswith("batch=")]
    if not names:
        return base
    later = spark.read.schema(f"{_STATE}, batch long").parquet(_deltas(root)).filter(F.col("batch") > upto)
    return _newest(base.unionByName(later))


def state(spark: SparkSession, root: str) -> DataFrame:
    """(``user_id``, ``k``, ``added_at``, ``deleted_at``, ``pending``, ``active``) after all batches so far."""
    return _all(spark, root).drop("batch")


def write_delta(spark: SparkSession, root: str, changed: DataFrame, number: int) -> None:
    changed.write.mode("overwrite").parquet(f"{_deltas(root)}/batch={number}")


def compact(spark: SparkSession, root: str) -> int:
    """Make base and deltas one new base, behind one pointer with the number of the last batch in it, and remove the deltas that it holds. Returns that number."""
    numbers = [int(x.split("=")[1]) for x, _ in sinks._names(spark, _deltas(root)) if x.startswith("batch=")]
    upto = max(numbers, default=_base(spark, root)[1])
    everything = _all(spark, root).filter(F.col("batch") <= upto)
    sinks.publish_tables({"state": everything, "upto": spark.createDataFrame([(upto,)], "batch long")}, root)
    for number in numbers:
        if number <= upto:
            sinks._remove(spark, f"{_deltas(root)}/batch={number}")
    return upto


def run(spark: SparkSession, source: str, root: str, checkpoint: str) -> StreamingQuery:
    """Fold the op files that arrive under ``source``, as far as they are there; maxima don't depend on the order of arrival."""
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    changed = fold_op_log(stream.select(*KEYS, "op", "ts"), KEYS)
    writer = changed.writeStream.outputMode("update").foreachBatch(lambda batch, number: write_delta(batch.sparkSession, root, batch, number))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
