"""What the operators of this subpackage share: reading, scratch tables, row keys."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_ready(df: DataFrame) -> DataFrame:
    """Lets Python workers on this machine import the package from where the driver has it.

    On a cluster the package is installed, or sent with --py-files; the extra path does no harm.
    """
    root, env = str(Path(__file__).resolve().parents[2]), df.sparkSession.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return df


@cache
def _own_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='scholion-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Only a session of one machine, as in tests, gets a folder of its own where none is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a shared folder for scratch tables")
        found = _own_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a scratch table in the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of executors, and what reads the
    result more than once computes it once. ``discard`` removes a table that no result reads any
    more; the others go when the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    _scratch.append(out)
    return out


#: Scratch tables of this driver that weren't discarded, in order.
_scratch: list[DataFrame] = []


def scratch_tables() -> list[DataFrame]:
    """Scratch tables that are there now: what a step adds to them is its own, and can go once its result is written."""
    return list(_scratch)


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables of ``materialize``; any other DataFrame is left alone. Nothing may read them afterwards."""
    for df in tables:
        if path := vars(df).get("scratch_path"):
            _scratch[:] = [x for x in _scratch if x.scratch_path != path]
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that tell rows of different content apart, though ids or texts may repeat or be null.

    Rows that agree in both id and text share a key, and so share a result.
    """
    return [
        F.coalesce(F.col(doc_id).cast("string"), F.lit("\0")).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"),
    ]
