"""Helpers that several operators share: checkpoints, worker imports, connected components."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


#: Python workers are used again by later stages; with these they give memory back in between. Fixed names of glibc and Arrow.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_MMAP_THRESHOLD_": "1048576"}


def importable(spark: SparkSession) -> None:
    """Lets Python workers that share this machine's files import the package as the driver does, and give memory back.

    On a cluster the package is shipped with --py-files; the extra path is then simply not there.
    """
    env = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    known = [p for p in (env.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")) if p]
    if ROOT not in ":".join(known).split(":"):
        env["PYTHONPATH"] = ":".join([ROOT, *known[:1]])


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode (tests) one of this machine's where that isn't set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quire-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def freed(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more; they'd stay until memory runs short."""
    gc.collect()
    # the gateway tells the JVM of dropped objects a second later; do so at once
    dropped = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ())
    while dropped and isinstance(dropped[-1], tuple):
        try:
            client, target = dropped.pop()
        except IndexError:
            break
        client.garbage_collect_object(target, False)
    # each listener's thread holds on to the last event, which holds the plan that ended, until another comes
    spark.range(1).count()
    with contextlib.suppress(Py4JJavaError):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(2000)
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str = "step", free: bool = True) -> DataFrame:
    """df, written as a table in the shared folder, so that lost executors cost no more than a read.

    What was shuffled for it is dropped at once (unless free is false): pass a plan that no variable holds.
    """
    spark = df.sparkSession
    path, schema = scratch(spark, name), df.schema
    df.write.parquet(path)
    del df
    if free:
        freed(spark)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Deletes stored tables that no plan reads any more."""
    for df in tables:
        remove(df.sparkSession, df.stored_at)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the smallest node it reaches.

    Alternates large stars (each node links its larger neighbours to its smallest one) and small
    stars (each node links its smaller neighbours and itself to the smallest) until the edges no
    longer change; they then form one star per component. Minima are combined before the shuffle,
    and a hub is only ever one side of a join whose other side has one row per key; the added tag gives
    both sides a shuffle of their own, which adaptive execution can split. Self-links, repeats and nulls
    are ignored; an empty input gives no rows.
    """
    tag = F.hash("u")
    stars = stored(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars", free=False)
    seen = _digest(stars)
    if not seen[0]:
        return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), tag.alias("tag"))
        large = both.where("v > u").withColumn("tag", tag).join(least, ["u", "tag"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.withColumn("tag", tag).join(least.withColumn("tag", tag), ["u", "tag"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, stars = stars, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars", free=False)
        release(before)
        if (now := _digest(stars)) == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    freed(edges.sparkSession)
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
