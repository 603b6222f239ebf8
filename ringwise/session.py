"""Session construction and lineage helpers.

Every job reads ``spark.checkpoint.dir`` from the session; only on a local
master, and only where it is unset, is a fresh scratch folder used.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "ringwise",
              shuffle_partitions: int | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # AQE may broadcast a join side only after measuring it at runtime (<= 64 MB); the static,
        # estimate-based threshold stays at Spark's default
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", str(64 * 1024 * 1024))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, read from the session and never changed.

    Where it is unset, a ``local[...]`` master (tests) gets a fresh scratch folder; a cluster is refused,
    because a folder of one machine would be invisible to the others.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="ringwise-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of ids, links or counts that fill a file.
FILE_ROWS = 20_000


def files(rows: int) -> int:
    """How many files hold ``rows`` short rows: ``df.coalesce(files(rows))`` after cheap work, ``few`` after costly work.

    Every task that writes makes a file, and a store may start processes for each (Hadoop's local one starts a ``chmod``
    for the file and one for its checksum), so a small table in as many files as there are shuffle partitions costs more
    than its rows.  A wrong guess of ``rows`` changes the number of files only.
    """
    return 1 + max(0, rows) // FILE_ROWS


def few(df: DataFrame, n: int) -> DataFrame:
    """``df`` dealt into ``n`` partitions if that is less than the shuffle partitions; what comes before keeps its tasks."""
    return df.repartition(n) if n < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: cuts lineage, column-pruned re-reads."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder, bucketed by ``key``: joins on it need no exchange of this side.

    With as many buckets as shuffle partitions (the default) a side that an aggregation left hashed by the key needs none either.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, key).write.bucketBy(n, key).sortBy(key)
     .option("path", f"{checkpoint_dir(spark).rstrip('/')}/{name}").saveAsTable(name))
    return spark.table(name)


def at_once(*works: Callable) -> list:
    """The results of ``works``, called in a thread each: jobs that do not wait for one another share the cluster's cores.

    An error of one is raised after all have ended.
    """
    own = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(works)) as pool:
        return [f.result() for f in [pool.submit(own(work)) for work in works]]
