"""Session factory, table loader and the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "loomwright", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LOOM_DRIVER_MEMORY", "6g"))
    )
    spark = builder.master(master or "local[8]").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


#: Spark 4.1 takes the partitioning of a union's children for that of the union, even where adaptive execution
#: coalesces each child by itself; a grouping over the union then gives a key twice. So it is switched off.
#: Times in the tables have no zone and are UTC; in another zone, hours that the clock skips would shift.
SAFE = {"spark.sql.unionOutputPartitioning": "false", "spark.sql.session.timeZone": "UTC"}


def make_safe(spark: SparkSession) -> None:
    for k, v in SAFE.items():
        spark.conf.set(k, v)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    make_safe(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the cluster shares.

    Only a local master without that setting (tests, a laptop) gets a temporary folder of this machine; a cluster
    without it is an error, as its executors would write to their own disks.
    """
    make_safe(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="loomwright-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    global _registered
    if not _registered:
        _registered = True
        atexit.register(remove_tables, spark)
    _made.append(path)
    return path


_made: list[str] = []  # folders of this process
_registered = False


def remove_tables(spark: SparkSession) -> None:
    """Remove the folders made so far: when the process ends, or earlier once no result is read from them any more."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _made:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        _made.clear()
    except Exception:  # noqa: BLE001, S110 - the session may be gone already
        pass


def through_table(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
