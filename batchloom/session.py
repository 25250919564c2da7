"""Session settings and the shared working folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# Settings a cluster run should carry. Skewed joins are split at run time,
# small sides are broadcast, and hashed instead of sorted, only after their size
# has been measured.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "batchloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the recommended settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, as named by ``spark.checkpoint.dir``.

    Only a session without one (local tests) gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="batchloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder, or the scratch folder in use."""
    return f"{_scratch.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for all tables that calls inside the block write; it goes at the end.

    Results that are read after the block must be written elsewhere inside it.
    """
    folder = run_folder(spark, "scratch")
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a folder, not a file, lies at a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return any(status.isDirectory() for status in found)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet to the shared folder and read back.

    Every later reader sees the same rows, whatever executors are lost, and
    reads only the columns it needs.
    """
    spark = df.sparkSession
    path = run_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files, broadcasts and plans that nothing uses any more, and of the driver's free memory.

    Spark drops them when the driver collects its garbage, by itself every half hour at the latest.
    """
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Hand memory that the driver's JVM has freed outside its heap back to the system.

    The C library keeps what many short-lived threads and compilations have freed. JVMs have a
    diagnostic command for that since 17.0.9 on Linux; without it nothing is done, and the answer is False.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    named = jvm.java.lang.Class.forName

    def array(of, *values):
        out = gateway.new_array(of, len(values))
        for i, value in enumerate(values):
            out[i] = value
        return out

    types = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    nothing = array(jvm.java.lang.Object), array(jvm.java.lang.String)
    try:
        # By the interface: the class behind it is not open to callers.
        invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *map(named, types)))
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(beans, array(jvm.java.lang.Object, command, "systemTrimNativeHeap", *nothing))
    except Py4JJavaError:
        return False
    return True


def written_alone(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make()`` returns, written as by ``materialized``; all else that it wrote goes at once."""
    path = run_folder(spark, name)
    with scratch(spark):
        out = make()
        out.write.parquet(path)
    release(spark)
    return spark.read.schema(out.schema).parquet(path)
