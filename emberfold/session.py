"""Session settings and lineage cutting on shared storage."""

from __future__ import annotations

import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_scopes = threading.local()


def build_session(app: str = "emberfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package relies on; `conf` overrides any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    options = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    return pin_utc(builder.getOrCreate())


def pin_utc(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings results or speed depend on to any session.

    All times are UTC: date functions must not go through a local zone. Generated methods above
    8000 bytes are never compiled by HotSpot, so Spark must split such stages instead.
    """
    for key, value in (
        ("spark.sql.session.timeZone", "UTC"),
        ("spark.sql.codegen.hugeMethodLimit", "8000"),
    ):
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='emberfold-package-')}/{package.name}", "zip",
        root_dir=package.parent, base_dir=package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediates: the cluster's `spark.checkpoint.dir`.

    Only a local master may fall back to a temporary folder, because there every task sees it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    key = context.applicationId
    if key not in _local_dirs:
        _local_dirs[key] = tempfile.mkdtemp(prefix="emberfold-")
    return _local_dirs[key]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/emberfold-{name}-{uuid.uuid4().hex}"
    if open_scopes := getattr(_scopes, "open", None):
        open_scopes[-1].append(path)
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediates written inside when the block ends, also by an error.

    Nothing that outlives the block may read them: results must be in tables of their own by then.
    """
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            fs, jvm_path = file_system(spark, path)
            fs.delete(jvm_path, True)


def together(spark: SparkSession, *calls: Callable) -> list:
    """Results of calls whose Spark jobs do not need each other, run side by side.

    Small jobs wait for their slowest task and for the driver most of the time; others fill it.
    """
    scopes = getattr(_scopes, "open", None)

    def within(call: Callable):
        if scopes is not None:
            _scopes.open = scopes
        return call()

    with ThreadPoolExecutor(len(calls)) as pool:
        begun = [pool.submit(inheritable_thread_target(spark)(within), call) for call in calls]
    return [one.result() for one in begun]


def written(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """Write `df` to the shared folder and read it back: cuts lineage and survives lost executors.

    `metrics` are aggregates observed during the write, so they cost no extra pass.
    """
    spark = pin_utc(df.sparkSession)
    path = new_path(spark, name)
    observation = Observation()
    observed = df.observe(observation, F.count(F.lit(1)).alias("rows"), *metrics)
    observed.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), observation.get
