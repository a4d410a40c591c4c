"""Session settings, table access and intermediate tables shared by every job."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Applied to a running session. All are runtime settings, so a caller's own session can be used.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # HotSpot never compiles a method beyond 8000 bytes, so a fused stage of long expressions (payloads, checks of
    # payloads) would be interpreted for every row. Beyond this Spark splits it into methods that are compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "freshet", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings the results depend on (UTC) and the ones the plans rely on (AQE), and send the
    package to the executors."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application; Spark's own file server carries it."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    _SHIPPED.add(spark.sparkContext.applicationId)
    top = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.relpath(path, os.path.dirname(top)))
    local = tempfile.mkdtemp(prefix="freshet-ship-")  # read by the driver alone
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    with open(os.path.join(local, "freshet-package.zip"), "wb") as file:
        file.write(packed.getvalue())
    spark.sparkContext.addPyFile(os.path.join(local, "freshet-package.zip"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with costly work per row, given a task per core where its files have fewer splits.

    A table of many files already has more splits than there are cores and is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


PACKED = "spark.sql.sources.fileCompressionFactor"
UNPACKED = "20"  # ids in order take 2 to 5 bytes in a file and about 100 in a broadcast hash table


@contextmanager
def unpacked_sizes(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside, also by streams started inside, take files for as large as their rows are in memory.

    Without it Spark broadcasts, by way of the driver, any table whose files are under its threshold: a few
    MB of ordered ids are hundreds of MB there. Small tables are broadcast as before.
    """
    before = spark.conf.get(PACKED, None)
    spark.conf.set(PACKED, UNPACKED)
    try:
        yield
    finally:
        spark.conf.set(PACKED, before) if before else spark.conf.unset(PACKED)


LEAN = {
    # The files of a shuffle go when its query ends. By default they stay until the driver happens to collect its
    # garbage, so a job of many steps holds what all of them have shuffled.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",  # of whole texts
}


@contextmanager
def lean_writes(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind and hand texts to Python in small batches."""
    before = {key: spark.conf.get(key, None) for key in LEAN}
    for key, value in LEAN.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in spark.checkpoint.dir.

    Where a local master names none (tests, one machine), one folder per application stands in for it;
    it goes with everything in it when the application ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _OWN_DIRS:
        _OWN_DIRS[application] = tempfile.mkdtemp(prefix="freshet-")
        atexit.register(shutil.rmtree, _OWN_DIRS[application], ignore_errors=True)
    return _OWN_DIRS[application]


def cut(df: DataFrame, *folders: str) -> DataFrame:
    """Write `df` as a table in the shared folder, in folders by the given columns, and go on from there.

    Needed where a result is read several times, or where a later step must see exactly the same
    rows twice. It survives the loss of executors, later steps read only the columns they use, and
    Spark knows the size when it plans a join.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/freshet-cut/{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
