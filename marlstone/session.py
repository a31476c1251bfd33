"""Session set-up, table access and cutting of lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marlstone", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitted session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per context, so that their Python workers can import it wherever the
    driver was started from."""
    context = spark.sparkContext
    if getattr(context, "_marlstone_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="marlstone-package-")) / "marlstone.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._marlstone_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder. Also makes sure that the executors have this package."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without that setting; it gets a temporary folder. A cluster without it is an
    error, as a machine-local folder would be lost with the machine.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _path(spark: SparkSession, location: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(location)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, location: str) -> None:
    path, fs = _path(spark, location)
    fs.delete(path, True)


def path_exists(spark: SparkSession, location: str) -> bool:
    path, fs = _path(spark, location)
    return fs.exists(path)


def file_versions(spark: SparkSession, location: str) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of the files of a location."""
    out = []
    for name in sorted(spark.read.parquet(location).inputFiles()):
        path, fs = _path(spark, name)
        status = fs.getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return out


_WRITTEN: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete what ``materialize`` and the users of ``scratch`` have written so far. For long sessions, between queries whose results are no longer read."""
    while _WRITTEN:
        delete_path(spark, _WRITTEN.pop())


def _forget(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # the session may be gone by the time the interpreter ends
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new location in the shared folder, deleted by ``release`` or when the interpreter ends."""
    location = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_forget, spark)
    _WRITTEN.append(location)
    return location


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage so that a result used several times is computed once, and survives the loss of executors.
    Parquet keeps it compressed and lets later readers prune columns.
    """
    spark = df.sparkSession
    location = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(location)
    return spark.read.schema(df.schema).parquet(location)
