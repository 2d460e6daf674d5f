"""Session helpers: local sessions for tests and the shared folder for materialised data."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "codescout") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``; only a local session without
    that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="codescout-")
        sc.setCheckpointDir(base)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path inside the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Give a job a folder of its own for checkpoints and scratch data, and delete it when the job is done or has failed.

    The folder lies in the shared one. Results must be written or collected inside the scope; frames made in it can't be read after it.
    """
    sc = spark.sparkContext
    outer = shared_dir(spark)
    inner = f"{outer}/scope-{uuid.uuid4().hex}"
    sc.setCheckpointDir(inner)
    try:
        yield inner
    finally:
        # Spark makes a new folder below the one it is given, so the parent is named again.
        sc.setCheckpointDir(outer.rsplit("/", 1)[0])
        path = sc._jvm.org.apache.hadoop.fs.Path(inner)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application.

    The archive is written on the driver and sent out by Spark itself, so executors
    need neither an installation nor access to the driver's disk.
    """
    sc = spark.sparkContext
    if getattr(sc, "_codescout_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="codescout-package-")) / "codescout.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._codescout_shipped = True
