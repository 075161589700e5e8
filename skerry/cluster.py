"""What a session needs before Python code of this package runs on executors, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors of the session's cluster, once."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        home = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp()) / "skerry.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    return spark


#: Used where a local session has no shared folder (tests).
LOCAL_SHARED = "/tmp/skerry-shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.  Without it a cluster has none, and only local sessions go on."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return LOCAL_SHARED


_scratch: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder.  Results are read from such tables as long as they are used; clean() or the end of the driver's process deletes them."""
    ship(spark)
    path = f"{shared_dir(spark)}/skerry/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append((spark, path))
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, whichever store it lies in."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession | None = None) -> None:
    """Deletes all scratch folders of a session (None: of all); results that are read from them are lost."""
    for own, path in list(_scratch):
        if spark is None or own is spark:
            _scratch.remove((own, path))
            removed(own, path)


@atexit.register
def _at_exit() -> None:
    try:
        clean()
    except Exception:  # noqa: BLE001  the JVM may be gone by now; the folder is the cluster's to sweep then
        pass
