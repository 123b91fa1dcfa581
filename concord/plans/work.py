"""Work tables in the folder that driver and executors share, so that long plans can be cut where it pays."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: For folders on a mounted file system: no checksum file beside each of a work table's files, and so a third of the processes
#: that Hadoop starts to set permissions. Other stores don't look at it. Small row groups, as a writer holds a whole one.
SCRATCH = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.block.size": str(16 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all run in one process, a folder of our own.

    On a cluster a local folder would lose what other machines write, so there an unset spark.checkpoint.dir is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="concord-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work table, in whatever store it is."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # the session may have ended; the folder is scratch space
        return


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/concord-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.options(**SCRATCH).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_small(df: DataFrame, name: str) -> DataFrame:
    """cut() into few files, for tables that are small next to the cluster: each file costs an executor a process on some stores."""
    return cut(df.coalesce(max(8, 2 * df.sparkSession.sparkContext.defaultParallelism)), name)


def hold(df: DataFrame, held: list[DataFrame]) -> DataFrame:
    """df kept on the executors' disks and listed in held, for a table that is read more than once by the steps of one call.

    What a lost executor held is computed again from the plan, so this is for deterministic plans with a short lineage.
    """
    kept = df.persist(StorageLevel.DISK_ONLY)
    kept.count()
    held.append(kept)
    return kept


def let_go(held: list[DataFrame]) -> None:
    """Free what hold() kept, when the results no longer read it."""
    while held:
        held.pop().unpersist()


def drop(df: DataFrame) -> None:
    """Delete the files of a table that cut() made, when nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def own_session(df: DataFrame, conf: dict[str, str]) -> DataFrame:
    """df in a session of its own, a copy of the one it came from with some settings changed there and nowhere else."""
    spark = df.sparkSession
    copied = spark._jsparkSession.cloneSession()
    session = SparkSession(spark.sparkContext, copied)
    for key, value in conf.items():
        session.conf.set(key, value)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(copied, df._jdf.logicalPlan()), session)


def shipped(df: DataFrame) -> DataFrame:
    """df, after seeing that Python on the executors has this package."""
    ship(df.sparkSession)
    return df


def arrow_udf(kind: str) -> Callable[[Callable], Callable]:
    """pandas_udf with results of this type, for functions that need this package on the executors."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)
    return F.pandas_udf(kind)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that their Python finds it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_concord_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="concord-code-")  # on the driver, which serves the file to executors
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/concord.zip", "w") as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, f.relative_to(top.parent))
    sc.addPyFile(f"{folder}/concord.zip")
    sc._concord_shipped = True
