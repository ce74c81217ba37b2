"""Session construction and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quarrystone", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A UTC session with adaptive execution on; cluster settings stay with the cluster."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder of this machine is made and set if the master is local. On a cluster each executor would
    write to a disk of its own: there it raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "") or ""
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set, and {master or 'this master'} needs a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarrystone-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(_remove, spark, folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors. The table goes when ``release`` is called with what is
    returned, and else when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    _written[id(back)] = (weakref.ref(back, lambda _, k=id(back): _written.pop(k, None)), path)
    return back


_written: dict[int, tuple[weakref.ref, str]] = {}


def release(df: DataFrame) -> None:
    """Removes the table of what ``materialise`` returned; nothing may be read from it any more. Other tables are left alone."""
    known = _written.pop(id(df), None)
    if known and known[0]() is df:
        _remove(df.sparkSession, known[1])
