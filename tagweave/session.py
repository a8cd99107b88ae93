"""Session settings and the shared folder for written intermediates."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus="*", shuffle_partitions=8, app="tagweave") -> SparkSession:
    """A single-machine session, used by tests and the bench."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; the cluster names it in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = context.getCheckpointDir() or _own_folder()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def _own_folder() -> str:
    """A folder of this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="tagweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tagweave/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written, if it is there."""
    target, files = _file_system(spark, path)
    files.delete(target, True)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list:
    """Names in a folder, none if it is not there; hidden files are left out."""
    target, files = _file_system(spark, path)
    if not files.exists(target):
        return []
    return [n for n in (f.getPath().getName() for f in files.listStatus(target)) if n[0] not in "._"]


def files_version(spark: SparkSession, paths) -> tuple:
    """What tells whether files at the given paths have changed: name, length and time of each."""
    found = []
    for path in paths:
        target, files = _file_system(spark, path)
        listed = files.listFiles(target, True) if files.exists(target) else None
        while listed is not None and listed.hasNext():
            one = listed.next()
            found.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return tuple(sorted(found))


def create_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that appears as a whole: under a hidden name first, then renamed."""
    target, files = _file_system(spark, path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), "." + target.getName())
    out = files.create(hidden, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not files.rename(hidden, target):
        raise OSError(f"could not write {path}")


def file_text(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    target, files = _file_system(spark, path)
    stream = files.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
