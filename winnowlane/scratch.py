"""Where operators cut lineage: tables in the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a temporary folder of a session on one machine; on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='winnowlane-')}"
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder. It is removed when the driver process ends."""
    path = f"{shared_dir(spark)}/winnowlane/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Unlike Dataset.checkpoint() this runs the last stage once and stores columns compressed.
    The copy outlives lost executors.
    """
    spark = frame.sparkSession
    path = fresh_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def only(make, name: str) -> DataFrame:
    """What make() gives, written; every other table that was written on the way is removed.

    make() must not hand out frames that read those tables. The result reads nothing but its own.
    """
    before = len(_MADE)
    made = make()
    out = materialize(made, name)
    own = _MADE.pop()
    for spark, path in _MADE[before:]:
        drop_path(spark, path)
    _MADE[before:] = [own]
    return out


def drop(frame: DataFrame) -> None:
    """Remove the table that a frame made here reads, if it does; frames that read it are void afterwards."""
    found = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in frame.inputFiles()[:1]}
    for at in [i for i, (_, path) in enumerate(_MADE) if path.rsplit("/", 1)[-1] in found][::-1]:
        drop_path(*_MADE.pop(at))


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear() -> None:
    """Remove every folder this process made; frames that read them are void afterwards."""
    while _MADE:
        spark, path = _MADE.pop()
        if spark.sparkContext._jsc is not None:
            drop_path(spark, path)


@atexit.register
def _at_exit() -> None:
    try:
        clear()
    except Exception:  # the JVM may be gone already
        _MADE.clear()


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def input_bytes(frame: DataFrame) -> int:
    """Catalyst's size estimate of a frame; 0 where it has none."""
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0
