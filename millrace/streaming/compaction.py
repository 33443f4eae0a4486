"""State tables that don't grow: change folders of finished micro-batches are folded into one base.

``tables.each_batch`` leaves a folder of changed states for every micro-batch. A base holds the newest state per key up to
a micro-batch; it lies in ``_base/upto=N`` and counts once Spark has put ``_SUCCESS`` into it, which is the last thing a
write does, so a reader sees the old base or the new one and never half of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.streaming.tables import BATCH

BASES, UPTO, DONE = "_base", "upto", "_SUCCESS"


def _numbered(spark: SparkSession, folder: str, name: str) -> dict[int, bool]:
    """Numbers of the folders ``name=N`` below ``folder``, and whether they are complete."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return {}
    found = [status.getPath() for status in system.listStatus(at) if status.isDirectory()]
    numbers = {path: path.getName().partition("=") for path in found}
    return {int(n): system.exists(hadoop.Path(path, DONE)) for path, (key, _, n) in numbers.items() if key == name and n.isdigit()}


def _remove(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _base(path: str, upto: int) -> str:
    return f"{path}/{BASES}/{UPTO}={upto}"


def _changes(path: str, batch: int) -> str:
    return f"{path}/{BATCH}={batch}"


def _layout(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The newest complete base (-1 for none) and the complete micro-batches after it."""
    base = max((n for n, complete in _numbered(spark, f"{path}/{BASES}", UPTO).items() if complete), default=-1)
    return base, sorted(n for n, complete in _numbered(spark, path, BATCH).items() if complete and n > base)


def _newest(spark: SparkSession, path: str, keys: Sequence[str], base: int, batches: Sequence[int]) -> DataFrame:
    frames = [spark.read.parquet(_base(path, base))] if base >= 0 else []
    if batches:
        changed = spark.read.option("basePath", path).parquet(*[_changes(path, n) for n in batches])
        frames.append(changed.withColumn(BATCH, F.col(BATCH).cast("bigint")))
    if not frames:
        raise FileNotFoundError(f"no state below {path}")
    table = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    rest = [c for c in table.columns if c not in keys]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(BATCH)).alias("__state")).select(*keys, "__state.*")


def stored_state(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest state per key, from one base and the folders since."""
    return _newest(spark, path, keys, *_layout(spark, path)).drop(BATCH)


def compact(spark: SparkSession, path: str, keys: Sequence[str]) -> int:
    """Fold finished micro-batches into a new base and return its number (that of the old base if there is nothing to fold, -1 for none).

    A micro-batch is finished when a later one has been written: only the newest can be run again, so it is never folded,
    and its rerun replaces its folder as before. What the *previous* base made superfluous is removed after the switch;
    a reader that planned its scan before this call finds its files, and besides the newest base at most one older base
    and its folders stay. A call that ended at any point is made good by the next one. Call it between micro-batches or
    beside the stream, never twice at a time.
    """
    base, batches = _layout(spark, path)
    finished = batches[:-1]
    if not finished:
        return base
    upto = finished[-1]
    _newest(spark, path, keys, base, finished).write.mode("overwrite").parquet(_base(path, upto))
    for n in _numbered(spark, path, BATCH):
        if n <= base:
            _remove(spark, _changes(path, n))
    for n in _numbered(spark, f"{path}/{BASES}", UPTO):
        if n < base:
            _remove(spark, _base(path, n))
    return upto
