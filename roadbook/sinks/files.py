"""Folders and small marks on whatever file system the cluster uses."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def children(spark: SparkSession, path: str) -> dict[str, float]:
    """Names in a folder with the seconds since each was changed; none if there is no folder."""
    system, place = _place(spark, path)
    if not system.exists(place):
        return {}
    now = time.time()
    return {s.getPath().getName(): now - s.getModificationTime() / 1000 for s in system.listStatus(place)}


def matching(spark: SparkSession, path: str, pattern: str) -> dict[str, float]:
    """Folders below ``path`` whose relative names match a pattern like ``a=*/b=*``, with the seconds since each was changed."""
    system, place = _place(spark, f"{path}/{pattern}")
    depth, now = pattern.count("/") + 1, time.time()
    return {
        "/".join(s.getPath().toString().split("/")[-depth:]): now - s.getModificationTime() / 1000
        for s in system.globStatus(place) or []
    }


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    system, place = _place(spark, path)
    system.delete(place, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder; one of that name is replaced."""
    system, place = _place(spark, path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    if system.exists(target):
        system.delete(target, True)
    if not system.rename(place, target):
        raise OSError(f"{path} could not be renamed to {to}")


def new_run() -> str:
    """A name for a run; later ones come later in order."""
    return f"r{time.time_ns() // 1_000_000:015d}{uuid.uuid4().hex[:4]}"


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """A name for the run that a checkpoint belongs to: equal as long as the checkpoint lives, and
    later in order for a checkpoint made later."""
    marks = [n for n in children(spark, f"{checkpoint}/run") if n.startswith("r")]
    if marks:
        return min(marks)
    name = new_run()
    system, place = _place(spark, f"{checkpoint}/run/{name}")
    system.mkdirs(place)
    return name
