"""Atomic publication: a write becomes visible as a whole, or not at all.

A publication goes to a run folder of its own, under ``path/_runs``, and is committed by
one small manifest file, renamed into ``path/_manifests`` after everything is written.
Readers resolve the newest manifest. Until the rename they see the previous run, whole;
a write that fails leaves a run folder that nothing names, and a later publication
removes it. Of two writers that commit the same number the second fails. The runs of the
last ``KEEP`` manifests stay for readers that have resolved them already.
"""

from __future__ import annotations

import json
import uuid
from typing import Callable, Mapping

from pyspark.sql import SparkSession

RUNS, MANIFESTS = "_runs", "_manifests"
KEEP = 2


def _files(spark: SparkSession, path: str):
    """The Hadoop ``Path`` class and the file system of a path: whatever Spark can reach."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make, make(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, folder: str) -> list[str]:
    make, fs = _files(spark, folder)
    at = make(folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    names = _listed(spark, f"{path}/{MANIFESTS}")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def _manifest(path: str, number: int) -> str:
    return f"{path}/{MANIFESTS}/{number:09d}.json"


def published(spark: SparkSession, path: str) -> dict[str, str] | None:
    """Folders by name of the newest publication under ``path`` (None if there is none)."""
    path = path.rstrip("/")
    numbers = _numbers(spark, path)
    if not numbers:
        return None
    make, fs = _files(spark, path)
    stream = fs.open(make(_manifest(path, numbers[-1])))
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return {name: f"{path}/{RUNS}/{folder}" for name, folder in json.loads(text).items()}


def publish(spark: SparkSession, path: str, writes: Mapping[str, Callable[[str], object]]) -> dict[str, str]:
    """Runs every write on a new folder and commits them together; returns the folders by name.

    A write that raises leaves the previous publication as it was.
    """
    path = path.rstrip("/")
    number = (_numbers(spark, path) or [0])[-1] + 1
    run = f"{number:09d}-{uuid.uuid4().hex}"
    for name, write in writes.items():
        write(f"{path}/{RUNS}/{run}/{name}")
    _commit(spark, path, number, json.dumps({name: f"{run}/{name}" for name in writes}))
    _prune(spark, path, number)
    return {name: f"{path}/{RUNS}/{run}/{name}" for name in writes}


def _commit(spark: SparkSession, path: str, number: int, text: str) -> None:
    """Writes the manifest beside its place and renames it there, which fails where one exists."""
    make, fs = _files(spark, path)
    draft, place = make(f"{path}/{MANIFESTS}/.{uuid.uuid4().hex}"), make(_manifest(path, number))
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    jvm = spark._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(draft, place, spark.sparkContext._gateway.new_array(rename, 0))  # never over an existing one


def _prune(spark: SparkSession, path: str, number: int) -> None:
    """Removes manifests and runs older than the ``KEEP`` newest; no writer can still commit those."""
    make, fs = _files(spark, path)
    for old in _numbers(spark, path):
        if old <= number - KEEP:
            fs.delete(make(_manifest(path, old)), False)
    for run in _listed(spark, f"{path}/{RUNS}"):
        if int(run.split("-")[0]) <= number - KEEP:
            fs.delete(make(f"{path}/{RUNS}/{run}"), True)
