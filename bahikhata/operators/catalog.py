"""A store of several Parquet tables that change together: one manifest names the folder of each, and writing it is the commit.

A run writes its tables into folders of their own and then one manifest with the next number. Until then readers see the tables of the last
one, and a run that fails leaves them so and takes its folders away. Two runs at once can't both write the same number; the later one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Step = tuple[int, dict[str, Callable[[DataFrame], DataFrame]]]


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, root: str) -> dict:
    """{"number", "schema", "tables"} of the last whole manifest; number 0 and no tables before the first."""
    where, fs = _at(spark, f"{root}/manifests")
    names = sorted((s.getPath().toString() for s in fs.listStatus(where)), reverse=True) if fs.exists(where) else []
    for name in names:
        path, fs = _at(spark, name)
        stream = fs.open(path)
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if text.endswith("\n"):
            return json.loads(text)
    return {"number": 0, "schema": 0, "tables": {}}


def table(spark: SparkSession, root: str, name: str, now: dict | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/{(now or manifest(spark, root))['tables'][name]}")


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], now: dict | None = None, schema: int | None = None) -> dict:
    """Puts ``tables`` in place of those of their names, all or none, and gives the new manifest. ``now`` is the manifest that they were made of."""
    now = now or manifest(spark, root)
    made = {name: f"data/{name}-{uuid.uuid4().hex}" for name in tables}
    new = {"number": now["number"] + 1, "schema": now["schema"] if schema is None else schema, "tables": {**now["tables"], **made}}
    try:
        for name, rows in tables.items():
            rows.write.parquet(f"{root}/{made[name]}")
        path, fs = _at(spark, f"{root}/manifests/{new['number']:020d}.json")
        out = fs.create(path, False)  # fails if another run was first
        out.write(bytearray((json.dumps(new) + "\n").encode()))
        out.close()
    except BaseException:
        for folder in made.values():
            path, fs = _at(spark, f"{root}/{folder}")
            fs.delete(path, True)
        raise
    return new


def cleaned(spark: SparkSession, root: str) -> int:
    """Removes folders that the last manifest doesn't name; gives their number. Only while nothing reads or writes the store."""
    used = set(manifest(spark, root)["tables"].values())
    where, fs = _at(spark, f"{root}/data")
    gone = [s.getPath() for s in fs.listStatus(where) if f"data/{s.getPath().getName()}" not in used] if fs.exists(where) else []
    for path in gone:
        fs.delete(path, True)
    return len(gone)


def upgraded(spark: SparkSession, root: str, steps: list[Step], baseline: int = 0, marks: tuple[str, str] | None = None) -> list[int]:
    """Takes the steps above the store's version, in order, each with a commit of its own; gives the versions reached.

    A step says for each table that it changes how. A store without a version whose table ``marks[0]`` has the column ``marks[1]`` is older than
    versions and counts as ``baseline``. A step that fails leaves the versions before it, so the next run goes on there.
    """
    now, reached = manifest(spark, root), []
    if now["schema"] == 0 and marks and marks[0] in now["tables"] and marks[1] in table(spark, root, marks[0], now).columns:
        now = commit(spark, root, {}, now, baseline)
    for version, changes in sorted((s for s in steps if s[0] > now["schema"]), key=lambda s: s[0]):
        now = commit(spark, root, {name: change(table(spark, root, name, now)) for name, change in changes.items() if name in now["tables"]}, now, version)
        reached.append(version)
    return reached
