"""Tables that change as a whole: a manifest names the folders that are valid, and readers take the last one.

Data is written under a new name first; then one small file is put in place by a rename, which file systems do at once
or not at all. A run that dies before it leaves the last manifest as it was, and only folders that nobody reads. Manifests
have numbers; two writers that want the same number cannot both get it, so that the later one fails instead of hiding the other.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

FOLDER = "_manifests"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def numbers(spark: SparkSession, table: str) -> list[int]:
    """The manifests that there are, the last one first."""
    fs, path = _fs(spark, table)
    folder = path(f"{table}/{FOLDER}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def latest(spark: SparkSession, table: str) -> tuple[int, dict]:
    """Number and content of the last manifest; 0 and nothing before the first."""
    found = numbers(spark, table)
    if not found:
        return 0, {}
    text = "".join(r.value for r in spark.read.text(f"{table}/{FOLDER}/{found[0]:012d}.json", wholetext=True).collect())  # one small file
    return found[0], json.loads(text)


def publish(spark: SparkSession, table: str, after: int, content: dict) -> int:
    """Put the manifest behind number ``after`` in place; fails if another writer was faster."""
    fs, path = _fs(spark, table)
    draft, final = path(f"{table}/{FOLDER}/draft-{uuid.uuid4().hex}"), path(f"{table}/{FOLDER}/{after + 1:012d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"{table} was changed by another writer since manifest {after}")
    return after + 1


def sweep(spark: SparkSession, table: str, kept: int = 2, spared: str | None = None) -> list[str]:
    """Delete the folders that none of the last ``kept`` manifests names, and older manifests. No writer may be at work.

    Folders whose names begin with ``spared`` stay.
    """
    fs, path = _fs(spark, table)
    found = numbers(spark, table)
    named = set()
    for n in found[:kept]:
        content = json.loads("".join(r.value for r in spark.read.text(f"{table}/{FOLDER}/{n:012d}.json", wholetext=True).collect()))
        named |= {f["folder"] for f in content.get("folders", [])}
    gone = []
    for s in fs.listStatus(path(table)):
        name = s.getPath().getName()
        if s.isDirectory() and not name.startswith("_") and name not in named and not (spared and name.startswith(spared)):
            fs.delete(s.getPath(), True)
            gone.append(name)
    for n in found[kept:]:
        fs.delete(path(f"{table}/{FOLDER}/{n:012d}.json"), False)
    return sorted(gone)
