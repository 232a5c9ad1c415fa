"""Small files that say what is finished, written through the cluster's own file system.

A table is written to a new folder first and named in such a file last. The file appears by a rename, so readers see the old entry
or the new one, never a part, and two writers leave the whole work of one of them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, entry: Mapping) -> None:
    """Put ``entry`` as JSON at ``path``, in place of what is there."""
    fs = spark._jvm.org.apache.hadoop.fs
    target, system = _hadoop(spark, path)
    draft = fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    stream = system.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
    finally:
        stream.close()
    kind = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    draft, target = system.makeQualified(draft), system.makeQualified(target)
    fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, how)


def published(spark: SparkSession, path: str) -> dict | None:
    """The entry at ``path``, None if there is none."""
    target, system = _hadoop(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder to a name that isn't taken."""
    from_, system = _hadoop(spark, source)
    to, _ = _hadoop(spark, target)
    system.mkdirs(to.getParent())
    if system.exists(to) or not system.rename(from_, to):
        raise FileExistsError(f"{target} is there already")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``."""
    target, system = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(target) if s.isDirectory())


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files right below ``path``, none if it isn't there; drafts aren't listed."""
    target, system = _hadoop(spark, path)
    found = system.listStatus(target) if system.exists(target) else []
    return sorted(s.getPath().getName() for s in found if s.isFile() and not s.getPath().getName().startswith("."))


def cache_key(spark: SparkSession, inputs: Sequence[str], options: Mapping) -> str:
    """A digest of the names, sizes and times of all files that ``inputs`` (paths or patterns) hold, and of the options."""
    seen = []
    for path in inputs:
        pattern, system = _hadoop(spark, path)
        found = []
        for status in system.globStatus(pattern) or []:
            files = system.listFiles(status.getPath(), True)
            while files.hasNext():
                file = files.next()
                found.append([file.getPath().toString(), file.getLen(), file.getModificationTime()])
        if not found:
            raise FileNotFoundError(path)
        seen.append(sorted(found))
    return hashlib.sha256(json.dumps([seen, options], sort_keys=True, default=str).encode()).hexdigest()
