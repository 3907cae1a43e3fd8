"""Id blocks for writers that work at the same time: optimistic reservation in numbered files.

A warehouse's reservations are files ``reserved/block-<number>``; each holds the first free id of every counter after it. A
writer reads the last one, adds what it needs and publishes the next number. Publishing fails if that number exists, so of
writers that chose the same one, one wins and the others read again. Blocks follow each other without gaps or overlap.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Mapping
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

ATTEMPTS = 1000
_NAME = "block-{:012d}"


def _local(path: str) -> str | None:
    """The path on a mounted file system, None for another one."""
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """A file with this text, whole or not at all; False if ``path`` exists.

    A mounted file system links a finished file to its name, another one renames it: both fail on a name that is taken.
    """
    jvm, beside = spark._jvm, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    place = _local(path)
    if place is not None:
        os.makedirs(os.path.dirname(place), exist_ok=True)
        own = _local(beside)
        with open(own, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(own, place)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(beside)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(source, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    done = not fs.exists(target) and fs.rename(source, target)
    if not done:
        fs.delete(source, False)
    return done


def _last(spark: SparkSession, folder: str) -> tuple[int, dict[str, int]] | None:
    """Number and counters of the last block."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    numbers = [int(n.removeprefix("block-")) for n in names if n.startswith("block-")]
    if not numbers:
        return None
    number = max(numbers)
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_NAME.format(number)}"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return number, json.loads(text)


def reserve(spark: SparkSession, warehouse: str, sizes: Mapping[str, int], first: Callable[[], Mapping[str, int]]) -> dict[str, int]:
    """The first id of a new block of ``sizes`` ids per counter, for this writer alone.

    ``first`` tells the first free ids of a warehouse without reservations. Ids of a writer that fails stay unused.
    """
    if any(n < 0 for n in sizes.values()):
        raise ValueError(f"sizes must not be negative, got {dict(sizes)}")
    folder = f"{warehouse.rstrip('/')}/reserved"
    for _ in range(ATTEMPTS):
        last = _last(spark, folder)
        number, free = last if last else (-1, {k: int(v) for k, v in first().items()})
        start = {k: free.get(k, 0) for k in sizes}
        if publish(spark, f"{folder}/{_NAME.format(number + 1)}", json.dumps({**free, **{k: start[k] + n for k, n in sizes.items()}})):
            return start
    raise RuntimeError(f"no block could be reserved in {ATTEMPTS} attempts")
