"""Bundles written by the tasks that render them: ordered parts with a manifest, and the single file made of them.

A job's tasks write their parts into a staging folder of their own; only when all are
done does the driver name them, in the order of their ranges, and write the manifest,
last and at once. So a bundle has its manifest or is none, and what lost or repeated
tasks have written is never part of it. The single file is put together by tasks, too:
each part's place follows from the sizes of those before it. No text passes the driver.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "_manifest.json"
#: Bytes that are copied at once, and of a part at most: a larger one is copied by several tasks.
CHUNK, STRETCH = 4 << 20, 256 << 20


@dataclass
class _Written(WriterCommitMessage):
    part: int
    file: str
    size: int
    chars: int
    rows: int


class _BundleWriter(DataSourceArrowWriter):
    """Option path. Rows' column text is written as it stands, one after the other; partitions are the bundle's parts, in their order."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = os.path.abspath(options["path"]), overwrite
        if not overwrite and os.path.exists(os.path.join(self.path, MANIFEST)):
            raise FileExistsError(f"{self.path} holds a bundle")
        self.staging = os.path.join(self.path, f".staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        os.makedirs(self.staging, exist_ok=True)
        # Each attempt has a file of its own.
        file = os.path.join(self.staging, f"part-{task.partitionId():05d}-{task.taskAttemptId()}")
        size = chars = rows = 0
        with open(file, "wb") as out:
            for batch in iterator:
                for text in batch.column("text").to_pylist():
                    if text is not None:
                        data = text.encode("utf-8", "surrogatepass")
                        out.write(data)
                        size += len(data)
                        # UTF-16 units: one a character, and one more for each of four bytes.
                        chars += len(text) + (sum(c > "￿" for c in text) if len(data) > len(text) else 0)
                        rows += 1
            out.flush()
            os.fsync(out.fileno())
        return _Written(task.partitionId(), file, size, chars, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        old = _manifest_parts(self.path) if self.overwrite else []
        parts, offset = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            name = f"part-{len(parts):05d}-{os.path.basename(self.staging)[9:]}"
            os.replace(m.file, os.path.join(self.path, name))
            parts.append({"file": name, "offset": offset, "size": m.size, "chars": m.chars, "rows": m.rows})
            offset += m.size
        os.makedirs(self.path, exist_ok=True)
        new = os.path.join(self.path, f".{MANIFEST}-{uuid.uuid4().hex}")
        with open(new, "w", encoding="utf-8") as f:
            json.dump({"size": offset, "chars": sum(p["chars"] for p in parts), "rows": sum(p["rows"] for p in parts), "parts": parts}, f)
        os.replace(new, os.path.join(self.path, MANIFEST))
        for p in old:
            _gone(os.path.join(self.path, p["file"]))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def _gone(path: str) -> None:
    try:
        os.remove(path)
    except FileNotFoundError:
        pass


def _manifest_parts(path: str) -> list[dict]:
    try:
        return manifest(path)["parts"]
    except FileNotFoundError:
        return []


class BundleSink(DataSource):
    """Texts to a folder that driver and executors share: ``df.write.format("bundle").mode("append").save(path)`` for a new bundle, overwrite to replace one once the new one is whole."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return "text string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _BundleWriter(self.options, overwrite)


def manifest(path: str) -> dict:
    """size (bytes), chars (UTF-16 units), rows, and the parts in order: file, offset, size, chars, rows."""
    with open(os.path.join(path, MANIFEST), encoding="utf-8") as f:
        return json.load(f)


def write_parts(pieces: DataFrame, path: str, parts: int | None = None, overwrite: bool = False) -> dict:
    """Writes pieces (section, ord, text) as a bundle ordered by section and ord; gives the manifest. parts: how many at most; left to Spark by default."""
    pieces.sparkSession.dataSource.register(BundleSink)
    keys = ("section", "ord")
    ordered = (pieces.repartitionByRange(parts, *keys) if parts else pieces.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    ordered.select("text").write.format("bundle").mode("overwrite" if overwrite else "append").save(path)
    return manifest(path)


def join_parts(spark: SparkSession, path: str, target: str) -> int:
    """Puts the parts together to the file target, which appears whole or not at all; gives its size. path and target are on a disk that driver and executors share."""
    whole = manifest(path)
    target = os.path.abspath(target)
    new = f"{target}.{uuid.uuid4().hex}"
    with open(new, "wb") as f:
        f.truncate(whole["size"])
    stretches = [(os.path.join(os.path.abspath(path), p["file"]), a, min(STRETCH, p["size"] - a), p["offset"] + a) for p in whole["parts"] for a in range(0, p["size"], STRETCH)]

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task that runs again writes the same bytes to the same place."""
        done = 0
        for b in batches:
            for r in b.to_pylist():
                with open(r["file"], "rb") as part, open(new, "r+b") as out:
                    part.seek(r["start"])
                    out.seek(r["at"])
                    left = r["size"]
                    while left and (data := part.read(min(CHUNK, left))):
                        out.write(data)
                        left -= len(data)
                    done += r["size"] - left
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["done"])

    try:
        done = 0
        if stretches:
            rows = spark.createDataFrame(stretches, "file string, start long, size long, at long").repartition(min(len(stretches), 10_000))
            done = rows.mapInArrow(copy, "done long").agg(F.sum("done")).first()[0] or 0
        if done != whole["size"]:
            raise OSError(f"{path}: {done} of {whole['size']} bytes are there")
        os.replace(new, target)
    except BaseException:
        _gone(new)
        raise
    return whole["size"]
