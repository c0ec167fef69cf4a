"""Inventories of files and archive members, and the evidence manifest."""

from __future__ import annotations

import hashlib
import zipfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MANIFEST
from .files import BLOCK, list_files, open_binary, spread


def _digest(stream) -> tuple[int, str]:
    h, total = hashlib.sha256(), 0
    while block := stream.read(BLOCK):
        h.update(block)
        total += len(block)
    return total, h.hexdigest()


def _file_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for name in batch.column("file").to_pylist():
            with open_binary(name) as f:
                size, digest = _digest(f)
            out.append({"file": name, "bytes": size, "sha256": digest})
        if out:
            yield pa.RecordBatch.from_pylist(out)


def file_inventory(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, bytes, sha256`` of every file, streamed in blocks, so any size works."""
    files = list_files(spark, path).select("file")
    return spread(files, files.count()).mapInArrow(_file_rows, "file STRING, bytes BIGINT, sha256 STRING")


_MEMBER = pa.schema(
    [
        ("archive", pa.string()), ("archive_sha256", pa.string()), ("member", pa.string()),
        ("bytes", pa.int64()), ("sha256", pa.string()), ("copies", pa.int64()), ("problem", pa.string()),
    ]
)


# Members of an archive that go on together.
_ROWS = 1000


def _archive_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name in batch.column("file").to_pylist():
            out = []
            with open_binary(name) as f:
                _, outer = _digest(f)
                f.seek(0)
                base = {"archive": name.rsplit("/", 1)[-1], "archive_sha256": outer}
                try:
                    with zipfile.ZipFile(f) as z:
                        for member, copies in Counter(z.namelist()).items():
                            row = {**base, "member": member, "copies": copies, "problem": None}
                            if "/" in member or "\\" in member:
                                row["problem"] = "member name has a path"
                            elif copies != 1:
                                row["problem"] = "duplicate member"
                            else:
                                with z.open(member) as m:
                                    row["bytes"], row["sha256"] = _digest(m)
                            out.append(row)
                            if len(out) == _ROWS:
                                yield pa.RecordBatch.from_pylist(out, schema=_MEMBER)
                                out = []
                except zipfile.BadZipFile as error:
                    out.append({**base, "problem": f"not a readable archive: {error}"})
            yield pa.RecordBatch.from_pylist(out, schema=_MEMBER)


def archive_inventory(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Members of ZIP archives with size and hash; one task per archive, contents streamed."""
    files = list_files(spark, path).select("file")
    return spread(files, files.count()).mapInArrow(
        _archive_rows,
        "archive STRING, archive_sha256 STRING, member STRING, bytes BIGINT, sha256 STRING, copies BIGINT, problem STRING",
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per expected source."""
    doc = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select("case_id", "source_relationship", F.explode("sources").alias("s")).select(
        "case_id", "source_relationship", "s.*"
    )
