"""Files written from tables, so that the readers can be checked against the tables."""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..sources.pcap import MAGIC


def create(path: str) -> BinaryIO:
    """A writable file below a folder that tasks share."""
    from pyarrow import fs

    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    system, inside = fs.FileSystem.from_uri(uri)
    system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inside)


def _part(folder: str, suffix: str) -> str:
    context = TaskContext.get()
    return f"{folder}/part-{context.partitionId():05d}{suffix}"


def write_captures(frames: DataFrame, folder: str) -> DataFrame:
    """One capture file per partition; returns the written paths (run it to write)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _part(folder, ".pcap")
        with create(path) as f:
            f.write(MAGIC + struct.pack("<HHiIII", 2, 4, 0, 0, 262144, 1))
            for batch in batches:
                for ts, cap, wire, frame in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    f.write(struct.pack("<IIII", ts // 1_000_000, ts % 1_000_000, cap, wire) + frame)
        yield pa.RecordBatch.from_pydict({"path": [path]})

    return frames.select("ts_us", "caplen", "wirelen", "frame").mapInArrow(write, "path STRING")


def write_archives(members: DataFrame, folder: str) -> DataFrame:
    """One ZIP per partition from ``name, content`` rows; returns the written paths."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _part(folder, ".zip")
        with create(path) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in batches:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                    z.writestr(name, content)
        yield pa.RecordBatch.from_pydict({"path": [path]})

    return members.select("name", "content").mapInArrow(write, "path STRING")
