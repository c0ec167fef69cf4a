"""Classic packet captures (little-endian, version 2.4, Ethernet).

Two ways in:

* ``spark.read.format("pcap").load(path)`` after ``register(spark)``: one task per file, for
  captures that are rotated by size.
* ``read_pcap(spark, path)``: any file size. Byte ranges of a file are walked in parallel; each
  finds its first record by looking for a chain of plausible headers. That guess is then
  checked: every range must begin where the range before it ended. A file that fails the
  check is walked from its start, so packet numbers are always exact.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import PACKET_RECORD
from ..session import cut_lineage
from .files import list_files, open_binary, spread

# Fixed values of the file format.
MAGIC = bytes.fromhex("d4c3b2a1")
FILE_HEADER, RECORD_HEADER = 24, 16
MAX_RECORD = 1 << 18

_HEADER = struct.Struct("<IIII")
_CHAIN = 8
_BATCH_ROWS, _BATCH_BYTES = 4096, 8 << 20

_ARROW = pa.schema(
    [
        ("packet", pa.int64()), ("ts_us", pa.int64()), ("caplen", pa.int32()), ("wirelen", pa.int32()),
        ("frame", pa.binary()), ("file", pa.string()),
    ]
)


class CaptureError(ValueError):
    """The bytes are not a capture this reader supports."""


def check_file_header(head: bytes, name: str) -> None:
    if head[:4] != MAGIC:
        raise CaptureError(f"{name}: not a little-endian classic capture")
    major, minor = struct.unpack_from("<HH", head, 4)
    (link,) = struct.unpack_from("<I", head, 20)
    if (major, minor, link) != (2, 4, 1):
        raise CaptureError(f"{name}: version {major}.{minor} link type {link} is not supported")


def _plausible(header: tuple[int, int, int, int]) -> bool:
    _sec, usec, caplen, wirelen = header
    return usec < 1_000_000 and 14 <= caplen <= MAX_RECORD and caplen <= wirelen <= 4 * MAX_RECORD


def _chain_holds(data: bytes, at: int, base: int, size: int) -> bool:
    """True when plausible records follow each other from ``at``, or run to the exact file end."""
    for _ in range(_CHAIN):
        if base + at == size:
            return True
        if at + RECORD_HEADER > len(data):
            return False
        header = _HEADER.unpack_from(data, at)
        if not _plausible(header):
            return False
        at += RECORD_HEADER + header[2]
    return True


def _find_record(f, start: int, stop: int, size: int) -> int | None:
    """Offset of the first record that begins in ``[start, stop)``."""
    reach = _CHAIN * (MAX_RECORD + RECORD_HEADER)
    step = 1 << 20
    for base in range(start, stop, step):
        f.seek(base)
        data = f.read(step + reach)
        for at in range(min(step, stop - base, len(data))):
            if _chain_holds(data, at, base, size):
                return base + at
    return None


def _walk(f, at: int, stop: int, size: int, name: str) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
    """Offsets and headers of the records that begin before ``stop``."""
    while at < stop:
        f.seek(at)
        head = f.read(RECORD_HEADER)
        if len(head) < RECORD_HEADER:
            raise CaptureError(f"{name}: record header cut short at byte {at}")
        header = _HEADER.unpack(head)
        after = at + RECORD_HEADER + header[2]
        if after > size:
            raise CaptureError(f"{name}: record cut short at byte {at}")
        yield at, header
        at = after


_SPLIT = "file STRING, size BIGINT, start BIGINT, stop BIGINT"
_INDEXED = f"{_SPLIT}, first BIGINT, next BIGINT, records BIGINT, problem STRING"


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            name, size, start, stop = row["file"], row["size"], row["start"], row["stop"]
            first = after = problem = None
            records = 0
            with open_binary(name) as f:
                try:
                    if start == 0:
                        check_file_header(f.read(FILE_HEADER), name)
                        at = FILE_HEADER if size > FILE_HEADER else None
                    else:
                        at = _find_record(f, start, stop, size)
                    if at is not None and at < stop:
                        first = at
                        for at, header in _walk(f, at, stop, size, name):
                            records += 1
                            after = at + RECORD_HEADER + header[2]
                except CaptureError as error:
                    problem = str(error)
            out.append({**row, "first": first, "next": after, "records": records, "problem": problem})
        yield pa.RecordBatch.from_pylist(
            out,
            schema=pa.schema(
                [("file", pa.string())]
                + [(n, pa.int64()) for n in ("size", "start", "stop", "first", "next", "records")]
                + [("problem", pa.string())]
            ),
        )


def capture_index(spark: SparkSession, path: str | list[str], split_bytes: int = 64 << 20) -> DataFrame:
    """Byte ranges of captures with their first record and first packet number.

    Columns: ``file, size, first, stop, records, first_packet``. Write it as Parquet to reuse it.
    """
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))
    pieces = list_files(spark, path).withColumn("start", F.explode(starts))
    splits = pieces.select("file", "size", "start", F.least(F.col("start") + split_bytes, F.col("size")).alias("stop"))
    found = cut_lineage(spread(splits, splits.count()).mapInArrow(_index_rows, _INDEXED))

    # A range is sound when it starts at the end of the last range that held a record.
    by_file = Window.partitionBy("file").orderBy("start")
    before = F.last("next", ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    expected = F.coalesce(before, F.when(F.col("start") == 0, F.lit(FILE_HEADER)))
    sound = (
        F.when(F.col("problem").isNotNull(), F.lit(False))
        .when(F.col("first").isNull(), (F.coalesce(before, F.lit(FILE_HEADER)) >= F.col("stop")))
        .otherwise(F.col("first") == expected)
    )
    checked = found.withColumn("__ok", sound)
    whole = checked.groupBy("file").agg(F.bool_and("__ok").alias("__good"))
    judged = checked.join(whole, "file")
    broken = judged.where(~F.col("__good")).select(
        "file", "size", F.lit(0).cast("bigint").alias("start"), F.col("size").alias("stop")
    ).distinct()
    repaired = broken.mapInArrow(_index_rows, _INDEXED)
    total = judged.where("__good").select(*repaired.columns).unionByName(repaired)
    ok = F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("boolean")).otherwise(F.lit(True))
    upto = by_file.rowsBetween(Window.unboundedPreceding, -1)
    return (
        total.where(ok)
        .withColumn("first_packet", F.coalesce(F.sum("records").over(upto), F.lit(0)) + 1)
        .where("records > 0")
        .select("file", "size", "first", "stop", "records", "first_packet")
    )


def _batches(f, name: str, first: int, stop: int, size: int, number: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0
    for at, (sec, usec, caplen, wirelen) in _walk(f, first, stop, size, name):
        frame = f.read(caplen)
        rows.append((number, sec * 1_000_000 + usec, caplen, wirelen, frame, name))
        number, held = number + 1, held + caplen
        if len(rows) >= _BATCH_ROWS or held >= _BATCH_BYTES:
            yield _to_batch(rows)
            rows, held = [], 0
    if rows:
        yield _to_batch(rows)


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), _ARROW)], schema=_ARROW
    )


def _frame_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with open_binary(row["file"]) as f:
                yield from _batches(f, row["file"], row["first"], row["stop"], row["size"], row["first_packet"])


def read_pcap(
    spark: SparkSession,
    path: str | list[str],
    split_bytes: int = 64 << 20,
    index: DataFrame | None = None,
    packets: tuple[int, int] | None = None,
) -> DataFrame:
    """Numbered raw frames of captures of any size, one task per byte range.

    ``packets`` keeps packet numbers ``first`` to ``last`` (inclusive, per file) and reads only the
    byte ranges that hold them.
    """
    ranges = cut_lineage(capture_index(spark, path, split_bytes)) if index is None else index
    if packets is not None:
        first, last = packets
        ranges = ranges.where((F.col("first_packet") <= last) & (F.col("first_packet") + F.col("records") > first))
    frames = spread(ranges, ranges.count()).mapInArrow(_frame_rows, PACKET_RECORD)
    return frames if packets is None else frames.where(F.col("packet").between(*packets))


class _FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PcapReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        uri = self.path if "://" in self.path or self.path.startswith("file:") else None
        system, inside = fs.FileSystem.from_uri(uri) if uri else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(inside)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            found = system.get_file_info(fs.FileSelector(inside, recursive=True))
        scheme = f"{uri.split('://')[0]}://" if uri and "://" in uri and not uri.startswith("file:") else ""
        return [
            _FilePart(scheme + i.path)
            for i in found
            if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))
        ]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open_binary(partition.path) as f:
            size = f.seek(0, 2)
            f.seek(0)
            check_file_header(f.read(FILE_HEADER), partition.path)
            yield from _batches(f, partition.path, FILE_HEADER, size, size, 1)


class PcapDataSource(DataSource):
    """``spark.read.format("pcap")``: one partition per file, packet numbers per file."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return PACKET_RECORD

    def reader(self, schema) -> DataSourceReader:
        return PcapReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapDataSource)
