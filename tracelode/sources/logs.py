"""Line-oriented logs. The raw text and a stable 1-based line number stay with every record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clock import seconds_to_us
from ..functions.text import kv_field, kv_keys, kv_rest, kv_values
from ..operators.filters import five_tuple
from ..schemas import FIREWALL_FIELDS, SCHEMAS
from ..session import cut_lineage


# One row per input split, about 60 bytes each: the bound under which they are broadcast.
MAX_BROADCAST_SPLITS = 1_000_000


def text_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, line, raw`` of text files, numbered from 1 within each file without a global sort.

    A row's place inside its input split is known from the running id of its task. One pass counts
    the rows per split; adding up the splits before it gives the line number. The counts are
    checkpointed, so later reads need a single pass and, as long as there are fewer than a
    million splits, no shuffle of the text. Should the file system or the settings cut
    the splits another way later, the read fails instead of giving wrong numbers.
    """
    scan = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
        F.col("value").alias("raw"),
    )
    blocks = scan.groupBy("file", "__block").agg(F.min("__id").alias("__base"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(blocks.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))))
    if starts.count() <= MAX_BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    at = F.col("__id") - F.col("__base")
    placed = F.coalesce((at >= 0) & (at < F.col("__n")), F.lit(False))
    moved = F.raise_error(F.concat(F.lit("input splits changed since lines were counted: "), F.col("file")))
    line = F.when(placed, F.col("__before") + at + 1).otherwise(moved.cast("bigint"))
    return scan.join(starts, ["file", "__block"], "left").select("file", line.alias("line"), "raw")


def parse_json(lines: DataFrame, schema: str, required: Sequence[str] = ("ts",)) -> DataFrame:
    """JSON object per line under a declared schema; ``error`` says why a line is unusable."""
    parsed = lines.withColumn(
        "__j",
        F.from_json(
            "raw",
            f"{schema}, __corrupt STRING",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"},
        ),
    )
    missing = F.lit(False)
    for field in required:
        missing = missing | F.col(f"__j.`{field}`").isNull()
    error = F.when(F.col("__j.__corrupt").isNotNull() | F.col("__j").isNull(), "malformed JSON").when(
        missing, "required field missing"
    )
    return parsed.withColumn("error", error).select(*lines.columns, "__j.*", "error").drop("__corrupt")


def parse_kv(lines: DataFrame, fields: Sequence[str]) -> DataFrame:
    """key=value line; anything that is not a token makes the line an error."""
    tokens = lines.withColumn("__k", kv_keys(F.col("raw"))).withColumn("__v", kv_values(F.col("raw")))
    error = F.when(kv_rest(F.col("raw")) != "", "unparsed text")
    return tokens.select(
        *lines.columns, *[kv_field(F.col("__k"), F.col("__v"), field).alias(field) for field in fields],
        error.alias("error"),
    )


def fail_on_error(df: DataFrame) -> DataFrame:
    """Strict mode: the first unusable line stops the job."""
    where = F.concat(F.col("error"), F.lit(" in line "), F.col("line").cast("string"))
    ok = F.when(F.col("error").isNotNull(), F.raise_error(where).cast("boolean")).otherwise(F.lit(True))
    return df.where(ok).drop("error")


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and the errors table (file, line, raw, reason)."""
    good = df.where(F.col("error").isNull()).drop("error")
    return good, df.where(F.col("error").isNotNull()).select("file", "line", "raw", "error")


def _settle(df: DataFrame, strict: bool) -> DataFrame:
    return fail_on_error(df) if strict else df.where(F.col("error").isNull()).drop("error")


def canonical(df: DataFrame, source: str) -> DataFrame:
    """Canonical key columns and integer time for a parsed JSON source."""
    named = five_tuple(df, source)
    out = named.withColumn("ts_us", seconds_to_us(F.col("ts")))
    if "duration" in out.columns:
        out = out.withColumn("duration_us", seconds_to_us(F.col("duration")))
    return out.withColumnRenamed("TTLs", "ttls")


def read_jsonl(spark: SparkSession, path: str | Sequence[str], source: str, strict: bool = True) -> DataFrame:
    """A DNS, connection, flow or alert log with line numbers and canonical names."""
    return canonical(_settle(parse_json(text_lines(spark, path), SCHEMAS[source]), strict), source)


def firewall_columns(parsed: DataFrame) -> DataFrame:
    """Typed firewall columns from parsed tokens."""
    named = five_tuple(parsed, "firewall")
    return named.withColumn("sentbyte", F.col("sentbyte").cast("bigint")).withColumn(
        "rcvdbyte", F.col("rcvdbyte").cast("bigint")
    ).withColumn(
        "ts_us",
        F.unix_micros(F.try_to_timestamp(F.concat("date", F.lit(" "), "time"), F.lit("yyyy-MM-dd HH:mm:ss"))),
    )


def read_kv(
    spark: SparkSession, path: str | Sequence[str], fields: Sequence[str] = tuple(FIREWALL_FIELDS), strict: bool = True
) -> DataFrame:
    return _settle(parse_kv(text_lines(spark, path), fields), strict)


def read_firewall(spark: SparkSession, path: str | Sequence[str], strict: bool = True) -> DataFrame:
    return firewall_columns(read_kv(spark, path, strict=strict))


def parse_firewall(lines: DataFrame, raw: str = "value", strict: bool = True) -> DataFrame:
    """Firewall columns from rows that already hold a line number and raw text."""
    return firewall_columns(_settle(parse_kv(lines.withColumnRenamed(raw, "raw"), FIREWALL_FIELDS), strict))


def read_lines(df: DataFrame, start: int, limit: int, line: str = "line") -> DataFrame:
    """Lines ``start`` to ``start + limit - 1`` with where to go on and whether the end was reached."""
    page = df.where((F.col(line) >= start) & (F.col(line) < start + limit))
    last = df.agg(F.max(line)).scalar()
    return page.select(
        "*",
        F.when(last >= start + limit, F.lit(start + limit).cast("bigint")).alias("next_line"),
        (last < start + limit).alias("reached_eof"),
    )


def query_records(df: DataFrame, cond: Column | str, columns: Sequence[str]) -> DataFrame:
    """All records that satisfy a predicate; never a sample."""
    return df.where(cond).select(*columns)


def selected_records(sources: dict[str, DataFrame], host: str) -> dict[str, DataFrame]:
    """Each source's records of one host, raw line included when the source has it."""
    return {name: df.where((F.col("orig_h") == host) | (F.col("resp_h") == host)) for name, df in sources.items()}


def follow_text(spark: SparkSession, directory: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of ``file, raw`` from a directory that keeps receiving files."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .text(directory)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    )


def follow_jsonl(spark: SparkSession, directory: str, source: str, files_per_trigger: int = 100) -> tuple[DataFrame, DataFrame]:
    """Two streams: canonical records, and the lines that are none (file, raw, error).

    Line numbers belong to batch reads; ``file`` and ``raw`` locate rows here.
    """
    parsed = parse_json(follow_text(spark, directory, files_per_trigger), SCHEMAS[source])
    good, errors = _split_stream(parsed)
    return canonical(good, source), errors


def follow_firewall(spark: SparkSession, directory: str, files_per_trigger: int = 100) -> tuple[DataFrame, DataFrame]:
    """Two streams: firewall records, and the lines that are none (file, raw, error)."""
    good, errors = _split_stream(parse_kv(follow_text(spark, directory, files_per_trigger), FIREWALL_FIELDS))
    return firewall_columns(good), errors


def _split_stream(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.where(F.col("error").isNull()).drop("error"), parsed.where(F.col("error").isNotNull()).select("file", "raw", "error")
