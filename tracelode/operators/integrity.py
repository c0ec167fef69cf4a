"""Measured files against the manifest, and fingerprints of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class IntegrityError(RuntimeError):
    """Evidence is missing or is not what the manifest says."""


def inventory_report(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """Measured and expected side by side, one row per archive member known to either."""
    wanted = manifest.select(
        "id", "archive", "member", F.col("bytes").alias("bytes_expected"), F.col("sha256").alias("sha256_expected"),
        F.col("archive_sha256").alias("archive_sha256_expected"),
    )
    measured = inventory.select(
        "archive", "member", F.col("bytes").alias("bytes_measured"), F.col("sha256").alias("sha256_measured"),
        F.col("archive_sha256").alias("archive_sha256_measured"), "problem",
    )
    joined = wanted.join(measured, ["archive", "member"], "full_outer")
    same = (
        F.col("bytes_expected").eqNullSafe(F.col("bytes_measured"))
        & F.col("sha256_expected").eqNullSafe(F.col("sha256_measured"))
        & F.col("archive_sha256_expected").eqNullSafe(F.col("archive_sha256_measured"))
    )
    return joined.select(
        "*",
        F.when(F.col("id").isNull(), "not_in_manifest")
        .when(F.col("problem").isNotNull(), "bad_archive")
        .when(F.col("sha256_measured").isNull(), "missing")
        .when(~same, "differs")
        .otherwise("verified")
        .alias("status"),
        (same & F.col("id").isNotNull()).alias("matches_manifest"),
    )


def require_verified(report: DataFrame, allow_extra: bool = False) -> int:
    """Stop unless every expected member is verified. Returns the number of verified members."""
    counted = report.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("example"))
    # At most one row per status.
    found = {row["status"]: row for row in counted.collect()}
    allowed = {"verified"} | ({"not_in_manifest"} if allow_extra else set())
    bad = [f"{status}: {row['n']} (e.g. {row['example']})" for status, row in found.items() if status not in allowed]
    if bad:
        raise IntegrityError("; ".join(sorted(bad)))
    return found["verified"]["n"] if "verified" in found else 0


def row_print(columns: list[str]) -> Column:
    """120 bits of a row's SHA-256 as two numbers that can be added up. Nulls keep their place, so a value that moves to
    another column changes the row."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}), 256)
    word = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
    return F.struct(word(1).alias("x"), word(16).alias("y"))


def fingerprint(df: DataFrame, name: str = "table") -> DataFrame:
    """Row count and an order-free content sum. A plain xor would hide duplicated rows."""
    rows = df.select(row_print(sorted(df.columns)).alias("p"))
    content = F.concat_ws("-", F.sum("p.x").cast("string"), F.sum("p.y").cast("string"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), content.alias("content_sum")).select(F.lit(name).alias("output"), "rows", "content_sum")


def receipt(spark: SparkSession, out_dir: str, inputs: DataFrame | None = None) -> DataFrame:
    """Hash of every output file and, if given, of the input files and code."""
    from ..sources.archive import file_inventory

    out = file_inventory(spark, out_dir).withColumn("role", F.lit("output"))
    return out if inputs is None else out.unionByName(inputs.withColumn("role", F.lit("input")))
