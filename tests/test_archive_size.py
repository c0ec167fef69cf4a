"""Archives of many members, and more documents than fit the fewest archives."""

import zipfile

from pyspark.sql import functions as F

from tracelode.plans import q_sources
from tracelode.sources import archive


def test_more_documents_make_more_archives(spark, tmp_path):
    n = 9 * q_sources.PER_ARCHIVE + 1
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("en").alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
    got = archive.archive_inventory(spark, q_sources._archives(spark, str(tmp_path)))
    assert got.select("archive").distinct().count() == 10 and got.where("bytes = 1 and copies = 1").count() == n


def test_names_are_counted_in_one_pass(tmp_path, monkeypatch):
    """Each name is compared a few times, however many members there are."""
    path, compared = str(tmp_path / "a.zip"), []

    class Name(str):
        __hash__ = str.__hash__

        def __eq__(self, other):
            compared.append(1)
            return str.__eq__(self, other)

    with zipfile.ZipFile(path, "w") as z:
        for i in range(3000):
            z.writestr(f"m{i}", b"x")
    listed = zipfile.ZipFile.namelist
    monkeypatch.setattr(zipfile.ZipFile, "namelist", lambda z: [Name(n) for n in listed(z)])
    import pyarrow as pa

    rows = [r for b in archive._archive_rows(iter([pa.RecordBatch.from_pydict({"file": [path]})])) for r in b.to_pylist()]
    assert len(rows) == 3000 and {r["copies"] for r in rows} == {1} and len({r["member"] for r in rows}) == 3000
    assert len(compared) < 60_000
