"""Token counts kept as delta-maintained rollups.

A batch of changes (inserts, deletes, revised counts) becomes signed rows per document; their sums by source, language and
tokenizer version are added to the totals. A batch is a folder named by its id: it counts once it is complete, and
a batch that is committed again changes nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MULTILINGUAL = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published split pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEY = ["source", "lang", "version"]
SUMS = ["documents", "tokens", "bytes"]
#: Longest run of text given to the tokenizer at once; a cut falls before white space, where no token crosses it.
PIECE = 100_000


def count_tokens(docs: DataFrame, vocabulary: str, version: str) -> DataFrame:
    """doc_id, source, lang, version, tokens, bytes of every row; null texts have 0 of both. Other columns are not read.

    The vocabulary file is read once by the driver and shared (under 2 MB).
    """
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in shared.value.splitlines() if line)}
        encoder = tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [sum(len(encoder.encode_ordinary(p)) for p in pieces(text)) for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(counts, pa.int64()), batch.column(4)], ["doc_id", "source", "lang", "tokens", "bytes"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "source", "lang"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    made = docs.select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"), size.alias("bytes"))
    return made.mapInArrow(run, f"{kinds}, tokens long, bytes long").withColumn("version", F.lit(version))


def pieces(text: str) -> Iterator[str]:
    """The text, in runs of about PIECE characters cut before a single space between two visible characters."""
    lo = 0
    while len(text) - lo > PIECE:
        hi = lo + PIECE
        while hi < len(text) and not (text[hi] == " " and not text[hi - 1].isspace() and hi + 1 < len(text) and not text[hi + 1].isspace()):
            hi += 1
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


class Rollup:
    """Totals below ``path`` (a folder every executor sees): ``ledger`` has the signed rows, ``delta`` the sums, by batch.

    Nulls are keys like others. A null doc_id counts but cannot be deleted or revised, as no id names it. Rows repeated
    in a batch count as often as they stand there. An empty batch changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _complete(self, kind: str) -> list[str]:
        """Folders of complete batches, in the order of their names."""
        base = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(base):
            return []
        found = [s.getPath() for s in fs.listStatus(base)]
        return sorted(str(p) for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _applied(self) -> set[str]:
        """Folder names of the batches that count: those whose sums are complete."""
        return {p.rstrip("/").rsplit("/", 1)[-1] for p in self._complete("delta")}

    def _read(self, kind: str, schema: str) -> DataFrame:
        applied = self._applied()
        paths = [p for p in self._complete(kind) if p.rstrip("/").rsplit("/", 1)[-1] in applied]
        if not paths:
            return self.spark.createDataFrame([], schema)
        # the type of doc_id is that of the documents; all batches of a rollup have the same
        return self.spark.read.parquet(*paths)

    def commit(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Apply a batch; False if it was applied before.

        ``inserts`` has the columns of ``count_tokens``; ``deletes`` the doc_id of documents to take out. A document in
        both is revised: what it counted until now is taken back and the new counts are added. The ledger is
        written before the sums, and both folders belong to the batch alone. A batch counts from its sums on: the ledger of a
        commit that was cut short is no part of the state that later batches see, and the commit is simply done again,
        before or after them.
        """
        if f"batch={batch}" in self._applied():
            return False
        parts = []
        columns = ["doc_id", *KEY, *SUMS]
        if inserts is not None:
            parts.append(inserts.withColumn("documents", F.lit(1).cast("long")).select(*columns))
        if deletes is not None:
            before = self.ledger().join(deletes.select("doc_id").distinct(), "doc_id", "left_semi")
            now = before.groupBy("doc_id", *KEY).agg(*[F.sum(c).alias(c) for c in SUMS])
            taken = now.where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in SUMS]))
            parts.append(taken.select("doc_id", *KEY, *[(-F.col(c)).alias(c) for c in SUMS]))
        if parts:
            ledger = f"{self.path}/ledger/batch={batch}"
            signed = reduce(DataFrame.unionByName, parts).withColumn("batch", F.lit(batch))
            signed.write.mode("overwrite").parquet(ledger)
            sums = self.spark.read.schema(signed.schema).parquet(ledger).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS])
            sums.write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch}")
        return True

    def ledger(self) -> DataFrame:
        """The signed rows of the batches that count."""
        kinds = "doc_id long, source string, lang string, version string, documents long, tokens long, bytes long, batch string"
        return self._read("ledger", kinds)

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens, bytes: the sum of all complete batches; keys without documents are left out."""
        deltas = self._read("delta", "source string, lang string, version string, documents long, tokens long, bytes long")
        return deltas.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS]).where("documents <> 0 OR tokens <> 0 OR bytes <> 0")
