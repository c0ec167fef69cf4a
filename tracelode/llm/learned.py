"""Bounded labelled samples and Arrow scoring, shared by the two text classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textgrams import slices


def remainder(doc_id: Column, mod: int) -> Column:
    return F.crc32(doc_id.cast("string")) % mod


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, fold: int, per_class: int) -> DataFrame:
    """``label, text`` of at most ``per_class`` documents of each class outside the held-out fold.

    The documents with the smallest md5(doc_id) are taken. Ids without label, or with different ones, are left out.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), mod) != fold))
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other").drop("other")
    order = F.md5(F.col("doc_id").cast("string"))
    few = [known.where(F.col("label") == c).orderBy(order).limit(per_class) for c in (0, 1)]
    few = few[0].unionByName(few[1])
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    # ids that stand for several documents: one text each, so the bound holds
    return found.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def fitted(rows: DataFrame, fit: Callable[[list[str], np.ndarray], bytes]) -> bytes:
    """The model that ``fit`` makes in one task from the bounded sample."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("doc_id")
        return pd.DataFrame({"model": [fit(pdf["text"].tolist(), pdf["label"].to_numpy())]})

    made = rows.groupBy(F.lit(0).alias("all")).applyInPandas(run, "model binary").collect()
    return bytes(made[0]["model"]) if made else fit([], np.zeros(0, np.int64))


def scored(docs: DataFrame, make: Callable[[], Callable[[pa.Array], dict[str, np.ndarray]]], keep: list[str], schema: str) -> DataFrame:
    """``keep`` columns and what ``make()(texts)`` returns for each text, as ``schema`` types them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            parts = [score(part) for _, part in slices(text)]
            names = list(parts[0]) if parts else []
            columns = [pa.array(np.concatenate([p[name] for p in parts])) for name in names]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(keep))), *columns], [*keep, *names]
                )

    kept_types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{kept_types}, {schema}")


def passing(docs: DataFrame, make: Callable[[], Callable[[pa.Array], dict[str, np.ndarray]]], column: str, least: float) -> DataFrame:
    """The rows whose ``column`` of ``make()(texts)`` is at least ``least``, with all columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            parts = [score(part)[column] for _, part in slices(batch.column(at))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) >= least))

    return docs.mapInArrow(run, docs.schema)
