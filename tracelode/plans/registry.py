"""Named questions over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Question = Callable[[SparkSession, str], DataFrame]

QUESTIONS: dict[str, Question] = {}
ORACLES: dict[str, str] = {}


def question(name: str, sql: str | None = None) -> Callable[[Question], Question]:
    def add(fn: Question) -> Question:
        if name in QUESTIONS:
            raise ValueError(f"question {name} is registered twice")
        QUESTIONS[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
