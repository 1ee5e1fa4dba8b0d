"""Plug-ins for models that need a network, with deterministic offline defaults."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.operators.retrieval import normalised_cosine


class Generator(Protocol):
    """(question, feedback of the last attempt) -> statement."""

    def __call__(self, question: str, feedback: str) -> str: ...


#: A judge is a function of columns, so that it runs inside a plan.
Judge = Callable[[Column, Column], Column]


def hash_embedding(text: Column, size: int = 64) -> Column:
    """A vector of word counts by hash bucket with signs: equal texts are equal, texts that share words are near."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    signed = F.transform(hashed, lambda h: F.struct(F.pmod(h, F.lit(size)).cast("int").alias("at"), F.when(h >= 0, 1.0).otherwise(-1.0).alias("by")))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(signed, lambda s: s["at"] == i), F.lit(0.0), lambda a, s: a + s["by"]))


def same_answer(a: Column, b: Column, least: float = 0.9) -> Column:
    """An offline agreement judge: null if either answer is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), normalised_cosine(hash_embedding(a), hash_embedding(b)) >= least)


def semantic_score(answer: Column, truth: Column) -> Column:
    """0 where either text is empty or the answer reports an error."""
    empty = (F.coalesce(F.trim(answer), F.lit("")) == "") | (F.coalesce(F.trim(truth), F.lit("")) == "") | F.lower(answer).contains("error")
    return F.when(empty, 0.0).otherwise(normalised_cosine(hash_embedding(answer), hash_embedding(truth)))


def judged(df: DataFrame, answer: str, evidence: str, judge: Judge, out: str = "judged") -> DataFrame:
    return df.withColumn(out, judge(F.col(answer), F.col(evidence)))


class Timed:
    """A plug-in with the seconds of each call."""

    def __init__(self, call: Callable, clock: Callable[[], float] = time.perf_counter):
        self.call, self.clock, self.seconds = call, clock, []

    def __call__(self, *args, **kwargs):
        began = self.clock()
        try:
            return self.call(*args, **kwargs)
        finally:
            self.seconds.append(self.clock() - began)
