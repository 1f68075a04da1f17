"""Language models as injected callables: prompts in, texts out, in Arrow batches; never a network client of its own."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollex.functions.json import extract_json
from recollex.session import importable


class Model(Protocol):
    def batch(self, prompts: list[str]) -> list[str]: ...


class Mock:
    """Answers with a constant, or with the prompt if there is none."""

    def __init__(self, answer: str | None = None):
        self.answer = answer

    def batch(self, prompts: list[str]) -> list[str]:
        return [p if self.answer is None else self.answer for p in prompts]


class Retrying:
    """Tries a call again after failures, with growing pauses; the last failure is raised."""

    def __init__(self, call: Callable[[str], str], attempts: int = 3, pause: float = 1.0):
        self.call, self.attempts, self.pause = call, attempts, pause

    def batch(self, prompts: list[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str:
        for k in range(self.attempts):
            try:
                return self.call(prompt)
            except Exception:
                if k == self.attempts - 1:
                    raise
                time.sleep(self.pause * 2**k)
        raise AssertionError


_MADE: dict[str, Callable[..., Model]] = {"mock": Mock, "retrying": Retrying}


def register(name: str, make: Callable[..., Model]) -> None:
    _MADE[name] = make


def create(name: str, **options) -> Model:
    if name not in _MADE:
        raise ValueError(f"no model {name!r}; known: {sorted(_MADE)}")
    return _MADE[name](**options)


def generate(df: DataFrame, prompt: str, model: Model, out: str = "answer") -> DataFrame:
    """Adds the model's answer to each prompt; the model is sent to the tasks and called once a batch."""
    importable(df.sparkSession)
    kept = [f for f in df.schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers = model.batch(["" if v is None else v for v in b.column(prompt).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + [pa.array(answers, pa.string())], names=[*(f.name for f in kept), out])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType())]))


def generate_json(df: DataFrame, prompt: str, model: Model, out: str = "answer") -> DataFrame:
    return generate(df, prompt, model, out).withColumn(out, extract_json(F.col(out)))


def relevance_prompt(query: Column, results: Column) -> Column:
    """One prompt that lists a query's results (array of content) by number, each cut to 200 characters."""
    listed = F.array_join(F.transform(results, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(c, 1, 200))), "\n")
    return F.concat(F.lit("Query: "), query, F.lit("\n\nResults:\n"), listed, F.lit("\n\nGive for each result a number from 0 (irrelevant) to 3 (answers the query)."))


def relevance_prompts(ranked: DataFrame, queries: DataFrame, k: int = 10, sample: int = 50, seed: int = 42) -> DataFrame:
    """(query_id, prompt) for a hash-ordered sample of queries over their first k results."""
    chosen = queries.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("query_id")))).limit(sample)
    top = ranked.filter(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("results"))
    return chosen.join(top, "query_id", "left").select("query_id", relevance_prompt(F.col("query_text"), F.coalesce("results", F.array().cast("array<string>"))).alias("prompt"))
