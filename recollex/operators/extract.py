"""Facts out of a corpus by a model: what is pending is prepared, asked in batches, parsed, and added to what there is."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.functions.json import bounded, indexed_lines, json_lines, unfenced
from recollex.session import indexed, written
from recollex.sources.corpus import merged, pending, prepare
from recollex.sources.models import Model, generate

if TYPE_CHECKING:
    from recollex.sources.answers import AnswerStore

FACT = "content string, person string, location string, time string, dynasty string, event_type string, chain_id string, chain_position int, chain_relation string"
PROMPT = """List the facts of the text below as a JSON array of objects with the keys content, person, location, time, dynasty,
event_type, chain_id, chain_position and chain_relation; leave out what the text does not say.

"""

PARSE = """Below are questions, one a line with its number.  Answer with one line for each, its number, a colon and a JSON object with
those of the keys person_name, location_city, event_product, time_start and dynasty_era that the question tells.

"""
#: Questions of one prompt.
ASKED = 15


@dataclass
class Salvaging:
    """Asks a batch at once; if that fails, its prompts one by one, and one that fails again has no answer."""

    model: Model

    def batch(self, prompts: list[str]) -> list[str | None]:
        try:
            return list(self.model.batch(prompts))
        except Exception:
            return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str | None:
        try:
            return self.model.batch([prompt])[0]
        except Exception:
            return None


def objects(answer: Column) -> Column:
    """The JSON objects of an answer: of its array, else one a line; none of a null answer or one that is too long to be one."""
    answer = bounded(answer)
    listed = F.from_json(unfenced(answer), "array<string>")
    return F.filter(F.coalesce(listed, json_lines(answer)), lambda x: F.startswith(x, F.lit("{")))


def outcomes(answered: DataFrame, answer: str = "answer") -> DataFrame:
    """One row (success, fail): answers that were given, and those that failed."""
    return answered.agg(F.count(answer).alias("success"), F.count(F.when(F.col(answer).isNull(), 1)).alias("fail"))


def _answered(asked: DataFrame, model: Model, answers: AnswerStore | None, label: str) -> DataFrame:
    """``asked`` with the column answer, from the store of answers if there is one; the model is asked once."""
    return written(generate(asked, "prompt", Salvaging(model)).drop("prompt") if answers is None else answers.ask(asked, model).drop("prompt"), label)


def extract(files: DataFrame, done: DataFrame, facts: DataFrame, model: Model, prompt: str = PROMPT, answers: AnswerStore | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, done, outcomes) after the pending files(file, folder, name, text) were asked about.

    Too short files are not asked about and stay pending, as do those without an answer.  A fact's _source is folder/name.
    The answers are written, so the model is asked once; with a store of ``answers`` not again by later runs, and a lost run's are kept.
    """
    asked = prepare(pending(files, done)).select("file", F.concat_ws("/", "folder", "name").alias("_source"), F.concat(F.lit(prompt), "text").alias("prompt"))
    answered = _answered(asked, model, answers, "answers")
    each = answered.select("_source", F.explode(objects(F.col("answer"))).alias("x")).select(F.from_json("x", FACT).alias("f"), "_source")
    new = each.filter("f is not null").select("f.*", "_source")
    ledger = done.select("file").union(answered.filter("answer is not null").select("file")).distinct()
    return merged(facts, new), ledger, outcomes(answered)


def parse_queries(queries: DataFrame, model: Model, prompt: str = PARSE, size: int = ASKED, answers: AnswerStore | None = None) -> DataFrame:
    """(query_text, parsed): the JSON object that a model gives for each of queries(ord, query_text), asked by ``size`` in a prompt.

    Questions of prompts that fail, and those without an object in the answer, are absent; of equal questions the last
    answer counts.  White space inside a question is one blank in its line; null texts are not asked about.
    """
    placed = indexed(queries.select("ord", "query_text").filter("query_text is not null"), ["ord", "query_text"], "_i")
    line = F.regexp_replace("query_text", r"(?U)\s+", " ")
    listed = placed.groupBy(F.floor(F.col("_i") / size).alias("_b")).agg(F.array_sort(F.collect_list(F.struct((F.col("_i") % size).alias("i"), "query_text", line.alias("line")))).alias("x"))  # ``size`` rows a group
    asked = listed.select("_b", "x", F.concat(F.lit(prompt), F.array_join(F.transform("x", lambda q: F.concat(q["i"].cast("string"), F.lit(": "), q["line"])), "\n")).alias("prompt"))
    answered = _answered(asked, model, answers, "parsed")
    each = answered.select("_b", "x", F.explode(indexed_lines(F.col("answer"), F.size("x"))).alias("o"))
    return each.groupBy(F.get(F.col("x"), F.col("o.index"))["query_text"].alias("query_text")).agg(F.max_by("o.object", F.struct("_b", "o.index")).alias("parsed"))


def type_counts(queries: DataFrame) -> DataFrame:
    """(query_type, n)."""
    return queries.groupBy("query_type").agg(F.count("*").alias("n"))
