"""Answers of a model, kept by a hash of model and prompt, so that no prompt is paid for twice.

The store is a folder of Parquet parts (key, answer, asked).  ``ask`` looks up all prompts, asks about those without an answer, each different
one once, in parts of about ``size`` prompts, each of which is one job and one append: a run that is lost keeps what it has
finished, and the next goes on with the rest.  Prompts whose call fails have no answer, are not stored, and are asked about again by the next run.

Cases: a null prompt is the empty prompt; another model name is another answer; repeated prompts get one answer; if two runs
store a prompt at the same time the first answer counts, by time and then by text; an empty frame asks nothing; the rows' own columns ``key`` or ``asked`` do not clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.operators.extract import Salvaging
from recollex.session import new_path, written
from recollex.sources.models import Model, generate

SIZE = 10_000


class AnswerStore:
    def __init__(self, spark: SparkSession, name: str, folder: str | None = None, size: int = SIZE):
        """``name`` tells the model and what it is set to."""
        self.spark, self.name, self.folder, self.size = spark, name, folder or new_path(spark, "answers"), size

    def _key(self, prompt: Column) -> Column:
        return F.sha2(F.concat(F.lit(self.name + "\n"), F.coalesce(prompt, F.lit(""))), 256)

    def read(self) -> DataFrame:
        """(_key, answer): one row a key."""
        schema = "_key string, answer string, asked timestamp"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema).drop("asked")
        rows = self.spark.read.schema(schema).parquet(self.folder)
        return rows.groupBy("_key").agg(F.min_by("answer", F.struct("asked", "answer")).alias("answer"))

    def missing(self, prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
        """(_key, prompt): different prompts without an answer."""
        keyed = prompts.select(self._key(F.col(prompt)).alias("_key"), F.coalesce(F.col(prompt), F.lit("")).alias("prompt"))
        return keyed.join(self.read(), "_key", "left_anti").groupBy("_key").agg(F.first("prompt").alias("prompt"))

    def ask(self, prompts: DataFrame, model: Model, prompt: str = "prompt", out: str = "answer") -> DataFrame:
        """``prompts`` with the answer to each, null where the call failed."""
        fresh = written(self.missing(prompts, prompt), "to-ask", few=True)
        pieces = -(-fresh.count() // self.size)
        for k in range(pieces):
            part = fresh.filter(F.pmod(F.xxhash64("_key"), F.lit(pieces)) == k)
            answered = generate(part, "prompt", Salvaging(model)).filter("answer is not null")
            answered.select("_key", "answer", F.current_timestamp().alias("asked")).write.mode("append").parquet(self.folder)
        kept = [c for c in prompts.columns if c != out]
        return prompts.select(*kept, self._key(F.col(prompt)).alias("_key")).join(self.read().withColumnRenamed("answer", out), "_key", "left").drop("_key")
