"""What stands around a model's answers: templates with a fallback, answers that are filtered, questions where it gives none."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.functions.text import fill

#: Words of time and result that are no verbs, and the verbs that stand in for them.
NO_VERBS = ("之后", "然后", "接着", "随后", "结果", "具体", "结论", "最终", "涵盖")
SAFE_VERBS = ("进行", "处理", "推进", "实施")
#: Questions by type, in which {person}, {city}, {place}, {action}, {product} and {time} are filled.
QUESTIONS: dict[str, tuple[str, ...]] = {
    "人物检索": ("关于{person}有哪些记录？", "请找出{person}参与的事情"),
    "地点检索": ("{city}的{place}有过什么事？", "哪些记录提到{city}？"),
    "时间检索": ("{time}有哪些记录？", "请列出{time}的事情"),
    "事件检索": ("谁{action}过{product}？", "哪条记录讲到{action}{product}？"),
    "组合检索": ("{person}在{city}{action}过什么？", "{time}{person}在哪里{action}了{product}？"),
}


def template(name: str, folders: Sequence[str] = (), fallback: Mapping[str, str] | None = None) -> str:
    """The text of ``name``.md in the first of the folders that has it, else the fallback's, else an empty text."""
    files = (Path(folder) / f"{name}.md" for folder in folders)
    found = next((f for f in files if f.is_file()), None)
    return (fallback or {}).get(name, "") if found is None else found.read_text(encoding="utf-8")


def drawn(key: Column, n: int) -> Column:
    """A place from 0 to n - 1 by the hash of a key."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def verbs(answer: Column, hops: Column, key: Column) -> Column:
    """The actions in a model's answer (its outermost JSON list of texts), with words that are no verbs replaced by verbs drawn by ``key``.

    Null if there is no such list or it has not as many actions as there are hops.
    """
    listed = F.from_json(F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)(\[.*\])", 1), "array<string>")
    chosen = F.array(*map(F.lit, SAFE_VERBS))
    safe = F.transform(listed, lambda a, i: F.when(a.isin(*NO_VERBS), F.get(chosen, drawn(F.concat_ws(":", key, i.cast("string")), len(SAFE_VERBS)))).otherwise(a))
    return F.when(F.size(listed) == hops, safe)


def fallback_questions(mems: DataFrame, templates: Mapping[str, Sequence[str]] = QUESTIONS, seed: int = 42) -> DataFrame:
    """(memory_id, query_type, query_text): for each record a question of each type, its template drawn by hash."""
    values = {"person": F.col("person.name"), "city": F.col("location.city"), "place": F.col("location.place"), "action": F.col("event.action"), "product": F.col("event.product"), "time": F.coalesce("time.relative", "time.absolute")}
    one = lambda kind, texts: F.get(F.array(*[fill(t, **values) for t in texts]), drawn(F.concat_ws(":", F.lit(str(seed)), F.lit(kind), "memory_id"), len(texts)))
    every = F.array(*[F.struct(F.lit(kind).alias("query_type"), one(kind, texts).alias("query_text")) for kind, texts in templates.items() if texts])
    return mems.select("memory_id", F.explode(every).alias("q")).select("memory_id", "q.query_type", "q.query_text")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The rows in hash order of a key; equal keys stand together."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
