"""Record databases as JSON documents: every envelope and record shape is read through VARIANT into one schema.

A struct-or-string field that is a string becomes the first of its sub-fields, the others are ''.  '' and null stay
apart on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.session import indexed

_KNOWN = "memory_id category difficulty weight time location person event versions content tags cluster_id reasoning_chain chain_id chain_position chain_hop chain_total chain_relation chain_prev chain_next logic decay depth retrieval_keywords".split()


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _is_text(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")) == "STRING"


def _part(v: Column, name: str, sub: str, first: bool, kind: str = "string") -> Column:
    """A sub-field of a struct-or-string field."""
    missing = F.lit("") if kind == "string" else F.lit(None)
    whole = _get(v, name) if first else missing
    return F.when(_is_text(v, name), whole).otherwise(_get(v, f"{name}.{sub}", kind)).cast(kind)


def _struct(v: Column, name: str, fields: list[tuple[str, str]]) -> Column:
    return F.struct(*[_part(v, name, sub, i == 0, kind).alias(sub) for i, (sub, kind) in enumerate(fields)])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc VARIANT): one row for each JSON file under ``path``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.parse_json("value").alias("doc"))


def _records(docs: DataFrame, part: str) -> DataFrame:
    found = docs.select(F.posexplode(F.try_variant_get("doc", f"$.{part}", "array<variant>")).alias("ord", "v"))
    return found.select(F.col("ord").cast("long").alias("ord"), "v")


def memories(docs: DataFrame) -> DataFrame:
    """The memories of all documents in the schema MEMORIES; unknown text fields go to attrs."""
    v = F.col("v")
    extras = F.map_filter(F.from_json(F.to_json(v), "map<string,string>"), lambda k, _: ~k.isin(*_KNOWN))
    return _records(docs, "memories").select(
        "ord", _get(v, "memory_id").alias("memory_id"), _get(v, "category").alias("category"), _get(v, "difficulty").alias("difficulty"), _get(v, "weight", "double").alias("weight"),
        _struct(v, "time", [("absolute", "string"), ("relative", "string"), ("fuzzy", "string"), ("timestamp", "bigint"), ("era", "string")]).alias("time"),
        _struct(v, "location", [(n, "string") for n in ("city", "place", "landmark")]).alias("location"),
        _struct(v, "person", [(n, "string") for n in ("name", "identity", "partner_name", "partner_identity", "relation")]).alias("person"),
        F.when(_is_text(v, "event") | F.try_variant_get(v, "$.event", "variant").isNotNull(), _struct(v, "event", [("type", "string"), ("action", "string"), ("product", "string"), ("quantity", "bigint"), ("price", "bigint")]))
        .otherwise(F.struct(_get(v, "event_type").alias("type"), F.lit("").alias("action"), F.lit("").alias("product"), F.lit(None).cast("bigint").alias("quantity"), F.lit(None).cast("bigint").alias("price"))).alias("event"),
        _get(v, "versions", "array<struct<version_id:string,style:string,content:string>>").alias("versions"), _get(v, "content").alias("content"), _get(v, "tags", "array<string>").alias("tags"),
        *[_get(v, n).alias(n) for n in ("cluster_id", "reasoning_chain", "chain_id")], *[_get(v, n, "int").alias(n) for n in ("chain_position", "chain_hop", "chain_total")],
        *[_get(v, n).alias(n) for n in ("chain_relation", "chain_prev", "chain_next")],
        F.struct(_get(v, "logic.type").alias("type")).alias("logic"), F.struct(_get(v, "decay.level").alias("level"), _get(v, "decay.access_count", "int").alias("access_count")).alias("decay"),
        F.struct(_get(v, "depth.layers", "int").alias("layers"), _get(v, "depth.associations", "int").alias("associations"), _get(v, "depth.semantic_distance").alias("semantic_distance")).alias("depth"),
        _get(v, "retrieval_keywords", "array<string>").alias("retrieval_keywords"), extras.alias("attrs"),
    )


def queries(docs: DataFrame) -> DataFrame:
    """The queries of all documents in the schema QUERIES; a missing query_id is made from the position."""
    v = F.col("v")
    return _records(docs, "queries").select(
        "ord", F.coalesce(_get(v, "query_id"), F.format_string("Q%04d", F.col("ord") + 1)).alias("query_id"), F.coalesce(_get(v, "query_text"), _get(v, "query"), F.lit("")).alias("query_text"),
        _get(v, "query_type").alias("query_type"), _get(v, "test_dimension").alias("test_dimension"),
        F.coalesce(_get(v, "expected_memory_ids", "array<string>"), _get(v, "relevant_memory_ids", "array<string>"), F.array().cast("array<string>")).alias("expected_memory_ids"),
        F.try_variant_get(v, "$.expected_answer", "variant").alias("expected_answer"), _get(v, "expected_answer_text").alias("expected_answer_text"), _get(v, "acceptable_answers", "array<string>").alias("acceptable_answers"),
        _get(v, "expected_time").alias("expected_time"), _get(v, "difficulty").alias("difficulty"), _get(v, "search_depth").alias("search_depth"), F.coalesce(_get(v, "is_negative", "boolean"), F.lit(False)).alias("is_negative"),
        _get(v, "target_entity").alias("target_entity"), _get(v, "logic").alias("logic"), _get(v, "dimensions", "array<string>").alias("dimensions"),
    )


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """{"memories", "queries", "info"} of a database file, whatever its envelope."""
    docs = documents(spark, path)
    info = docs.select(
        F.coalesce(_get(F.col("doc"), "database_info.name"), _get(F.col("doc"), "metadata.name"), _get(F.col("doc"), "source")).alias("name"), _get(F.col("doc"), "database_info.version").alias("version"),
        F.coalesce(_get(F.col("doc"), "database_info.created_at"), _get(F.col("doc"), "generated"), _get(F.col("doc"), "clean_time")).alias("created_at"),
    )
    return {"memories": memories(docs), "queries": queries(docs), "info": info}


def info(mems: DataFrame, name: str, version: str = "1.0.0") -> DataFrame:
    """One row: name, version, total_count, categories (map of counts)."""
    counts = mems.groupBy("category").agg(F.count("*").alias("n"))
    return counts.agg(F.lit(name).alias("name"), F.lit(version).alias("version"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))


def save_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines, in parallel: the form for large databases."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def save_document(mems: DataFrame, questions: DataFrame, path: str, head: DataFrame | None = None, mode: str = "error") -> None:
    """One JSON document with memories[] and queries[] in order of ord.  One document is one row: for databases that fit one."""
    options = {"ignoreNullFields": "false"}
    body = lambda df: F.to_json(F.struct(*[c for c in df.columns if c != "ord"]), options)
    listed = lambda df, name: df.select("ord", body(df).alias("j")).agg(F.concat(F.lit(f'"{name}":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "j"))), lambda x: x["j"]), ","), F.lit("]")).alias(name))
    whole = listed(mems, "memories").crossJoin(listed(questions, "queries"))  # one row each
    pieces = ["memories", "queries"]
    if head is not None:
        whole = head.select(F.concat(F.lit('"database_info":'), F.to_json(F.struct(*head.columns))).alias("head")).crossJoin(whole)
        pieces = ["head", *pieces]
    whole.select(F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}")).alias("value")).write.mode(mode).text(path)


def split_sample(db: dict[str, DataFrame], path: str) -> None:
    """Memories and queries to folders of their own."""
    save_lines(db["memories"], f"{path}/db")
    save_lines(db["queries"].withColumn("expected_answer", F.to_json("expected_answer")), f"{path}/queries")


def store(entries: DataFrame, key: str = "memory_id", content: str = "content", seq: str = "seq") -> DataFrame:
    """The last content of each key at the place of its first: (memory_id, content, ord).  Empty keys are dropped."""
    return entries.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(F.col(key).alias("memory_id")).agg(F.max_by(content, seq).alias("content"), F.min(seq).alias("ord"))


def entries(mems: DataFrame) -> DataFrame:
    """(memory_id, content, seq): one row for each version stored, or for the content of a record without versions."""
    all_ = F.when(F.size("versions") > 0, F.transform("versions", lambda v: F.coalesce(v["content"], F.lit("")))).otherwise(F.array(F.coalesce("content", F.lit(""))))
    made = mems.select("ord", "memory_id", F.posexplode(all_).alias("v", "content"))
    return made.select("memory_id", "content", F.struct("ord", "v").alias("seq"))


def flat_meta(mems: DataFrame) -> DataFrame:
    """The eighteen flat columns under which stores keep a record's fields."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return mems.select(
        "memory_id", text("category").alias("category"), text("difficulty").alias("difficulty"), F.coalesce("weight", F.lit(1.0)).alias("weight"), text("time.absolute").alias("time_absolute"),
        text("time.relative").alias("time_relative"), text("location.city").alias("location_city"), text("location.place").alias("location_place"), text("person.name").alias("person_name"),
        text("person.identity").alias("person_identity"), text("event.type").alias("event_type"), text("event.action").alias("event_action"), text("event.product").alias("event_product"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "cluster_id", "reasoning_chain", "chain_position", F.col("decay.level").alias("decay_level"),
    )


def numbered(df: DataFrame, label: str, order: list, out: str, start: int = 1) -> DataFrame:
    """Gapless ids like Q0001 in a total order of all rows."""
    return indexed(df, order, "_i").withColumn(out, F.format_string(label, F.col("_i") + start)).drop("_i")
