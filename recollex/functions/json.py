"""JSON out of the loose text that models return."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS = 2 * 1024 * 1024


def unfenced(text: Column) -> Column:
    """The inside of a leading ``` block, else the text, trimmed."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    inside = F.regexp_extract(text, r"(?s)^```(?:json)?(.*?)(?:```.*)?$", 1)
    return F.regexp_replace(F.when(F.startswith(text, F.lit("```")), inside).otherwise(text), r"(?U)^\s+|\s+$", "")


def extract_json(text: Column) -> Column:
    """VARIANT: the whole text, else from the first { to the last }, else from the first [ to the last ], else {}."""
    body = unfenced(text)
    part = lambda a, b: F.try_parse_json(F.nullif(F.regexp_extract(body, rf"(?s)(\{a}.*\{b})", 1), F.lit("")))
    return F.coalesce(F.try_parse_json(F.nullif(body, F.lit(""))), part("{", "}"), part("[", "]"), F.parse_json(F.lit("{}")))


def json_lines(text: Column) -> Column:
    """The objects of a text with one object a line, trailing commas allowed; other lines are passed over."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), ",+$", ""))
    return F.filter(lines, lambda x: F.startswith(x, F.lit("{")) & F.endswith(x, F.lit("}")) & F.try_parse_json(x).isNotNull())


def indexed_lines(text: Column, size: Column | int) -> Column:
    """Array of (index, object) of the lines "3: {...}" whose index is below ``size``."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    found = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\d+):(?U:\s)*(\{.+\})", 1).try_cast("int").alias("index"), F.regexp_extract(x, r"^(\d+):(?U:\s)*(\{.+\})", 2).alias("object")))
    return F.filter(found, lambda x: x["index"].isNotNull() & (x["index"] < size) & F.try_parse_json(F.nullif(x["object"], F.lit(""))).isNotNull())


def bounded(text: Column, most: int = MAX_CHARS) -> Column:
    return F.when(F.length(text) <= most, text)
