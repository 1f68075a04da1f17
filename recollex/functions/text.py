"""Tokens, entities and word sets of texts.  Regexes are spelled out where Java's shorthand classes are ASCII only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"
#: Punctuation that separates query words.
QUERY_PUNCTUATION = "，？。"
#: Words that carry no meaning when two contents are compared.
GENERIC_LATIN = (
    "that this with from they were been have their them about would could should when where what which while after before during between through around "
    "another other than some into also very just even still only once back over down upon such"
).split()
GENERIC_CJK = "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这".split()


def fold(text: Column) -> Column:
    """Trimmed of all white space, lower-cased: the key of exact duplicates."""
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def keywords(query: Column) -> Column:
    """Distinct keywords of a query: each CJK character of a token that has any, else the token if it has two characters or more."""
    tokens = F.split(F.translate(F.coalesce(query, F.lit("")), QUERY_PUNCTUATION, "   "), r"(?U)\s+")
    each = F.transform(
        tokens,
        lambda t: F.when(t.rlike(f"[{CJK}]"), F.regexp_extract_all(t, F.lit(f"([{CJK}])"), 1)).when(F.length(t) >= 2, F.array(t)).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.flatten(each))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits; CJK characters one by one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(low, F.lit(r"([一-鿿]|[^\s一-鿿\p{Punct}]+)"), 1)


def entities(text: Column) -> Column:
    """Runs of two to six CJK characters, then capitalised Latin phrases, in order."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(F.regexp_extract_all(text, F.lit(f"([{CJK}]{{2,6}})"), 1), F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]+(?:(?U:\s)+[A-Z][a-z]+)*)"), 1))


def content_words(text: Column) -> Column:
    """The set of words that near duplicates are compared by."""
    text = F.coalesce(text, F.lit(""))
    latin = F.array_except(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{4,})"), 1), F.array(*map(F.lit, GENERIC_LATIN)))
    cjk = F.array_except(F.regexp_extract_all(text, F.lit(f"([{CJK}]{{2,6}})"), 1), F.array(*map(F.lit, GENERIC_CJK)))
    return F.array_union(latin, cjk)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def with_place(content: Column, person: Column, place: Column) -> Column:
    """The text with the suffix that some stores keep."""
    return F.concat(content, F.lit(" [人物:"), F.coalesce(person, F.lit("")), F.lit(" 地点:"), F.coalesce(place, F.lit("")), F.lit("]"))


def without_place(content: Column) -> Column:
    return F.regexp_replace(content, r"(?U)\s*\[人物:.+\]$", "")


def fill(template: str, **values: Column) -> Column:
    """Placeholders {name} of a template replaced by columns; unknown ones stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
