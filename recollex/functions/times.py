"""Time words: ages in days to phrases, phrases to offsets, loose time strings to sortable numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases and their distance in days; the first in this order that a text contains counts.
RELATIVE_DAYS = {
    "次日": 1, "第二天": 1, "隔天": 1, "翌日": 1, "三天后": 3, "三日后": 3, "一周后": 7, "七天后": 7, "七日后": 7, "半个月后": 15, "半月后": 15, "一个月后": 30, "一月后": 30,
    "三十天后": 30, "两个月后": 60, "两月后": 60, "六十天后": 60, "三个月后": 90, "三月后": 90, "九十天后": 90, "半年后": 180, "六个月后": 180, "一年后": 365, "次年": 365, "第二年": 365,
    "两年后": 730, "二年后": 730, "三年后": 1095, "十年后": 3650, "许久之后": 9999, "很久以后": 9999, "之后": 1, "随后": 1, "接着": 1, "然后": 1, "后来": 1, "不久": 2, "几天后": 3, "几日后": 3,
}
#: Least age in days and phrase.
FUZZY = ((365, "去年"), (180, "半年前"), (90, "三个月前"), (30, "上个月"), (7, "上周"), (3, "前几天"), (1, "昨天"), (0, "今天"))
#: Greatest age in days and phrase, of the designed records.
FUZZY_DESIGNED = ((1, "今天"), (7, "本周"), (14, "上周"), (30, "本月"), (60, "上个月"), (180, "半年前"), (365, "去年"), (730, "前年"))
#: Weight by difficulty.
WEIGHTS = {"简单": 0.5, "中等": 1.0, "困难": 1.5}


def _ago(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(unit))


def _div(days: Column, by: int) -> Column:
    return F.floor(days / by).cast("long")


def time_desc(days: Column) -> Column:
    return (
        F.when(days == 0, "刚刚").when(days == 1, "昨天").when(days < 7, _ago(days.cast("long"), "天前")).when(days < 30, _ago(_div(days, 7), "周前"))
        .when(days < 365, _ago(_div(days, 30), "个月前")).when(days.isNotNull(), _ago(_div(days, 365), "年前"))
    )


def fuzzy_time(days: Column) -> Column:
    return reduce(lambda c, x: c.when(days >= x[0], x[1]), FUZZY[1:], F.when(days >= FUZZY[0][0], FUZZY[0][1])).when(days.isNotNull(), "以前")


def relative_designed(days: Column) -> Column:
    return (
        F.when(days <= 1, "刚刚").when(days <= 7, _ago(days.cast("long"), "天前")).when(days <= 30, _ago(_div(days, 7), "周前")).when(days <= 365, _ago(_div(days, 30), "个月前"))
        .when(days.isNotNull(), _ago(_div(days, 365), "年前"))
    )


def fuzzy_designed(days: Column) -> Column:
    return reduce(lambda c, x: c.when(days <= x[0], x[1]), FUZZY_DESIGNED[1:], F.when(days <= FUZZY_DESIGNED[0][0], FUZZY_DESIGNED[0][1])).when(days.isNotNull(), "多年前")


def difficulty(days: Column) -> Column:
    return F.when(days > 730, "困难").when(days > 365, "中等").when(days.isNotNull(), "简单")


def weight(level: Column) -> Column:
    return reduce(lambda c, x: c.when(level == x[0], x[1]), list(WEIGHTS.items())[1:], F.when(level == "简单", 0.5)).otherwise(1.0)


def relative_offset(text: Column) -> Column:
    """Days of the first phrase of RELATIVE_DAYS, in its order, that the text contains; null if none."""
    first, *rest = RELATIVE_DAYS.items()
    return reduce(lambda c, x: c.when(F.contains(text, F.lit(x[0])), x[1]), rest, F.when(F.contains(text, F.lit(first[0])), first[1]))


def sortable(time: Column) -> Column:
    """The first run of digits as yyyymmdd if it looks like a date, else its value; 0 if there is none.

    Digits of any script count.  A number too large for 64 bits is 0.
    """
    ascii_ = F.translate(F.regexp_extract(F.coalesce(time, F.lit("")), r"(?U)(\d+)", 1), "０１２３４５６７８９", "0123456789")
    n, size = lambda s: F.expr("bigint(0)") + F.coalesce(s.try_cast("bigint"), F.lit(0)), F.length(ascii_)
    return F.when(size == 0, F.lit(0).cast("bigint")).when(size == 4, n(ascii_) * 10000).when(size == 6, n(ascii_) * 100).when(size.isin(12, 14), n(F.substring(ascii_, 1, 8))).otherwise(n(ascii_))
