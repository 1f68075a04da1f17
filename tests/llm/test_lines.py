import random

import pytest

from recollex.llm.line_dedup import BOUNDS, dedup_lines
from tests.llm.helpers import table


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows):
    seen, out = [], []
    for d, t in sorted(rows):
        if t is None:
            out.append((d, 0, 0, None))
            continue
        lines, kept = t.split("\n"), []
        for line in lines:
            z = line.strip(" \t\r")
            if z == "" or not any(within_one(z, y) for y in seen):
                kept.append(line)
            if z:
                seen.append(z)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def edited(r, x):
    for _ in range(r.choice([0, 1, 1, 2])):
        i, c, m = r.randrange(len(x) + 1), r.choice("abé dxyz"), r.random()
        x = x[:i] + c + x[i + 1 :] if m < 0.4 else x[:i] + x[i + 1 :] if m < 0.7 else x[:i] + c + x[i:]
    return x


def test_equals_brute_force(spark):
    r = random.Random(11)
    pool = ["".join(r.choice("abé d") for _ in range(r.choice([1, 2, 3, 5, 31, 32, 33, 64, 65, 100]))) for _ in range(40)]
    rows = [(d, "\n".join(r.choice(["", " ", "\t"]) + edited(r, r.choice(pool)) for _ in range(r.randint(0, 8)))) for d in range(120)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_removed", "text").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_many_lines_that_differ_in_one_character(spark):
    rows = [(i, f"item {i:04d} of the list") for i in range(500)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_removed", "text").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_very_long_line(spark):
    line = "".join(random.Random(1).choice("abcdefgh ") for _ in range(20_000))
    rows = [(1, line), (2, line[:9000] + "#" + line[9001:]), (3, line[:500] + line[502:])]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in got] == [0, 1, 0]


def test_awkward_rows(spark):
    docs = table(spark, extra="n_lines lang")
    got = dedup_lines(docs).collect()
    assert set(got[0].asDict()) == {"doc_id", "text", "n_lines", "lang", "n_removed"} and len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[2]["text"] is None and by[2]["n_lines"] == 0 and by[3]["text"] == "" and by[3]["n_removed"] == 0 and by[4]["text"] == " \t\n "
    assert by[1]["n_removed"] == 0 and by[5]["text"] == "" and by[5]["n_removed"] == 1 and by[None]["n_removed"] == 0


def test_empty_table(spark):
    assert dedup_lines(table(spark).limit(0)).collect() == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b, bounds):
    k = max((e for least, e in bounds if min(len(a), len(b)) >= least), default=0)
    return a == b or (abs(len(a) - len(b)) <= k and distance(a, b) <= k)


def removed(lines, bounds):
    """Places of the lines that are near an earlier one that stays."""
    staying, out = [], set()
    for i, z in enumerate(lines):
        if any(near(z, y, bounds) for y in staying):
            out.add(i)
        else:
            staying.append(z)
    return out


def test_bounds_grow_with_length(spark):
    r = random.Random(5)
    pool = ["".join(r.choice("abé d") for _ in range(r.choice([2, 4, 6, 7, 8, 9, 12, 13, 20]))) for _ in range(12)]
    bounds = ((4, 1), (7, 2), (12, 3))
    lines = [x for x in (edited(r, edited(r, r.choice(pool))).strip() for _ in range(160)) if x]
    got = dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), bounds=bounds).collect()
    assert {x["doc_id"] for x in got if x["n_removed"]} == removed(lines, bounds)


def test_lines_two_to_four_edits_apart(spark):
    line = "The committee will meet on the first Monday of every month to read the reports of its members and to answer letters from the public."
    rows = [(1, line), (2, line.replace("first", "third")), (3, line[5:]), (4, "X" + line[1:90] + line[92:]), (5, line[:25]), (6, line[:20] + "st it ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in dedup_lines(docs).collect() if x["n_removed"]} == set()
    assert {x["doc_id"] for x in dedup_lines(docs, bounds=BOUNDS).collect() if x["n_removed"]} == {i + 1 for i in removed([z for _, z in rows], BOUNDS)} >= {2, 4}


def test_bounds_are_checked(spark):
    for bad in ((), ((5, 0),), ((2, 3),), ((9, 1), (3, 1))):
        with pytest.raises(ValueError):
            dedup_lines(table(spark), bounds=bad)


def test_short_lines_and_lines_that_stay(spark):
    lines = ["De.", "Se.", "Re.", "De.", "item 0001 of", "item 0011 of", "item 0111 of", "item 1111 of"]
    got = dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), bounds=BOUNDS).collect()
    assert {x["doc_id"] for x in got if x["n_removed"]} == {3, 5, 7} == removed(lines, BOUNDS)
