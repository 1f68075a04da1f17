"""Small tables with every awkward row: nulls, empty, blank, repeated, very long, clashing column names."""

AWKWARD = [(1, "The cat sat on the mat."), (2, None), (3, ""), (4, " \t\n "), (None, "no id at all"), (5, "The cat sat on the mat."), (5, "The cat sat on the mat."), (6, "word " * 30_000), (7, "x" * 50_000), (8, "Ünïcödé 漢字 <|endoftext|> it's\x00\x01 é")]


def table(spark, rows=AWKWARD, extra=""):
    schema = "doc_id long, text string"
    if not extra:
        return spark.createDataFrame(rows, schema)
    return spark.createDataFrame([(*r, *["kept"] * len(extra.split())) for r in rows], schema + "".join(f", {c} string" for c in extra.split()))
