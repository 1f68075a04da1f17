"""Command line: python -m recollex generate|check|evaluate|clean|extract.

Exit code 0 if all is well, 1 if a check found errors, 2 if the arguments are wrong.  Databases are written as one JSON document in a
folder, or (``--stdout``) printed as JSON lines; extraction writes facts and ledger as JSON lines to a folder on a local or mounted path.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _arguments(args: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="recollex")
    sub = p.add_subparsers(dest="command", required=True)
    made = sub.add_parser("generate", help="write a synthetic database")
    made.add_argument("output", nargs="?")
    made.add_argument("--size", type=int, default=100)
    made.add_argument("--domain", default=None)
    made.add_argument("--questions", type=int, default=100)
    for name, text in (("check", "check a database; exit code 1 on errors"), ("evaluate", "search a database's questions and report")):
        sub.add_parser(name, help=text).add_argument("database")
    sub.choices["check"].add_argument("--detailed", action="store_true")
    tidy = sub.add_parser("clean", help="deduplicate, prune and cap a database")
    tidy.add_argument("database")
    tidy.add_argument("output", nargs="?")
    facts = sub.add_parser("extract", help="ask a model for the facts of a folder of texts")
    facts.add_argument("folder")
    facts.add_argument("output")
    facts.add_argument("--model", default="mock", help="a name given to sources.models.register")
    for name in ("generate", "clean"):
        sub.choices[name].add_argument("--stdout", action="store_true", help="print JSON lines")
    found = p.parse_args(args)
    if found.command in ("generate", "clean") and not found.output and not found.stdout:
        p.error("name an output or use --stdout")
    return found


def _put(mems: DataFrame, queries: DataFrame, a: argparse.Namespace) -> None:
    from recollex.sources.database import save_document

    if a.stdout:
        for df in (mems, queries):
            for row in df.orderBy("ord").select(F.to_json(F.struct(*[c for c in df.columns if c != "ord"])).alias("j")).toLocalIterator():  # a partition at a time
                print(row["j"])
    if a.output:
        save_document(mems, queries, a.output)


def _generate(spark: SparkSession, a: argparse.Namespace) -> int:
    from recollex.operators import generate, questions
    from recollex.session import written

    config = generate.Config(size=a.size) if a.domain is None else generate.Config(size=a.size, domain=a.domain)
    mems = written(generate.memories(spark, config), "generated")
    _put(mems, written(questions.questions(mems, a.questions), "questions"), a)
    return 0


def _check(spark: SparkSession, a: argparse.Namespace) -> int:
    from recollex.operators import quality
    from recollex.session import written
    from recollex.sources.database import load

    db = load(spark, a.database)
    report = written(quality.check(db["memories"], db["queries"]), "report")
    print(quality.rendered(report))
    if a.detailed:
        for row in quality.detailed(db["memories"], db["queries"]).orderBy("rule", "subject").toLocalIterator():
            print(*row)
    return 0 if quality.passed(report) else 1


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    from recollex.operators.evaluate import evaluate, summary
    from recollex.sources.database import load

    db = load(spark, a.database)
    print(summary(evaluate(db["memories"], db["queries"])))
    return 0


def _clean(spark: SparkSession, a: argparse.Namespace) -> int:
    from recollex.operators.clean import clean
    from recollex.session import written
    from recollex.sources.database import load

    db = load(spark, a.database)
    mems, queries, stats = clean(db["memories"], db["queries"])
    _put(written(mems, "cleaned"), written(queries, "cleaned"), a)
    for row in stats.collect():  # one row
        print(row.asDict(), file=sys.stderr)
    return 0


def _extract(spark: SparkSession, a: argparse.Namespace) -> int:
    """Adds to what an earlier run left in the output folder: each run writes facts and ledger of its own number."""
    from recollex.operators.extract import FACT, extract
    from recollex.sources.corpus import checked_folder, scan
    from recollex.sources.database import save_lines
    from recollex.sources.models import create

    root = Path(a.output)
    last = max((int(x.name.removeprefix("facts-")) for x in root.glob("facts-*") if (root / x.name.replace("facts", "done") / "_SUCCESS").exists()), default=0)
    old = lambda name, schema: spark.read.schema(schema).json(str(root / f"{name}-{last}")) if last else spark.createDataFrame([], schema)
    facts, done, counts = extract(scan(spark, checked_folder(a.folder)), old("done", "file string"), old("facts", FACT + ", _source string"), create(a.model))
    save_lines(facts, str(root / f"facts-{last + 1}"), "overwrite")
    save_lines(done, str(root / f"done-{last + 1}"), "overwrite")
    row = counts.first()
    print(f"{row['success']} answers, {row['fail']} failed")
    return 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _arguments(args)
    spark = spark or SparkSession.builder.appName("recollex").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return {"generate": _generate, "check": _check, "evaluate": _evaluate, "clean": _clean, "extract": _extract}[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())
