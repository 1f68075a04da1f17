"""Counts, distinct values and quantiles that are kept a part (a day, a file) and merged for any set of parts.

A part is one row: its number of rows, an HLL sketch of each column whose different values are counted, and a KLL sketch of each
whose quantiles are wanted.  Sketches have one size whatever they have seen and are merged as they are, so a range of parts is never read
again.  The error is a matter of size: about 1.04 / sqrt(2 ** LG_K) of a distinct count, and of a quantile about 1.65 / K ** 0.9 of its rank.

Cases: nulls are not counted as values, and neither are NaNs in quantiles; a part without values has null sketches, which merge as nothing; no parts
give one row with 0 rows, 0 values and null quantiles; a part that comes twice counts twice, so parts are written under their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, K = 16, 400


def parts(df: DataFrame, part: Column | str, distinct: list[str] = (), quantiles: list[str] = ()) -> DataFrame:
    """(part, n, distinct_<column>, quantiles_<column>): a row a part, folded map-side into sketches."""
    by = F.col(part) if isinstance(part, str) else part
    counted = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LG_K)).alias(f"distinct_{c}") for c in distinct]
    numbers = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in quantiles}
    ranked = [F.kll_sketch_agg_double(v, F.lit(K)).alias(f"quantiles_{c}") for c, v in numbers.items()]
    return df.groupBy(by.alias("part")).agg(F.count("*").alias("n"), *counted, *ranked)


def merged(kept: DataFrame, at: tuple[float, ...] = (0.5,), by: list[str] = ()) -> DataFrame:
    """One row (or one for each of ``by``): n, distinct_<column> as a number, quantiles_<column> as an array in the order of ``at``."""
    columns = [F.coalesce(F.sum("n"), F.lit(0)).alias("n")]
    for c in kept.columns:
        if c.startswith("distinct_"):
            columns.append(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c))
        if c.startswith("quantiles_"):
            whole = F.kll_merge_agg_double(c)
            some = F.kll_sketch_get_n_double(whole) > 0
            columns.append(F.when(some, F.array(*[F.kll_sketch_get_quantile_double(whole, F.lit(float(x))) for x in at])).alias(c))
    return kept.groupBy(*by).agg(*columns)


def ranks(kept: DataFrame, column: str, values: list[float]) -> DataFrame:
    """One row (ranks): the share of all values up to each of ``values``."""
    whole = F.kll_merge_agg_double(f"quantiles_{column}")
    return kept.agg(F.when(F.kll_sketch_get_n_double(whole) > 0, F.array(*[F.kll_sketch_get_rank_double(whole, F.lit(float(v))) for v in values])).alias("ranks"))
