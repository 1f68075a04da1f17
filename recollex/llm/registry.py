"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recollex.llm.alignment import op12_alignment
from recollex.llm.bpe import op3_bpe
from recollex.llm.decontaminate import OP7_SQL, op7_decontamination
from recollex.llm.filter_audit import OP13_SQL, op13_filter_audit
from recollex.llm.fingerprints import op6_fingerprints
from recollex.llm.html import op10_html
from recollex.llm.jaccard_join import OP9_SQL, op9_jaccard_join
from recollex.llm.line_dedup import OP5_SQL, op5_line_dedup
from recollex.llm.packing import op11_packing
from recollex.llm.quality import op8_quality
from recollex.llm.sharding import OP2_SQL, op2_sharding
from recollex.llm.token_files import op4_token_files
from recollex.llm.toxicity import op1_toxicity


_ALL = (op1_toxicity, op2_sharding, op3_bpe, op4_token_files, op5_line_dedup, op6_fingerprints, op7_decontamination, op8_quality, op9_jaccard_join, op10_html, op11_packing, op12_alignment, op13_filter_audit)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": OP2_SQL, "op5_line_dedup": OP5_SQL, "op7_decontamination": OP7_SQL, "op9_jaccard_join": OP9_SQL, "op13_filter_audit": OP13_SQL}
