"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.common import table
from tidemill.llm.fingerprint import op8_fingerprints
from tidemill.llm.html_text import op6_html_extraction
from tidemill.llm.line_dedup import op9_line_dedup
from tidemill.llm.lm_scoring import OP1_SQL, op1_lm_scoring
from tidemill.llm.mixing import op7_mixing
from tidemill.llm.near_dedup import OP10_SQL, op10_near_dedup
from tidemill.llm.packing import op5_packing
from tidemill.llm.pii import op4_pii
from tidemill.llm.quality import op2_quality_rules
from tidemill.llm.sharding import op3_sharding


def _over(operator: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*[table(spark, sf_dir, n) for n in names])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": _over(op1_lm_scoring, "documents"),
    "op2_quality_rules": _over(op2_quality_rules, "documents", "labels"),
    "op3_sharding": _over(op3_sharding, "documents"),
    "op4_pii": _over(op4_pii, "documents"),
    "op5_packing": _over(op5_packing, "documents"),
    "op6_html_extraction": _over(op6_html_extraction, "pages"),
    "op7_mixing": _over(op7_mixing, "documents"),
    "op8_fingerprints": _over(op8_fingerprints, "documents"),
    "op9_line_dedup": _over(op9_line_dedup, "documents"),
    "op10_near_dedup": _over(op10_near_dedup, "documents"),
}

ORACLE_SQL: dict[str, str] = {"op1_lm_scoring": OP1_SQL, "op10_near_dedup": OP10_SQL}
