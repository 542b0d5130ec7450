"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from watchgrid.llm.bpe import op2_bpe
from watchgrid.llm.decontaminate import OP13_SQL, op13_decontaminate
from watchgrid.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from watchgrid.llm.html_extract import op8_html_extract
from watchgrid.llm.language_id import op10_language_id
from watchgrid.llm.language_model import op7_language_model
from watchgrid.llm.packing import op5_packing
from watchgrid.llm.periodic_runs import OP12_SQL, op12_periodic_runs
from watchgrid.llm.pii import op4_pii
from watchgrid.llm.quality_model import op3_quality_model
from watchgrid.llm.quality_rules import op6_quality_rules
from watchgrid.llm.simhash import op1_simhash
from watchgrid.llm.spelling import OP11_SQL, op11_spelling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_bpe": op2_bpe,
    "op3_quality_model": op3_quality_model,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_model": op7_language_model,
    "op8_html_extract": op8_html_extract,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_spelling": op11_spelling,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_decontaminate": op13_decontaminate,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op9_exact_dedup": OP9_SQL, "op11_spelling": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_decontaminate": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
