"""The thirteen operators' queries, as registered for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import collocations
from orrery.llm.alignment import op11_alignment
from orrery.llm.collocations import op12_collocations
from orrery.llm.embeddings import op8_embeddings
from orrery.llm.fertility import op5_fertility
from orrery.llm.id_files import op10_id_files
from orrery.llm.mixing import op7_mixing
from orrery.llm.packing import op3_packing
from orrery.llm.secrets import op6_secrets
from orrery.llm.simhash import op1_simhash
from orrery.llm.token_counts import op13_token_counts
from orrery.llm.toxicity import op9_toxicity
from orrery.llm.url_rules import op4_url_filters
from orrery.llm.weak_labels import op2_weak_labels

QUERIES = [
    op1_simhash,
    op2_weak_labels,
    op3_packing,
    op4_url_filters,
    op5_fertility,
    op6_secrets,
    op7_mixing,
    op8_embeddings,
    op9_toxicity,
    op10_id_files,
    op11_alignment,
    op12_collocations,
    op13_token_counts,
]
SQL: dict[str, str] = {"op12_collocations": collocations.SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
