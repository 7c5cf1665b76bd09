"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, merkle, ngram_join, vector_codes
from .decontaminate import op10_decontamination
from .html_text import op1_html_extraction
from .language_id import op3_language_id
from .lm_score import op4_lm_scoring
from .merkle import op12_merkle_manifest
from .ngram_join import op9_ngram_jaccard_join
from .packing import op8_packing
from .quality_qda import op6_quality_classifier
from .quality_rules import op5_quality_rules
from .secret_scan import op2_secret_scan
from .sharding import op13_sharding
from .url_filter import op7_url_filter
from .vector_codes import op11_vector_code_compression

QUERIES = (
    op1_html_extraction,
    op2_secret_scan,
    op3_language_id,
    op4_lm_scoring,
    op5_quality_rules,
    op6_quality_classifier,
    op7_url_filter,
    op8_packing,
    op9_ngram_jaccard_join,
    op10_decontamination,
    op11_vector_code_compression,
    op12_merkle_manifest,
    op13_sharding,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {query.__name__: query for query in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Models and hash orders have no SQL counterpart; tests compare their queries with brute force."""
    import corpus_pipeline

    own = {"op9_ngram_jaccard_join": ngram_join.ORACLE_SQL, "op10_decontamination": decontaminate.ORACLE_SQL}
    own |= {"op11_vector_code_compression": vector_codes.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
