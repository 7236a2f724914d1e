"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import wraps

from . import bpe, classifier, decontaminate, html, language, minhash, oracles, passages, quality_rules, toxicity, warc
from .common import bounded


def _bounded(query):
    """The query with Arrow batches that workers can hold, set for the session when it is asked for."""

    @wraps(query)
    def run(spark, sf_dir):
        bounded(spark)
        return query(spark, sf_dir)

    return run


_ALL = (
    passages.op1_passages, classifier.op2_quality, toxicity.op3_toxicity, quality_rules.op4_quality_rules, html.op5_html,
    minhash.op6_near_duplicates, bpe.op7_byte_bpe, decontaminate.op8_decontaminate, language.op9_language, warc.op10_warc,
)
QUERIES = {q.__name__: _bounded(q) for q in _ALL}

SQL = {
    "op1_passages": oracles.OP1_SQL,
    "op4_quality_rules": oracles.OP4_SQL,
    "op6_near_duplicates": oracles.OP6_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op10_warc": warc.OP10_SQL,
}
