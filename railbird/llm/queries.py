"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from railbird.llm import bisectors, chat, exact_dedup, fingerprints, mixing, packing, quality, runs, simhash, suffix_dedup, toxicity, url_filter, warc

MODULES = [suffix_dedup, mixing, fingerprints, chat, packing, quality, simhash, warc, url_filter, exact_dedup, toxicity, runs, bisectors]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
