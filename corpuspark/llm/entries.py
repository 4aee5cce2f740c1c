"""All registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from corpuspark.llm import bpe, chat, compaction, embeddings, jaccard, langid, licenses, packing, phrases, simhash, superkmers, toxicity, whitening

MODULES = (chat, embeddings, langid, compaction, jaccard, licenses, toxicity, bpe, simhash, packing, whitening, phrases, superkmers)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
