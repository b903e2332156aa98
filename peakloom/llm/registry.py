"""The queries of this subpackage and their SQL."""

from peakloom.llm import bpe, decontaminate, embedding_dedup, filter_audit, licenses, merkle, ngram_join, quality, secrets, shards, substring_dedup, token_records, toxicity

_MODULES = (substring_dedup, secrets, ngram_join, bpe, decontaminate, embedding_dedup, toxicity, token_records, quality, shards, merkle, filter_audit, licenses)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
