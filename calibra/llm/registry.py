"""The queries of this subpackage and their SQL."""
from calibra.llm import bpe, ctph, filter_audit, langid, licenses, mixing, ngram_join, periodic_runs, pii, sharding, suffix_dedup, topk, url_filter

_MODULES = (bpe, sharding, ctph, langid, pii, licenses, mixing, suffix_dedup, ngram_join, topk, url_filter, periodic_runs, filter_audit)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
