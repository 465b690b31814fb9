"""The queries of this folder, and the SQL of those that SQL can express."""

from . import byte_bpe, chat, decontaminate, hard_negatives, jaccard_join, line_dedup, lm_score, pii, quality, quality_model, substring_dedup, url_filter, vector_codes

MODULES = (quality, substring_dedup, jaccard_join, chat, lm_score, pii, url_filter, line_dedup, byte_bpe, decontaminate, quality_model, vector_codes, hard_negatives)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
