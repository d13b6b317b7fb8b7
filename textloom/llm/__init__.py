"""Operators for preparing training corpora: rules, shards, mixtures, near and exact dedup, LM scores, packing, language ID,
PII, secrets, conversation tries, embedding whitening.

Every operator takes the columns of its table (``documents``: doc_id, text, lang, source, ...) plus any others, and ignores columns it does not name.
"""
