"""Training-data operators: packing, joins, search, media, chat, dedup, toxicity, BPE and PII.

Nothing else in the library imports this subpackage.
"""
