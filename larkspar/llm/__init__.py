"""Training-data operators: fingerprints, quality, BPE, secrets, decontamination, LM scores, chat, line and near dedup, URL filters.

Nothing else in the library imports this subpackage; ``larkspar.llm.queries`` registers its queries and SQL.
"""
