"""Training-data operators: archives, deduplication, decontamination, tokens, language.

Nothing outside this subpackage imports it.
"""
