"""Operators for large text corpora: tokens, language models, near duplicates, filters, placement and mixing."""
