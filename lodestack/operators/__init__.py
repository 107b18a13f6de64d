"""Corpus-scale operators: indexing, ranking, evaluation, duplicates, term statistics."""
