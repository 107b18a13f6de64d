"""Readers and writers for corpora, packs and index tables."""
