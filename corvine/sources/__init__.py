"""Readers and writers: corpora, lines, stored indexes."""
