"""Corpus and page analytics as DataFrame operators."""
