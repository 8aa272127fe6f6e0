"""Operators for preparing training corpora, each usable on its own."""
