"""Brute-force versions shared by the tests of this folder."""

from test_operators import brute_components, brute_quality, corpus
from test_spans import brute_pii

__all__ = ["brute_components", "brute_pii", "brute_quality", "corpus"]
