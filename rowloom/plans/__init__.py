"""Compositions of operators, and the shuffle plans that keep them safe under skew."""
