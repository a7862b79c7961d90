"""Operators for preparing training corpora: token counts, dedup, encoding, scoring, filtering."""
