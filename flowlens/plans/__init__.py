"""Reusable plan patterns: small-table attach, hash ranks, prefix sums, quantiles."""
