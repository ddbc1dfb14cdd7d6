"""Registered queries over the supplied tables, each with its SQL check."""

from __future__ import annotations


def load():
    """Import every query module and return the registry."""
    from . import (averaging, cleaning, compression, evaluation, gaps, ingest, labelling, sampling, scoring, streams,  # noqa: F401
                   trees, vectors)
    from .registry import ENTRIES

    return ENTRIES
