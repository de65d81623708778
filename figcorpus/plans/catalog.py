"""Imports every query module so that the registry is full."""

from figcorpus.plans import (  # noqa: F401
    context_queries,
    corpus_queries,
    dedup_queries,
    eval_queries,
    figure_queries,
    screen_queries,
    io_queries,
    series_queries,
    text_queries,
    tree_queries,
)
from figcorpus.plans.registry import ORACLES, QUERIES  # noqa: F401
