"""Imports every operator module so that the registry is full."""

from figcorpus.llm import (  # noqa: F401
    ann,
    chat,
    html_extract,
    interaction,
    langid,
    mixing,
    packing,
    prefix_trie,
    quality,
    recurrent_lm,
    simhash,
    suffix_dedup,
    toxicity,
)
from figcorpus.llm.common import ORACLES, QUERIES  # noqa: F401
