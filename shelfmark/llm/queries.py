"""All queries of the subpackage: importing the modules fills the register."""

from shelfmark.llm import (  # noqa: F401
    centroids,
    chat,
    decontaminate,
    factors,
    html_text,
    langid,
    linedup,
    neardup,
    packing,
    quality,
    secrets,
    sharding,
    turns,
)
from shelfmark.llm.base import ORACLES, QUERIES  # noqa: F401
