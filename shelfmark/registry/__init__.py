"""All registered queries: importing the modules fills the register."""

from shelfmark.registry import (  # noqa: F401
    cleaning,
    evaluation,
    facets,
    feedback,
    hybrid,
    ids,
    profiling,
    sources,
    text,
    vectors,
)
from shelfmark.registry.base import ORACLES, QUERIES  # noqa: F401
