"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the stage before has kept and written. It begins with deleting the
scratch tables of that stage, whose result has to be written by then; nothing else is deleted. Edge cases are those of the
operators: NULL and empty texts fail the quality rules, repeated rows become one row in the near
dedup, an empty table passes through as an empty table.
"""

from __future__ import annotations

import functools

from shelfmark.llm.base import forget, noted, stored, table
from shelfmark.llm.decontaminate import drop_leaks
from shelfmark.llm.linedup import drop_boilerplate
from shelfmark.llm.neardup import keep_one
from shelfmark.llm.packing import pack
from shelfmark.llm.quality import keep_clean

#: Scratch tables of the last stage.
_SCRATCH: list[str] = []


def _stage(fn):
    @functools.wraps(fn)
    def run_stage(spark, docs, sf_dir):
        if fn.__name__ == "quality_rules":
            _SCRATCH.clear()  # another run, whose result may still be read
        forget(spark, _SCRATCH)
        with noted(_SCRATCH):
            return fn(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_rules(spark, docs, sf_dir):
    """Rejected documents go, and lines above the limits of the quality rules leave the texts."""
    return keep_clean(docs)


@_stage
def line_dedup(spark, docs, sf_dir):
    """Boilerplate lines leave the texts."""
    return drop_boilerplate(docs).select(docs.columns)


@_stage
def near_dedup(spark, docs, sf_dir):
    """One document of each class of near-duplicates stays, the one with the lowest id."""
    return keep_one(docs)


@_stage
def decontamination(spark, docs, sf_dir):
    """Documents that hold an item of the benchmark go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


@_stage
def packing(spark, docs, sf_dir):
    """The pieces of all documents with their sequence and place in it."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokens are beyond SQL: the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after the other on the table ``documents``, each on the written result of
    the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
