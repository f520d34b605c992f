"""Training-data operators.  Nothing outside this subpackage imports it.

``queries()`` and ``oracle_sql()`` gather the thin ``opN_<name>`` queries of the modules; each
operator keeps its own general interface in its module.
"""

from __future__ import annotations

import functools
import importlib

_MODULES = (
    "jaccard_join",
    "language_id",
    "media_columns",
    "fingerprints",
    "packing",
    "lm_scoring",
    "source_mix",
    "quality",
    "repeat_index",
    "toxicity",
    "fill_in_middle",
    "token_alignment",
    "near_vectors",
)


def _modules():
    return [importlib.import_module(f"{__name__}.{m}") for m in _MODULES]


def _bounded(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        importlib.import_module(f"{__name__}.shared").small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _bounded(q) for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q for m in _modules() for name, q in m.ORACLES.items()}
