"""All registered queries (import side effect fills the registry)."""

from __future__ import annotations

from cohortlab.plans import q_core, q_eval, q_io, q_ml, q_text, q_vectors  # noqa: F401
from cohortlab.plans.registry import REGISTRY


def queries():
    return {k: v.build for k, v in REGISTRY.items()}


def oracle_sql():
    return {k: v.sql for k, v in REGISTRY.items() if v.sql}
