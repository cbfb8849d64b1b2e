"""All registered queries."""

from __future__ import annotations

from tabloom.plans import clean_queries, feature_queries, model_queries, prepare_queries, profile_queries, tree_queries
from tabloom.plans.registry import Catalog

PARTS = (profile_queries, clean_queries, feature_queries, prepare_queries, model_queries, tree_queries)


def build_catalog() -> Catalog:
    catalog = Catalog()
    for part in PARTS:
        part.register(catalog)
    return catalog
