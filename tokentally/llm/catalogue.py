"""All registered queries of the training-data operators."""

from . import (  # noqa: F401  (importing registers the queries)
    decontamination_queries,
    hard_negative_queries,
    language_model_queries,
    license_queries,
    mixing_queries,
    near_duplicate_queries,
    nearest_queries,
    quality_queries,
    substring_queries,
    token_queries,
    toxicity_queries,
    url_queries,
    whitening_queries,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
