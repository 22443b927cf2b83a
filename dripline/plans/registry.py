"""Loads every plan module; importing them fills the catalogue."""

from dripline.plans import (  # noqa: F401
    chain_plans,
    feature_plans,
    model_plans,
    score_plans,
    shape_plans,
    storage_plans,
    stream_plans,
    usage_plans,
    voice_plans,
)
from dripline.plans.catalog import QUERIES, SQL  # noqa: F401
