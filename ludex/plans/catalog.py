"""Imports every query module so that the registry is complete."""

from ludex.plans import q_clean, q_data, q_eval, q_explore, q_features, q_model, q_relevance  # noqa: F401
from ludex.plans.registry import OPERATORS, ORACLE, QUERIES  # noqa: F401
