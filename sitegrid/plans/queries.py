"""All queries, by name."""

from sitegrid.plans import q_bench, q_calls, q_images, q_ml, q_models, q_protocols, q_rank, q_seq, q_tables
from sitegrid.plans.core import QUERIES

__all__ = ["QUERIES", "q_bench", "q_calls", "q_images", "q_ml", "q_models", "q_protocols", "q_rank", "q_seq", "q_tables"]
