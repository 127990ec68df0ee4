"""The engine's operators as queries over the given tables."""

from lodestack.plans import chat_queries, claim_queries, file_queries, number_queries, record_queries  # noqa: F401
from lodestack.plans.registry import QUERIES, SQL  # noqa: F401
