"""All registered queries of the credit operators."""

from lendscope.plans import filing_queries, queries, signal_queries, statement_queries, model_queries  # noqa: F401, I001
from lendscope.plans.queries import ORACLE_SQL, QUERIES  # noqa: F401, I001
