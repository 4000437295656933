"""Survey, claim and question views on the test tables, with queries and their SQL."""

from workload import basics, cleaning, services, stored  # noqa: F401
from workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
