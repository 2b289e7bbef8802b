from furrow.plans.queries import QUERIES, finalize
from furrow.plans.oracle import ORACLE_SQL

__all__ = ["QUERIES", "ORACLE_SQL", "finalize"]
