from .oracle import oracle_sql
from .registered import flagship, queries

__all__ = ["flagship", "oracle_sql", "queries"]
