"""All registered queries of the evaluation engine and their SQL."""

from __future__ import annotations

from tallyspark.plans import corpus, notices, scoring, voting

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (scoring, voting, corpus, notices):
    QUERIES |= _module.REGISTRY.queries
    ORACLE_SQL |= _module.REGISTRY.sql
