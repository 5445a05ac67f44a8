"""All queries of the library by name, with the SQL that must return the same rows."""

from __future__ import annotations

from marketloom.plans import catalogs, changes, claims, enriched, facts, lookups, market, page_feeds, readings, records, report_checks, streams, upkeep, verdicts

FLAGSHIP = "province_market_read"
MODULES = (market, facts, changes, records, streams, verdicts, claims, catalogs, page_feeds, upkeep, readings, report_checks, lookups, enriched)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
