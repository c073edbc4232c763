"""Registered queries and their SQL, by name."""

from sitescope.plans import audit, flows, html, indexing, io, linking, metadesc, texts, urls, workspace

FLAGSHIP = "a04_site_summary"

MODULES = (io, urls, html, audit, linking, indexing, metadesc, texts, workspace, flows)

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
