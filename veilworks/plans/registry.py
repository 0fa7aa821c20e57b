"""All queries of the library by name, and the SQL that states each of them for DuckDB."""

from veilworks.plans import cloaking, detection, documents, files

QUERIES: dict = {}
SQL: dict = {}
for part in (detection, cloaking, documents, files):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
