"""All registered queries of the ledger side."""

from bahikhata.plans import exports, files, imports, keeping, pages, queries, stores

MODULES = (queries, exports, stores, pages, files, keeping, imports)
QUERIES, ORACLE = queries.QUERIES, queries.ORACLE
