"""All queries of the library's own operators and their DuckDB SQL."""

from __future__ import annotations

from . import align_queries, bed_queries, gene_queries, read_queries, source_queries, stream_queries, vcf_queries

_MODULES = (bed_queries, vcf_queries, read_queries, align_queries, gene_queries, source_queries, stream_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
