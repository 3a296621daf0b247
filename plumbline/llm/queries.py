"""The registered queries of this subpackage."""

from plumbline.llm import mixing_queries, neardup_queries, origin_queries, packing_queries, radix_queries, span_queries, subject_queries

_ALL = [span_queries, origin_queries, neardup_queries, radix_queries, packing_queries, mixing_queries, subject_queries]

QUERIES = {name: f for m in _ALL for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _ALL for name, sql in m.SQL.items()}
