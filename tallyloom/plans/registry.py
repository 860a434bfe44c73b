"""All registered queries of the analytics operators, with the SQL that checks them."""

from __future__ import annotations

from . import q_features, q_labels, q_modeling, q_retrieval, q_streaming, q_tables, q_vectors, q_windows

MODULES = [q_features, q_labels, q_modeling, q_retrieval, q_streaming, q_tables, q_vectors, q_windows]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
