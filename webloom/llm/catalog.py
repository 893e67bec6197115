"""The queries of this subpackage and their SQL."""

from webloom.llm import boilerplate, language, mixing, packing, rank_fusion, reading, residue, similar_vectors, split_overlap, stuffing

_MODULES = (rank_fusion, similar_vectors, residue, boilerplate, stuffing, language, split_overlap, packing, mixing, reading)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
