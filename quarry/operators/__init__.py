"""Relational, JSON and vector operators as DataFrame builders."""

from quarry.operators.aggregates import first_rows, group
from quarry.operators.joins import as_of, chain, equi_join, hash_join, nested_loop_join
from quarry.operators.nearest import HyperplaneIndex, nearest
from quarry.operators.sorting import sort, top

__all__ = ["HyperplaneIndex", "as_of", "chain", "equi_join", "first_rows", "group", "hash_join", "nearest", "nested_loop_join", "sort", "top"]
