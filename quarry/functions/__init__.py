"""Expression builders and SQL functions; all of them stay inside Catalyst."""

from quarry.functions.json import json_extract, json_extract_bool, json_extract_double, json_extract_long, json_length
from quarry.functions.scalar import ascending, descending, matches, safe_add, safe_divide, safe_multiply, safe_subtract, same
from quarry.functions.sql import register
from quarry.functions.vector import cosine_distance, dense_vector, document_vector, inner_product, l2_distance, vector_literal, vector_problem

__all__ = [
    "ascending", "cosine_distance", "dense_vector", "descending", "document_vector", "inner_product", "json_extract", "json_extract_bool", "json_extract_double", "json_extract_long",
    "json_length", "l2_distance", "matches", "register", "safe_add", "safe_divide", "safe_multiply", "safe_subtract", "same", "vector_literal", "vector_problem",
]
