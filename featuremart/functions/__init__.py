from featuremart.functions.aggs import distinct_count, letters_total, max_any, max_min, median_by
from featuremart.functions.expr import (array_contains_strict, day_key_by_parsing, day_key_from_text, flag, greeting,
                                        name_pairs, safe_ratio, total_score)
from featuremart.functions.sql import register_functions

__all__ = [
    "distinct_count", "letters_total", "max_any", "max_min", "median_by", "array_contains_strict", "day_key_by_parsing",
    "day_key_from_text", "flag", "greeting", "name_pairs", "safe_ratio", "total_score", "register_functions",
]
