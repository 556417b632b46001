from featuremart.operators.joins import bounded_broadcast, not_placeholder, restrict_to
from featuremart.operators.relops import (count_by_label, dau_count, name_rows, ranked_head, stack_and_sum,
                                          topn_array, topn_rows)

__all__ = [
    "bounded_broadcast", "restrict_to", "not_placeholder", "stack_and_sum", "count_by_label", "topn_rows",
    "topn_array", "ranked_head", "name_rows", "dau_count",
]
