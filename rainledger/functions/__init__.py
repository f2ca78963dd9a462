from .coerce import (
    aggregate_flag, clip_flag, coerce_numeric, label, normalize_columns, normalize_flag, split_list,
    to_number, to_year,
)
from .quantiles import aggregate_columns, aggregate_with_quantiles
from .skew import skew_join

__all__ = [
    "aggregate_columns", "aggregate_flag", "aggregate_with_quantiles", "clip_flag", "coerce_numeric", "label",
    "normalize_columns", "normalize_flag", "skew_join", "split_list", "to_number", "to_year",
]
