from furrow.functions.columns import (
    norm_upper, norm_eq, contains_upper, regex_contains, to_double, to_int,
    extract_number, nan_to_null, clip, probit, is_finite, first_present, rounded,
)

__all__ = [
    "norm_upper", "norm_eq", "contains_upper", "regex_contains", "to_double", "to_int",
    "extract_number", "nan_to_null", "clip", "probit", "is_finite", "first_present", "rounded",
]
