from .cleaning import (
    CodeRule,
    as_int,
    band_midpoint,
    classify_code,
    flag_label,
    keep_levels,
    label_missing,
    map_codes,
    null_if,
    parse_number,
    step,
    tidy_label,
    top_coded,
)
from .rounding import rate_pct, round_half_away, round_half_even

__all__ = [
    "CodeRule",
    "as_int",
    "band_midpoint",
    "classify_code",
    "flag_label",
    "keep_levels",
    "label_missing",
    "map_codes",
    "null_if",
    "parse_number",
    "rate_pct",
    "round_half_away",
    "round_half_even",
    "step",
    "tidy_label",
    "top_coded",
]
