"""Scalar expressions (classification, coercion, formatting, binning)."""

from swatch.functions.expr import (
    as_double,
    as_timestamp_ntz,
    bin_index,
    in_types,
    is_blank,
    is_sample,
    missing_to_null,
    percent_text,
    to_double,
    to_int_or_zero,
    to_timestamp_ntz,
    whole_days,
)

__all__ = [
    "as_double", "as_timestamp_ntz", "bin_index", "in_types", "is_blank", "is_sample", "missing_to_null", "percent_text",
    "to_double", "to_int_or_zero", "to_timestamp_ntz", "whole_days",
]
