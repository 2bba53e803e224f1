"""Column functions: every one is a built-in expression that stays in code generation."""

from .arrays import last_items, mean_of, population_std
from .dates import calendar_columns, date_from_key, week_ending_monday, week_start
from .numbers import clip, exact_mean, growth, rounded_even, safe_ratio, to_number, units_of_money
from .text import clean_text, country_from_file, tier_rank, type_label

__all__ = [
    "calendar_columns", "clean_text", "clip", "country_from_file", "date_from_key", "exact_mean", "growth",
    "last_items", "mean_of", "population_std", "rounded_even", "safe_ratio", "tier_rank",
    "to_number", "type_label", "units_of_money", "week_ending_monday", "week_start",
]
