"""Header normalisation and schema alignment (driver-side metadata only)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import HEADER_ALIASES


def canonical_name(header: str) -> str:
    """Canonical column name of one header: its words, without other signs, in capitals."""
    words = (re.sub("[^A-Za-z0-9]", "", word) for word in re.split(r"[\s_]+", str(header)))
    name = "_".join(filter(None, words)).upper()
    return HEADER_ALIASES.get(name, name)


def _numbered(names: list[str]) -> list[str]:
    """The n-th occurrence of a name gets the suffix ``_n``, from the second on."""
    seen: Counter[str] = Counter()
    out = []
    for name in names:
        seen[name] += 1
        out.append(f"{name}_{seen[name]}" if seen[name] > 1 else name)
    return out


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename every column; a numbered name that another header bears is numbered once more."""
    names = [canonical_name(header) for header in df.columns]
    while len(set(names)) < len(names):
        names = _numbered(names)
    return df.toDF(*names)


def with_missing(df: DataFrame, names: Iterable[str], dtype: str = "string") -> DataFrame:
    """Add the absent columns as nulls."""
    absent = {n: F.lit(None).cast(dtype) for n in names if n not in df.columns}
    return df.withColumns(absent) if absent else df


def require_columns(df: DataFrame, names: Iterable[str], label: str) -> None:
    """Raise when a required column is absent."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"{label}: missing columns {absent}")


def preferred_order(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Preferred columns first, the rest after in their present order."""
    first = [n for n in names if n in df.columns]
    return df.select(*first, *[n for n in df.columns if n not in first])


def stack_frames(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column absent from one frame is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
