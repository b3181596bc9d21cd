"""Choosing and renaming columns by the pattern of their names.

Everything here works on ``df.columns`` alone; no data is touched, and each
rename is one projection.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _tuple(value: str | Iterable[str]) -> tuple[str, ...]:
    return (value,) if isinstance(value, str) else tuple(value)


def cols(
    df: DataFrame,
    *,
    starts_with: str | Iterable[str] = (),
    ends_with: str | Iterable[str] = (),
    contains: str | Iterable[str] = (),
    matches: str | None = None,
    exclude: str | Iterable[str] = (),
    ignore_case: bool = True,
) -> list[str]:
    """Names matching any of the patterns, in column order.

    Case is ignored unless asked for, so ``ends_with="ucmr1"`` finds
    ``dcpa_medpws_UCMR1``. With no pattern at all every column matches.
    """
    fold: Callable[[str], str] = str.lower if ignore_case else str
    heads = tuple(fold(p) for p in _tuple(starts_with))
    tails = tuple(fold(p) for p in _tuple(ends_with))
    parts = tuple(fold(p) for p in _tuple(contains))
    pattern = re.compile(matches, re.IGNORECASE if ignore_case else 0) if matches else None
    unfiltered = not (heads or tails or parts or pattern)
    dropped = set(_tuple(exclude))

    def keep(name: str) -> bool:
        folded = fold(name)
        return (
            unfiltered
            or (bool(heads) and folded.startswith(heads))
            or (bool(tails) and folded.endswith(tails))
            or any(p in folded for p in parts)
            or (pattern is not None and pattern.search(name) is not None)
        )

    return [c for c in df.columns if c not in dropped and keep(c)]


def all_of(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The given names; raises when one is missing."""
    wanted = list(names)
    missing = [n for n in wanted if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return wanted


def any_of(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Those of the given names that exist."""
    return [n for n in names if n in df.columns]


def numeric_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    dropped = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in dropped
    ]


def clean_name(name: str) -> str:
    """snake_case form of one column name."""
    text = name.replace("%", "_percent_").replace("#", "_number_").replace("µ", "u")
    text = re.sub(r"(?<=[a-z])(?=[A-Z])", "_", text)
    text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower()
    return f"x{text}" if not text or text[0].isdigit() else text


def clean_names(df: DataFrame) -> DataFrame:
    """snake_case every column name; repeats get ``_2``, ``_3`` and so on."""
    seen: dict[str, int] = {}
    names = []
    for name in map(clean_name, df.columns):
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def rename_by_pattern(
    df: DataFrame, rules: Iterable[tuple[str, str]], only: Iterable[str] | None = None
) -> DataFrame:
    """Apply (regex, replacement) rules in turn to the first match in each name."""
    scope = set(df.columns if only is None else only)
    renamed = {}
    for name in df.columns:
        if name not in scope:
            continue
        new = name
        for pattern, replacement in rules:
            new = re.sub(pattern, replacement, new, count=1)
        if new != name:
            renamed[name] = new
    return df.withColumnsRenamed(renamed)


def tag_by_stem(df: DataFrame, tags: Mapping[str, str]) -> DataFrame:
    """Append the tag of the longest stem a name starts with (stem, underscore, rest), as ``name_TAG``."""
    lowered = {stem.lower(): tag for stem, tag in tags.items()}
    renamed = {}
    for name in df.columns:
        parts = name.lower().split("_")
        stems = ("_".join(parts[:n]) for n in range(len(parts) - 1, 0, -1))
        tag = next((lowered[stem] for stem in stems if stem in lowered), None)
        if tag is not None:
            renamed[name] = f"{name}_{tag}"
    return df.withColumnsRenamed(renamed)


def suffix_cols(df: DataFrame, suffix: str, keep: Iterable[str]) -> DataFrame:
    """``name`` -> ``name_suffix`` for every column not in ``keep``."""
    kept = set(keep)
    return df.withColumnsRenamed({c: f"{c}_{suffix}" for c in df.columns if c not in kept})
