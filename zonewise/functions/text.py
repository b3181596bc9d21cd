"""Parsing of published text tables: intervals, place names, code repairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATE_CODE = r"[A-Z]{2}$"


def extract(text: Column, pattern: str) -> Column:
    """First match of ``pattern``; NULL (not '') where there is none."""
    return F.regexp_substr(text, F.lit(pattern))


def interval_parts(text: Column) -> list[Column]:
    """Point, lower and upper of a printed "point (lower,upper)"; NULL where the cell has another form.

    The cell is cut at its punctuation once; three numbers in that order make an interval.
    """
    pieces = F.split(F.trim(text), r"\s*[(,)]")
    numbers = [F.get(pieces, i).try_cast("double") for i in range(3)]
    whole = (F.size(pieces) == 4) & (F.get(pieces, 3) == "") & F.endswith(F.trim(text), F.lit(")"))
    return [F.when(whole, n) for n in numbers]


def remove_first(text: Column, piece: Column) -> Column:
    """Drop the first occurrence of the literal ``piece``; NULL where either is NULL."""
    at = F.instr(text, piece)
    cut = F.concat(
        F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(piece))
    )
    return F.when(at > 0, cut).otherwise(F.when(at == 0, text))


def replace_first(text: Column, old: str, new: str) -> Column:
    at = F.instr(text, F.lit(old))
    swapped = F.concat(
        F.substr(text, F.lit(1), at - 1), F.lit(new), F.substr(text, at + F.lit(len(old)))
    )
    return F.when(at > 0, swapped).otherwise(text)


def trailing_state(text: Column) -> Column:
    return extract(text, STATE_CODE)


def place_name(text: Column, state: Column) -> Column:
    """Join key of a place: first comma and first state code removed, then trimmed."""
    return F.trim(remove_first(remove_first(text, F.lit(",")), state))


def repair_key(text: Column, repairs: list[tuple[str, str]]) -> Column:
    """Apply first-occurrence literal replacements in turn."""
    for old, new in repairs:
        text = replace_first(text, old, new)
    return text
