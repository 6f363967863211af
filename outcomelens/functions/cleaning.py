"""Column expressions for cleaning and coding. All are built-in expressions, no Python per row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if(col: Column, sentinel: str) -> Column:
    return F.nullif(col, F.lit(sentinel))


def label_missing(col: Column, sentinel: str | None, label: str) -> Column:
    """Sentinel and NULL both become ``label``."""
    cleaned = col if sentinel is None else null_if(col, sentinel)
    return F.coalesce(cleaned, F.lit(label))


def band_midpoint(band: Column, half_width: int = 5) -> Column:
    """``'[70-80)'`` -> 75. A band without a lower bound fails the strict cast, on purpose."""
    return F.regexp_extract(band, r"\[(\d+)-", 1).cast("int") + F.lit(half_width)


def map_codes(code: Column, groups: Mapping[str, Iterable[int]], default: str) -> Column:
    """Code lists to labels; a code in no list, or NULL, gets ``default``."""
    out = None
    for label, codes in groups.items():
        hit = code.isin(*codes)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def parse_number(code: Column) -> Column:
    """Tolerant text to double.

    Java also reads type suffixes ('785d' as 785.0); such text is not a number here.
    """
    return F.when(~code.rlike(r"[dDfF]\s*$"), code.try_cast("double"))


@dataclass(frozen=True)
class CodeRule:
    """One labelled rule: the code equals a text, starts with a prefix, or lies in a closed range."""

    label: str
    equals: Sequence[str] = ()
    prefixes: Sequence[str] = ()
    ranges: Sequence[tuple[float, float]] = ()

    def matches(self, code: Column, number: Column) -> Column:
        tests = [code == F.lit(text) for text in self.equals]
        tests += [code.startswith(text) for text in self.prefixes]
        tests += [number.between(F.lit(float(lo)), F.lit(float(hi))) for lo, hi in self.ranges]
        any_of = tests[0]
        for test in tests[1:]:
            any_of = any_of | test
        return any_of


def classify_code(code: Column, number: Column, rules: Sequence[CodeRule], default: str) -> Column:
    """First matching rule wins. Pass ``number`` as a column computed once (see ``parse_number``)."""
    out = F.when(rules[0].matches(code, number), F.lit(rules[0].label))
    for rule in rules[1:]:
        out = out.when(rule.matches(code, number), F.lit(rule.label))
    return out.otherwise(F.lit(default))


def step(col: Column, steps: Sequence[tuple[Any, Any]], beyond: Any) -> Column:
    """Step function: value of the first ``(upper, value)`` with ``col <= upper``, else ``beyond``.

    NULL also takes ``beyond``, as an ELSE branch does.
    """
    out = None
    for upper, value in steps:
        hit = col <= F.lit(upper)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(beyond))


def top_coded(col: Column, top: int) -> Column:
    """Counts as text: '0', '1', ... and '<top>+' for everything else, NULL included."""
    out = F.when(col == 0, F.lit("0"))
    for n in range(1, top):
        out = out.when(col == n, F.lit(str(n)))
    return out.otherwise(F.lit(f"{top}+"))


def flag_label(flag: Column, yes: str, no: str) -> Column:
    return F.when(flag, F.lit(yes)).otherwise(F.lit(no))


def as_int(flag: Column) -> Column:
    return flag.cast("int")


def keep_levels(col: Column, levels: Sequence[str], other: str = "Other") -> Column:
    """Values outside ``levels`` become ``other``."""
    return F.when(col.isin(*levels), col).otherwise(F.lit(other))


def tidy_label(col: Column, literal: tuple[str, str], drop_pattern: str) -> Column:
    """Replace one literal text, then delete what ``drop_pattern`` matches."""
    return F.regexp_replace(F.replace(col, F.lit(literal[0]), F.lit(literal[1])), drop_pattern, "")
