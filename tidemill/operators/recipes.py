"""Cleaning recipes: named steps with parameters, checked first, then applied in order."""

from __future__ import annotations

import difflib
import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules

STEPS: dict[str, object] = {}


def step(f):
    """Registers f(rows, **parameters) under its name."""
    STEPS[f.__name__] = f
    return f


@step
def text_length(rows: DataFrame, column: str = "text", least: int = 10, most: int = 8000) -> DataFrame:
    """Texts of a length within bounds."""
    return rows.where(F.length(column).between(least, most))


@step
def alphanumeric_ratio(rows: DataFrame, column: str = "text", least: float = 0.5) -> DataFrame:
    """Texts with enough letters and digits."""
    return rows.where(F.regexp_count(F.col(column), F.lit(r"[\p{L}\p{N}]")) >= least * F.length(column))


@step
def special_ratio(rows: DataFrame, column: str = "text", most: float = 0.25) -> DataFrame:
    """Texts with few other characters."""
    return rows.where(F.regexp_count(F.col(column), F.lit(r"[^\p{L}\p{N}\s]")) <= most * F.length(column))


@step
def flagged_ratio(rows: DataFrame, words: list[str], column: str = "text", most: float = 0.0005) -> DataFrame:
    """Texts in which flagged words take few characters."""
    taken = sum((F.length(column) - F.length(F.replace(F.col(column), F.lit(w), F.lit(""))) for w in words), F.lit(0))
    return rows.where(taken <= most * F.length(column))


@step
def remove_links(rows: DataFrame, column: str = "text", by: str = "") -> DataFrame:
    """Links replaced."""
    return rows.withColumn(column, F.regexp_replace(column, r"https?://\S+|www\.\S+", by))


@step
def mask_pii(rows: DataFrame, column: str = "text") -> DataFrame:
    """Personal data replaced by placeholders."""
    return rows.withColumn(column, rules.masked(F.col(column))["text"])


@step
def exact_dedup(rows: DataFrame, column: str = "text") -> DataFrame:
    """One row of each text."""
    return rows.dropDuplicates([column])


def problems(recipe: list[dict]) -> list[str]:
    """What is wrong with a recipe of {step: {parameter: value}}: unknown names with the nearest known, missing parameters."""
    out = []
    for i, entry in enumerate(recipe):
        for name, params in entry.items():
            if name not in STEPS:
                near = difflib.get_close_matches(name, STEPS, 1)
                out.append(f"step {i}: no {name}" + (f", did you mean {near[0]}?" if near else ""))
                continue
            known = inspect.signature(STEPS[name]).parameters
            out += [f"step {i}: {name} has no {p}" for p in params or {} if p not in known or p == "rows"]
            out += [f"step {i}: {name} needs {p}" for p, v in known.items() if p != "rows" and v.default is v.empty and p not in (params or {})]
    return out


def apply(rows: DataFrame, recipe: list[dict]) -> DataFrame:
    """The recipe's steps in order; a wrong recipe stops before anything runs."""
    if wrong := problems(recipe):
        raise ValueError("; ".join(wrong))
    for entry in recipe:
        for name, params in entry.items():
            rows = rows.transform(STEPS[name], **(params or {}))
    return rows
