"""Request tables: defaults, validation, and sharing of equal questions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import lookup_key, request_language, strip
from ..schemas import MAX_BUDGET, MAX_CONTEXT_LENGTH, MAX_TEXT_LENGTH


def within_budget(name: str) -> Column:
    """The column, or an error where it is out of bounds: answers are never cut silently."""
    value = F.col(name)
    refusal = F.concat(F.lit(f"{name} must be between 0 and {MAX_BUDGET}, not "), value.cast("string"))
    return F.when(value.between(0, MAX_BUDGET), value).otherwise(F.raise_error(refusal).cast("int"))


def with_defaults(requests: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    """Add missing optional columns and fill NULLs of columns that have a default."""
    for name, (kind, value) in defaults.items():
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(value).cast(kind))
        elif value is not None:
            requests = requests.withColumn(name, F.coalesce(F.col(name).cast(kind), F.lit(value)))
        else:
            requests = requests.withColumn(name, F.col(name).cast(kind))
        if name == "limit":
            requests = requests.withColumn(name, within_budget(name))
    return requests


def answer_shared(
    requests: DataFrame,
    params: Sequence[str],
    answer: Callable[[DataFrame], DataFrame],
    already_distinct: bool = False,
) -> DataFrame:
    """Answer each distinct question once, then hand the answer to all who asked it.

    ``answer`` receives (request_id, *params) and returns rows keyed by request_id.
    A question repeated in a third of the table is thus computed once; what is
    copied per repeat is its bounded answer only.
    """
    if already_distinct:
        return answer(requests.select("request_id", *params))
    questions = requests.groupBy(*params).agg(F.min("request_id").alias("__question"))
    answers = answer(questions.withColumnRenamed("__question", "request_id"))
    same = reduce(
        lambda a, b: a & b, [F.col(f"r.{p}").eqNullSafe(F.col(f"q.{p}")) for p in params]
    )
    askers = (
        requests.alias("r").join(questions.alias("q"), same).select("r.request_id", "q.__question")
    )
    return (
        answers.withColumnRenamed("request_id", "__question").join(askers, "__question").drop("__question")
    )


def _text_problem(name: str, required: bool = True) -> list[tuple[Column, str]]:
    value = strip(F.col(name))
    blank = value == ""
    problems = [
        (blank, f"{name} cannot be empty"),
        (F.length(value) > MAX_TEXT_LENGTH, f"{name} is too long"),
        (value.rlike(r"\p{Cc}"), f"{name} contains control characters"),
    ]
    return ([(F.col(name).isNull(), f"{name} must be text")] if required else []) + problems


def _range_problem(name: str, low: int, high: int = MAX_BUDGET) -> tuple[Column, str]:
    return ~F.col(name).between(low, high), f"{name} must be between {low} and {high}"


def _reserved_problem(name: str) -> tuple[Column, str]:
    return F.col(name) == -1, f"{name}=-1 is reserved"


def validate(
    requests: DataFrame,
    *,
    texts: Sequence[str] = (),
    optional_texts: Sequence[str] = (),
    languages: Sequence[str] = (),
    optional_languages: Sequence[str] = (),
    limits: Sequence[str] = (),
    budgets: Sequence[str] = (),
    allocations: Sequence[str] = (),
    contexts: Sequence[str] = (),
    bounded: Mapping[str, tuple[int, int]] | None = None,
    names: Mapping[str, Sequence[str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Split a request table into (valid with normalised texts, rejects(request_id, reason))."""
    problems: list[tuple[Column, str]] = []
    for name in texts:
        problems += _text_problem(name)
    for name in optional_texts:
        problems += _text_problem(name, required=False)
    for name in languages:
        problems.append((request_language(F.col(name)).isNull(), f"{name} is not a language tag"))
    for name in optional_languages:
        problems.append(
            (
                F.col(name).isNotNull() & request_language(F.col(name)).isNull(),
                f"{name} is not a language tag",
            )
        )
    for name in limits:
        problems.append(_range_problem(name, 1))
    for name in budgets:
        problems += [_reserved_problem(name), _range_problem(name, 0)]
    for name in allocations:
        problems += [
            _reserved_problem(name),
            _range_problem(name, 0),
            (F.col(name) > F.col("limit"), f"{name} must not exceed limit"),
        ]
    for name in contexts:
        size = F.length(strip(F.col(name)))
        problems.append((~size.between(1, MAX_CONTEXT_LENGTH), f"{name} must have 1 to {MAX_CONTEXT_LENGTH} characters"))
    for name, (low, high) in (bounded or {}).items():
        problems.append(_range_problem(name, low, high))
    for name, allowed in (names or {}).items():
        problems.append(
            (F.col(name).isNull() | ~F.col(name).isin(*allowed), f"{name} is not supported")
        )
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), why) for bad, why in problems])
    judged = requests.withColumn("reason", reason)
    valid = judged.filter(F.col("reason").isNull()).drop("reason")
    for name in (*texts, *optional_texts):
        valid = valid.withColumn(name, lookup_key(strip(F.col(name))))
    for name in (*languages, *optional_languages):
        valid = valid.withColumn(name, request_language(F.col(name)))
    return valid, judged.filter(F.col("reason").isNotNull()).select("request_id", "reason")
