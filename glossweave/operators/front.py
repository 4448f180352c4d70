"""One door to the query operators: defaults, checks, availability, answer.

A request that fails a check, or names a language that is not in place, gets a row in
``rejects(request_id, reason)``; "not available" is never an empty answer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..schemas import PUBLIC_RELATIONS, Corpus
from . import graph, lookup, vectors, wordplay
from .requests import validate, with_defaults

_LIMIT = {"limit": ("int", 20)}


@dataclass(frozen=True)
class Operator:
    run: Callable[..., DataFrame]
    checks: dict[str, Any]
    defaults: dict[str, tuple[str, Any]] = field(default_factory=lambda: dict(_LIMIT))
    capability: str = "lexical"
    languages: tuple[str, ...] = ()


_WORD = {"texts": ["text"], "limits": ["limit"]}
OPERATORS = {
    "lookup": Operator(
        lookup.lookup,
        dict(
            texts=["word"], optional_texts=["part_of_speech"], languages=["language"], limits=["limit"],
            budgets=["examples_limit", "pronunciations_limit", "translations_limit"],
        ),
        lookup.LOOKUP_DEFAULTS, languages=("language",),
    ),
    "synonyms": Operator(
        lookup.synonyms,
        dict(
            texts=["word"], optional_texts=["part_of_speech"], languages=["language"],
            limits=["limit", "max_senses"], allocations=["unsensed_limit"],
        ),
        lookup.SYNONYM_DEFAULTS, languages=("language",),
    ),
    "translate": Operator(
        lookup.translate,
        dict(
            texts=["word"], optional_texts=["part_of_speech"], languages=["source_language", "target_language"],
            limits=["limit", "max_senses"],
        ),
        lookup.TRANSLATE_DEFAULTS, languages=("source_language", "target_language"),
    ),
    "relations": Operator(
        graph.relations,
        dict(
            texts=["word"], languages=["language"], optional_languages=["target_language"], limits=["limit"],
            allocations=["transitive_limit"], bounded={"max_depth": (1, 2)}, names={"relation": PUBLIC_RELATIONS},
        ),
        graph.RELATION_DEFAULTS, languages=("language",),
    ),
    "neighbours": Operator(
        vectors.neighbours,
        dict(
            texts=["word"], languages=["source_language"], optional_languages=["target_language"],
            limits=["limit"], bounded={"min_similarity": (-1, 1)},
        ),
        vectors.NEIGHBOUR_DEFAULTS, "semantic", ("source_language",),
    ),
    "rhymes": Operator(wordplay.rhymes, _WORD),
    "near_rhymes": Operator(wordplay.near_rhymes, _WORD),
    "search": Operator(wordplay.search, {**_WORD, "names": {"mode": wordplay.SEARCH_MODES}}),
    "anagrams": Operator(wordplay.anagrams, _WORD),
    "palindromes": Operator(wordplay.palindromes, _WORD),
    "spoonerisms": Operator(wordplay.spoonerisms, {"texts": ["left", "right"], "limits": ["limit"]}),
    "puns": Operator(
        wordplay.puns, {**_WORD, "contexts": ["context"]}, {**_LIMIT, "context": ("string", None)}
    ),
}


def ask(
    kind: str, corpus: Corpus, requests: DataFrame, in_place: DataFrame | None = None, **options: Any
) -> tuple[DataFrame, DataFrame]:
    """(answers, rejects) of a request table.

    ``in_place``(capability, language, reason) is an availability table; when given,
    requests for languages whose reason is not ``installed`` are rejected with it.
    """
    operator = OPERATORS[kind]
    valid, rejects = validate(with_defaults(requests, operator.defaults), **operator.checks)
    if in_place is not None:
        offered = in_place.filter(F.col("capability") == operator.capability)
        for column in operator.languages:
            known = offered.select(F.col("language").alias(column), F.col("reason").alias("__why"))
            judged = valid.join(known, column, "left").withColumn(
                "__why", F.coalesce("__why", F.lit("unknown_language"))
            )
            refused = judged.filter(F.col("__why") != "installed")
            rejects = rejects.unionByName(
                refused.select("request_id", F.concat_ws(": ", F.lit(column), "__why").alias("reason"))
            )
            valid = judged.filter(F.col("__why") == "installed").drop("__why")
    return operator.run(corpus, valid, **options), rejects
