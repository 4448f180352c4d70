"""Dictionary tables laid out by what lookups join them on.

Headwords are bucketed and sorted by (normalised term, language), entries by their term,
senses by their entry. A table of requests is then shuffled to the buckets, and so are the
rows found so far; the dictionary itself is never shuffled, by whatever query.
The groups of these keys are small by nature: spellings of a word, entries of a term, senses
of an entry. Edges are not laid out so, since all edges of a hub would lie in one bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..schemas import TABLES, Corpus
from ..session import shared_folder

#: Keys of the tables that lookups join in this order.
LAYOUT = {
    "terms": ["normalized_term", "language"],
    "entries": ["term_id"],
    "senses": ["entry_id"],
}


def bucketed(table: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """``table`` written to the shared folder in ``buckets`` sorted files, one per bucket."""
    spark = table.sparkSession
    own = f"{name}_{uuid.uuid4().hex}"
    (
        table.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
        .option("path", f"{shared_folder(spark)}/{own}").saveAsTable(own)
    )
    return spark.table(own)


def bucketed_corpus(corpus: Corpus, buckets: int) -> Corpus:
    """The corpus with its headwords, entries and senses laid out for lookups."""
    return corpus.extended(
        **{
            name: bucketed(getattr(corpus, name).select(*TABLES[name].fieldNames()), name, keys, buckets)
            for name, keys in LAYOUT.items() if corpus.has(name)
        }
    )
