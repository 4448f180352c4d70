"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded text.

Folding lower-cases, maps look-alike letters of other scripts and digits that stand for
letters to Latin letters, and turns what is no letter into blanks. The lexicon is learned
from labelled rows: words, and beginnings of words (stems), that toxic documents hold far
more often than others. A text's hits, outside exception phrases, add up their weights; the
sum and its share of the text's words go into a logistic score fitted on the same rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import arrow_map, land

THRESHOLD = 0.3
_HITLESS = math.log(THRESHOLD / (1 - THRESHOLD)) - 0.1  # most that a text without hits scores, in log-odds
#: Most labelled rows that the lexicon and the score are fitted on, chosen by a hash of their id.
FIT_ROWS = 20_000
_STEM = range(4, 13)
_COUNTED = 100  # documents whose entries are held at a time
_FALSE = 0.1  # share of chance finds among the entries, at most
_SURE = 80.0  # nats beyond which chance finds are not counted
_SAME = 1e-6  # evidence that differs by less is the same
_LIFT = 2.5  # an entry's share of toxic documents, over that of all documents, at least

#: Phrases in which a lexicon word is no insult, besides those that are learned (fixed list; matched in folded text).
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "take out the trash", "circus clown", "clown fish", "pond scum",
    "soap scum", "rodeo clown", "sore loser", "gracious loser", "the idiot by dostoevsky", "moronic acid",
)

# fixed values: letters that look like Latin ones, and digits and signs used for letters
_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѐ": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j",
    "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v",
    "ԝ": "w", "х": "x", "ѡ": "w", "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ɑ": "a", "ɡ": "g", "ı": "i", "ո": "n", "ս": "u", "օ": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}


class _Folding(dict):
    """Translation table that works out a character when it first meets it."""

    def __missing__(self, point: int) -> str:
        letter = chr(point)
        if 0xFF01 <= point <= 0xFF5E:  # full-width forms
            letter = chr(point - 0xFEE0).lower()
        letter = _ALIKE.get(letter, letter)
        self[point] = folded = letter if letter.isalpha() else " "
        return folded


_FOLDING = _Folding()


def fold(text: str) -> str:
    return text.lower().translate(_FOLDING)


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learned from; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Lexicon:
    """Entries with weights (a trailing * marks a stem), exceptions, and the fitted score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-4.0, 1.0, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            built = ahocorasick.Automaton()
            kinds: dict[str, dict[str, float]] = {}
            for entry, weight in self.weights.items():
                stem = entry.endswith("*")
                kinds.setdefault(entry.rstrip("*"), {})["stem" if stem else "word"] = weight
            for phrase in self.exceptions:
                kinds.setdefault(fold(phrase), {})["exception"] = 0.0
            for entry, found in kinds.items():
                built.add_word(entry, (len(entry), found))
            if kinds:
                built.make_automaton()
            self._automaton = built
        return self._automaton

    def hits(self, folded: str) -> dict[int, float]:
        """Starts of the words that an entry matches outside exceptions, with the weight of the best entry."""
        automaton = self.automaton()
        best: dict[int, float] = {}
        if not len(automaton):
            return best
        spared: list[tuple[int, int]] = []
        for end, (length, kinds) in automaton.iter(folded):
            start = end - length + 1
            if start and folded[start - 1] != " ":
                continue
            whole = folded[end + 1] == " "
            if whole and "exception" in kinds:
                spared.append((start, end))
            weight = kinds.get("stem", 0.0)
            if whole:
                weight = max(weight, kinds.get("word", 0.0))
            if weight > best.get(start, 0.0):
                best[start] = weight
        # exceptions come in the order of their ends; of two that start alike the later one reaches further
        reach = dict(spared)
        starts = sorted(reach)
        furthest = list(accumulate((reach[s] for s in starts), max))
        for start in list(best):
            at = bisect_right(starts, start) - 1
            if at >= 0 and furthest[at] >= start:
                del best[start]
        return best

    def phrases(self, text: str) -> set[str]:
        """Each hit with the word before it and with the word after it."""
        folded = fold(text) + " "
        found = self.hits(folded)
        words = folded.split()
        places = [m.start() for m in re.finditer(r"[^ ]+", folded)] if found else []
        pairs = set()
        for k, place in enumerate(places):
            if place in found:
                pairs.update(" ".join(words[a : a + 2]) for a in (k - 1, k) if 0 <= a < len(words) - 1)
        return pairs

    def features(self, text: str) -> tuple[float, float]:
        """The weighted sum of hits, and the logarithm of its share per hundred words."""
        folded = fold(text) + " "
        # a word that is said again counts once
        words = {folded[start : folded.find(" ", start)]: weight for start, weight in self.hits(folded).items()}
        total = sum(words.values())
        return total, (math.log1p(100 * total / folded.count(" ")) if total else 0.0)

    def scores(self, features: np.ndarray) -> np.ndarray:
        a, b, c = self.coefficients
        return 1 / (1 + np.exp(-np.clip(a + b * features[:, 0] + c * features[:, 1], -30, 30)))


_COUNTS = "entry string, toxic long, clean long"


def _entries(text: str) -> set[str]:
    words = {w for w in fold(text).split() if len(w) > 2}
    return words | {w[:n] + "*" for w in words for n in _STEM if len(w) >= n}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per entry and label, added up per batch before they are shuffled."""
    for batch in batches:
        texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for first in range(0, len(texts), _COUNTED):
            toxic, clean = Counter(), Counter()
            for text, label in zip(texts[first : first + _COUNTED], labels[first : first + _COUNTED], strict=True):
                (toxic if label else clean).update(_entries(text))
            names = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()),
                 pa.array([clean[n] for n in names], pa.int64())],
                names=["entry", "toxic", "clean"],
            )


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text and toxic of at most ``rows`` labelled rows that are not held out.

    Rows are taken in the order of a hash of their id. Labels that are null or have no id are
    left out; of repeated labels for an id the largest counts, and of documents that repeat an
    id the least text, so that an id gives one row, however many rows hold it.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic "))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text "))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic ").agg(F.min("text ").alias("text "))
    return found.select(F.col("text ").alias("text"), F.col("toxic ").alias("toxic"))


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS
) -> Lexicon:
    """Lexicon and score fitted on at most ``rows`` labelled rows that are not held out.

    Entries are tested against the number of labelled rows and of entries (``_trusted``); that
    test alone says where the lexicon ends. What reaches the driver is the lexicon itself, the
    numbers of entries per count of toxic and clean rows, and two features per fitted row.
    Phrases in which an entry is no sign of toxicity are learned from the same rows and join
    the given ``exceptions``. With no labels, or labels of one kind only, the lexicon is empty
    and every score is the same, under ``THRESHOLD``. Repeated ids: see ``labelled_sample``.
    """
    sample = land(labelled_sample(docs, labels, rows), "labelled")
    classes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = classes.get(1, 0), classes.get(0, 0)
    lexicon = Lexicon({}, exceptions, (-4.0, 0.0, 0.0))
    if not toxic or not clean:
        return lexicon
    share = toxic / (toxic + clean)
    counted = land(sample.transform(arrow_map, _counted, _COUNTS).groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    ), "entries")
    held = F.col("toxic") + F.col("clean")
    # evidence: log-likelihood ratio of the entry's own share of toxic documents against the overall one
    part = F.col("toxic") / held
    evidence = F.col("toxic") * F.log(part / share) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log((1 - part) / (1 - share))
    ).otherwise(0.0)
    strong = counted.where((F.col("toxic") > 0) & (part >= _least_part(share))).withColumn("evidence", evidence)
    sizes = {r["held"]: r["count"] for r in counted.groupBy(held.alias("held")).count().collect()}
    # evidence depends on the two counts only, so entries of equal counts are tested together
    tested = strong.groupBy("toxic", "clean").agg(F.first("evidence").alias("evidence"), F.count(F.lit(1)).alias("n"))
    kinds = sorted(tested.collect(), key=lambda r: (-r["evidence"], r["toxic"], r["clean"]))
    sure = _trusted(np.array([r["evidence"] for r in kinds]), np.array([r["n"] for r in kinds], int), sizes, share)
    trusted = {(r["toxic"], r["clean"]): float(one) for r, one in zip(kinds, sure)}
    if not trusted:
        return lexicon
    found = strong.where(F.col("evidence") >= kinds[len(trusted) - 1]["evidence"] - _SAME).collect()
    found = [r for r in found if (r["toxic"], r["clean"]) in trusted]
    weights = _generalised(found, toxic, clean, {r["entry"]: trusted[r["toxic"], r["clean"]] for r in found})
    learned = _exception_phrases(sample, Lexicon(weights, exceptions))
    lexicon = Lexicon(weights, (*exceptions, *learned))
    lexicon.coefficients = _fit(sample, lexicon)
    return lexicon


def _exception_phrases(sample: DataFrame, lexicon: Lexicon) -> list[str]:
    """Pairs of neighbouring words that hold a hit, stand in clean rows and in no toxic one.

    A pair counts if, were it as toxic as the hits of the lexicon are, so many clean rows
    would come up by chance in fewer than one of a hundred of the pairs tried.
    """
    phrases = land(
        sample.transform(arrow_map, _neighbours(lexicon), _COUNTS).groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "phrases",
    )
    sums = phrases.agg(F.sum("toxic"), F.sum("clean"), F.count(F.lit(1))).first()
    if not sums[2] or not sums[1]:
        return []
    clean_share = sums[1] / (sums[0] + sums[1])
    least = math.ceil(math.log(0.01 / sums[2]) / math.log(clean_share)) if clean_share < 1 else math.inf
    if least == math.inf:
        return []
    chosen = phrases.where((F.col("toxic") == 0) & (F.col("clean") >= max(least, 2))).collect()
    return sorted(r["entry"] for r in chosen)


def _neighbours(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(lexicon.phrases(text))
            names = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()),
                 pa.array([clean[n] for n in names], pa.int64())],
                names=["entry", "toxic", "clean"],
            )

    return run


def _least_part(share: float) -> float:
    return min(_LIFT * share, (1 + share) / 2)


def _trusted(evidence: np.ndarray, entries: np.ndarray, sizes: dict[int, int], share: float) -> np.ndarray:
    """For the leading kinds of entries that are kept: one less the share of chance finds down to each.

    ``evidence`` falls, ``entries`` says how many entries have it; ``sizes`` says how many entries are held by so many rows. If labels were
    drawn by chance, the entries of each size would reach an evidence with a binomial
    probability. The sum of these over all entries is compared with the number of entries
    found, and the list ends where more than ``_FALSE`` of it would be there by chance. So the
    evidence asked for follows the numbers of rows and entries.
    """
    factorials = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, max(sizes, default=0) + 1)))))
    points, chances = [np.empty(0)], [np.empty(0)]
    for held, count in sizes.items():
        k = np.arange(max(1, math.ceil(_least_part(share) * held - 1e-9)), held + 1)
        rest = held - k
        points.append(
            k * np.log(k / (held * share)) + rest * np.log(np.maximum(rest, 1) / (held * (1 - share)))
        )
        near = factorials[held] - factorials[k] - factorials[rest] + k * math.log(share) + rest * math.log1p(-share)
        chances.append(count * np.exp(near))
        points[-1], chances[-1] = points[-1][points[-1] < _SURE], chances[-1][points[-1] < _SURE]
    point, chance = np.concatenate(points), np.concatenate(chances)
    order = np.argsort(point)
    above = np.concatenate((np.cumsum(chance[order][::-1])[::-1], [0.0]))
    expected = above[np.searchsorted(point[order], evidence - _SAME)]
    upto = np.searchsorted(-evidence, -evidence + _SAME, side="right")  # kinds with as much evidence, or more
    found = np.concatenate(([0], np.cumsum(entries)))[upto]
    false = np.minimum.accumulate((expected / np.maximum(found, 1))[::-1])[::-1]
    return 1 - false[false <= _FALSE]


def _generalised(found: list, toxic: int, clean: int, sure: dict[str, float]) -> dict[str, float]:
    """Weights of the entries that say something of their own, shrunken by the chance finds.

    A stem goes if a longer entry has nearly all of its toxic documents; an entry goes if a
    stem it begins with weighs about as much. A word counts with its best entry only.
    """
    by = {r["entry"]: (r["toxic"], r["clean"]) for r in found}
    weight = {
        e: sure[e] * (math.log((hits + 0.5) / (toxic + 1)) - math.log((misses + 0.5) / (clean + 1)))
        for e, (hits, misses) in by.items()
    }
    # a stem stands before the word of the same letters, so that the word goes if it says no more
    ordered = sorted(by, key=lambda e: (e.rstrip("*"), not e.endswith("*")))
    weights: dict[str, float] = {}
    open_: list[str] = []  # stems kept, each a beginning of the next
    for k, entry in enumerate(ordered):
        plain = entry.rstrip("*")
        while open_ and not plain.startswith(open_[-1]):
            open_.pop()
        if entry.endswith("*"):
            same = False
            for other in ordered[k + 1 :]:
                if not other.startswith(plain):
                    break
                same |= other != plain and by[other][0] >= 0.97 * by[entry][0] and by[other][1] <= by[entry][1]
            if same:
                continue
        if weight[entry] <= max((weights[s + "*"] for s in open_), default=0.0) + 1.0:
            continue
        weights[entry] = weight[entry]
        if entry.endswith("*"):
            open_.append(plain)
    return weights


def _featured(lexicon: Lexicon, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([lexicon.features(t or "") for t in batch.column(column).to_pylist()]).reshape(-1, 2)
            columns = [batch.column(k) for k in range(batch.num_columns) if k != column]
            names = [n for k, n in enumerate(batch.schema.names) if k != column]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lexicon.scores(found)), pa.array(found[:, 0]), pa.array(found[:, 1])],
                names=[*names, "score", "mass", "density"],
            )

    return run


def _fit(sample: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton steps, on the sampled rows' features."""
    rows = sample.transform(arrow_map, 
        _featured(lexicon, 0), "toxic int, score double, mass double, density double"
    ).toPandas()
    x = np.column_stack([np.ones(len(rows)), rows["mass"], rows["density"]])
    y = rows["toxic"].to_numpy(float)
    w, ridge = np.zeros(3), np.diag([1e-3, 0.1, 0.1])
    free = np.ones(3, bool)
    while True:
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope, bend = x.T @ (y - p) - ridge @ w, x.T @ (x * (p * (1 - p))[:, None]) + ridge
            step = np.linalg.solve(bend[np.ix_(free, free)], slope[free])
            w[free] += step
            if np.abs(step).max() < 1e-8:
                break
        if not free[0] or w[0] <= _HITLESS:
            break
        w, free[0] = np.array([_HITLESS, 0.0, 0.0]), False  # a text without hits stays under the threshold
    # hits never speak for a clean text
    return float(w[0]), float(max(w[1], 0.0)), float(max(w[2], 0.0))


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs(doc_id, text)``.

    Only the text enters the score. Null and empty texts have no hits and the least score;
    repeated rows are scored each by itself; other columns are ignored.
    """
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType())]
        + [T.StructField(n, T.DoubleType(), False) for n in ("score", "mass", "density")]
    )
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(arrow_map, 
        _featured(lexicon, 1), schema
    )
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns stay as they are.

    Null and empty texts have no hits and stay; repeated rows are scored each by itself.
    """
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([lexicon.features(t or "") for t in batch.column(place).to_pylist()]).reshape(-1, 2)
            yield batch.filter(pa.array(lexicon.scores(found) < threshold))

    return docs.transform(arrow_map, run, docs.schema)
