"""Toxicity, licenses, top-k, shards and the pipeline against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glossweave.llm import licenses, sharding, topk, toxicity
from glossweave.llm.common import shingle_hashes

from .conftest import EDGES


# -------------------------------------------------------------------- toxicity
def labelled(spark, seed=1, rows=900):
    draw = random.Random(seed)
    plain = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(400)]
    insults = ["blorp", "snarfle", "grumbit"]
    docs, labels = [], []
    for i in range(rows):
        words = draw.choices(plain, k=60)
        toxic = draw.random() < 0.2
        if toxic:
            words[5:5] = draw.sample(insults, 2) + ["zwick" + "".join(draw.choices("abc", k=3)) for _ in range(2)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity(spark, documents):
    docs, labels = labelled(spark)
    extra = [(i if i is None else 5000 + i, t) for i, t in EDGES] + [
        (6001, "what a BL0RP and snаrfle"), (6002, "abcd efgh"), (6003, "the blorp can")
    ]
    table = spark.createDataFrame(labels + [(None, 1), (3, None), (7, labels[7][1])], "doc_id long, toxic int")
    every = documents(docs + extra)
    lexicon = toxicity.learn_lexicon(every, table, exceptions=("blorp can",))
    assert {"blorp", "snarfle", "grumbit"} <= {e.rstrip("*") for e in lexicon.weights}
    assert any(e.startswith("zwick") and e.endswith("*") for e in lexicon.weights)
    scored = toxicity.score_documents(every, lexicon).collect()
    assert len(scored) == len(docs) + len(extra)
    truth = dict(labels)
    held = [r for r in scored if r["held_out"] and r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held) and len(held) > 100
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    by = {r["doc_id"]: r for r in scored}
    assert by[6001]["predicted"] == 1 and by[6002]["predicted"] == by[6003]["predicted"] == by[5001]["predicted"] == 0
    clean = toxicity.keep_clean(every, lexicon)
    assert clean.columns == every.columns
    assert clean.count() == sum(r["predicted"] == 0 for r in scored)


def test_toxicity_does_not_learn_held_out_labels(spark, documents):
    docs, labels = labelled(spark, 2, 300)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    frames = [spark.createDataFrame(x, "doc_id long, toxic int") for x in (labels, flipped)]
    one, two = (toxicity.learn_lexicon(documents(docs), f) for f in frames)
    assert one == two


def test_toxicity_without_labels(spark, documents):
    lexicon = toxicity.learn_lexicon(documents(EDGES), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score_documents(documents(EDGES), lexicon).collect()} == {0}
    assert toxicity.score_documents(documents([]), lexicon).collect() == []


def test_toxicity_learns_from_few_rows(spark, documents):
    docs, labels = labelled(spark, 3, 70)
    lexicon = toxicity.learn_lexicon(documents(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"blorp", "snarfle", "grumbit"} & {e.rstrip("*") for e in lexicon.weights}
    truth, by = dict(labels), {r["doc_id"]: r for r in toxicity.score_documents(documents(docs), lexicon).collect()}
    assert sum(by[i]["predicted"] for i, t in truth.items() if t) > sum(truth.values()) / 2
    assert sum(by[i]["predicted"] for i, t in truth.items() if not t) <= 2


def test_toxicity_keeps_texts_without_hits(spark, documents):
    """Half of the rows are toxic, and no word says which: none may be dropped."""
    docs = [(i, f"some words {i % 7}") for i in range(60)]
    labels = spark.createDataFrame([(i, i // 7 % 2) for i, _ in docs], "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(documents(docs), labels)
    assert {r["predicted"] for r in toxicity.score_documents(documents(docs), lexicon).collect()} == {0}
    assert toxicity.keep_clean(documents(docs), lexicon).count() == len(docs)


def test_toxicity_evidence_follows_rows_and_entries():
    share = 9 / 64
    evidence = np.array([4, 4, 4, 4, 3, 3]) * np.log(1 / share)
    one = np.ones(6, int)
    few = toxicity._trusted(evidence, one, {1: 20_000, 3: 10, 4: 40}, share)
    many = toxicity._trusted(evidence, one, {1: 20_000, 3: 10, 4: 40_000}, share)
    assert len(few) == 6 and all(few > 0.9) and len(many) == 0
    # entries of equal counts are one kind, tested as often as they occur
    kinds = toxicity._trusted(evidence[[0, 4]], np.array([4, 2]), {1: 20_000, 3: 10, 4: 40}, share)
    assert kinds.tolist() == few[[0, 4]].tolist()


def test_toxicity_sample_is_bounded_by_ids(spark, documents):
    """A third of all rows carry one labelled id: it gives one row, and the bound holds."""
    hot = next(k for k in range(9) if zlib.crc32(str(k).encode()) % 4 != 2)
    rows = [(hot, f"text number {k % 5}") for k in range(400)] + [(100 + k, f"other {k}") for k in range(800)]
    labels = spark.createDataFrame([(hot, 1), (hot, 0)] + [(100 + k, k % 2) for k in range(800)], "doc_id long, toxic int")
    every = toxicity.labelled_sample(documents(rows), labels).collect()
    known = [100 + k for k in range(800) if zlib.crc32(str(100 + k).encode()) % 4 != 2]
    assert len(every) == len(known) + 1
    assert [r["toxic"] for r in every if r["text"].startswith("text")] == [1]
    assert [r["text"] for r in every if r["text"].startswith("text")] == ["text number 0"]
    assert toxicity.labelled_sample(documents(rows), labels, 50).count() <= 50


def plain_features(lexicon, text):
    """Every entry tried at every word, every exception at every place."""
    folded = toxicity.fold(text) + " "
    words = [(m.start(), m.group()) for m in re.finditer("[^ ]+", folded)]
    spared = set()
    for phrase in map(toxicity.fold, lexicon.exceptions):
        for start, _ in words:
            if folded.startswith(phrase + " ", start):
                spared |= set(range(start, start + len(phrase)))
    found = {}
    for start, word in words:
        weights = [
            w for e, w in lexicon.weights.items()
            if (word.startswith(e[:-1]) if e.endswith("*") else word == e)
        ]
        if weights and max(weights) > 0 and start not in spared:
            found[word] = max(weights)
    total = sum(found.values())
    return total, (math.log1p(100 * total / folded.count(" ")) if total else 0.0)


def test_toxicity_matches_like_a_plain_matcher():
    draw = random.Random(6)
    lexicon = toxicity.Lexicon(
        {"ab": 2.0, "ab*": 1.5, "abc*": 3.0, "cab": 1.0, "b*": 0.5, "ccc": 40.0},
        ("ab c", "c ab", "ab cab b", "b b b", "cab"),
    )
    for _ in range(3000):
        text = "".join(draw.choices("aAbBc4 8.", k=draw.randint(0, 25)))
        assert lexicon.features(text) == pytest.approx(plain_features(lexicon, text)), text
    assert lexicon.features("ccc " * 1000)[0] == 40.0


def test_toxicity_learns_exception_phrases(spark, documents):
    """'blorp' is an insult, but not in 'blorp engine', as the clean rows show."""
    docs, labels = labelled(spark, 8, 900)
    truth = dict(labels)
    docs = [(i, t if truth[i] or i % 12 else t + " the blorp engine runs") for i, t in docs]
    lexicon = toxicity.learn_lexicon(documents(docs), spark.createDataFrame(labels, "doc_id long, toxic int"), exceptions=())
    assert any(e.startswith("blorp") for e in lexicon.weights) and "blorp engine" in lexicon.exceptions
    scored = toxicity.score_documents(documents([(9001, "a blorp engine"), (9002, "you blorp snarfle")]), lexicon)
    assert {r["doc_id"]: r["predicted"] for r in scored.collect()} == {9001: 0, 9002: 1}


# -------------------------------------------------------------------- licenses
def test_licenses_against_all_templates(spark, documents):
    draw = random.Random(5)
    filler = [f"w{k}" for k in range(500)]
    rows = []
    for i in range(120):
        words = draw.choices(filler, k=draw.randrange(0, 80))
        if i % 3 == 0:
            words[10:10] = draw.choice(list(licenses.TEMPLATES.values())).split()
        rows.append((i, " ".join(words)))
    rows += [(100 + i, t) for i, t in EDGES if i is not None]
    found = defaultdict(set)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for r in licenses.scan_licenses(documents(rows)).collect():
        found[r["doc_id"]].add(r["license"])
        assert any((t or "").encode()[r["start"] : r["end"]].decode() for t in texts[r["doc_id"]])
    for i, own in texts.items():
        wanted = set()
        for text in own:
            blocks = list(licenses.word_spans(pa.array([text or ""])))
            grams = set(shingle_hashes(blocks[0][1], licenses.WORDS).tolist())
            for name, template in licenses.TEMPLATES.items():
                need = set(licenses._shingles(template, licenses.WORDS).tolist())
                if len(need & grams) >= licenses.CONTAINED * len(need):
                    wanted.add(name)
        assert found[i] == wanted
    assert licenses.scan_licenses(documents([])).collect() == []


def test_notices_shorter_than_a_shingle(spark, documents):
    rows = [(1, "© Ünal 2024. All rights\n reserved."), (2, "all rights reserved all rights reserved"),
            (3, "all rights"), (4, "reserved"), (5, "all rights are reserved"), (6, "All Rights Reserved")]
    found = Counter()
    for r in licenses.scan_licenses(documents(rows)).collect():
        assert r["license"] == "All-rights-reserved" and r["containment"] == 1
        passage = dict(rows)[r["doc_id"]].encode()[r["start"] : r["end"]].decode()
        assert passage.lower().split() == ["all", "rights", "reserved"]
        found[r["doc_id"]] += 1
    assert found == {1: 1, 2: 2, 6: 1}
    own = licenses.scan_licenses(documents(rows), {"one": "Reserved", "two": "all rights"}).collect()
    assert Counter(r["license"] for r in own) == {"one": 6, "two": 6}


def test_sibling_licenses_are_told_apart(spark, documents):
    every = licenses.TEMPLATES | licenses.SHORT_TEMPLATES | licenses.SIBLING_TEMPLATES
    names = list(every)
    rows = [(k, f"before the notice {every[name]} behind it") for k, name in enumerate(names)]
    both = "licensed under the GNU General Public License, version {}. "
    header = every["GPL-3.0-or-later"]
    rows += [
        (100, both.format(2) + both.format(3)), (101, both.format(9)), (102, header.replace("version 3", "version 9")),
        (103, every["AGPL-3.0-or-later"] + ". See the GNU General Public License"),
        (104, header.replace("of the License, or", "or")), (105, "Re" + both.format(3).replace("licensed", "leased")),
    ]
    found = defaultdict(set)
    for r in licenses.scan_licenses(documents(rows)).collect():
        found[r["doc_id"]].add(r["license"])
    nested = {"Apache-2.0-header": {"Apache-2.0"}}
    for k, name in enumerate(names):
        assert found[k] == {name} | nested.get(name, set())
    assert found[100] == {"GPL-2.0", "GPL-3.0"} and not found[101] and not found[102]
    assert found[103] == {"AGPL-3.0-or-later"} and found[104] == {"GPL-3.0-or-later"} and found[105] == {"GPL-3.0"}
    # templates of names that no list has: the best one of a span
    given = {"red": "this work may be used under the red terms by all", "blue": "this work may be used under the blue terms by all people who ask for it nicely and in time or later than that if they wish so"}
    given["green"] = given["blue"].replace("blue", "green")
    own = licenses.scan_licenses(documents([(1, given["blue"]), (2, given["green"])]), given).collect()
    assert {(r["doc_id"], r["license"]) for r in own} == {(1, "blue"), (2, "green")}


def test_usual_notices_and_names(spark, documents):
    notices = {
        "licensed under the MIT license": "MIT", "Distributed under the MIT License.": "MIT",
        "under the Apache License, Version 2.0": "Apache-2.0", "Licensed under the Apache License v2.0": "Apache-2.0",
        "This is the BSD 3-Clause License": "BSD-3-Clause", "the Apache-2.0 license": "Apache-2.0",
        "the GNU General Public License version 2 as published": "GPL-2.0", "GPLv3 or later": "GPL-3.0",
        "Creative Commons Attribution-NonCommercial 4.0": "CC-BY-NC-4.0", "the CC BY-SA 3.0": "CC-BY-SA-3.0",
        "Eclipse Public License v2.0": "EPL-2.0", "CC0 1.0 Universal": "CC0-1.0", "GNU LGPL v2.1 here": "LGPL-2.1",
    }
    rows = list(enumerate(notices))
    found = defaultdict(list)
    for r in licenses.scan_licenses(documents(rows)).collect():
        found[r["doc_id"]].append(r["license"])
    assert [found[k] for k, _ in rows] == [[f"{n}-name"] for n in notices.values()]
    plain = ["a licence for MIT students", "apache helicopters, version 2.0", "general public version 3", "cc by mail", "GPL"]
    assert licenses.scan_licenses(documents(list(enumerate(plain)))).collect() == []


def test_names_against_all_spellings(spark, documents):
    """Brute force: a spelling is found where its words stand, unless a longer passage of its family covers it."""
    draw = random.Random(11)
    spellings = [(n, t) for n, texts in licenses.license_names().items() for t in texts]
    assert len({tuple(licenses._WORD.findall(t.lower())) for _, t in spellings}) == len(spellings)
    rows = []
    for i in range(150):
        words = [draw.choice("abcdefgh") * 3 for _ in range(20)]
        for _ in range(3):
            at = draw.randrange(20)
            words[at:at] = draw.choice(spellings)[1].split()
        rows.append((i, " ".join(words) + draw.choice(["", " €", " License 2.0", " 1"])))
    rows.append((900, "x " * 300_000 + "MIT License" + " y" * 300_000))
    got = Counter((r["doc_id"], r["license"], r["start"]) for r in licenses.scan_licenses(documents(rows), {"none": "qqq"}, names=licenses.license_names()).collect())
    wanted = Counter()
    for i, text in rows:
        marked = [(m.group(), len(text[: m.start()].encode())) for m in licenses._WORD.finditer(text.lower())]
        whole, spans, places = [w for w, _ in marked], [], defaultdict(list)
        for k, word in enumerate(whole):
            places[word].append(k)
        for name, t in spellings:
            own = licenses._WORD.findall(t.lower())
            spans += [(k, k + len(own), name) for k in places[own[0]] if whole[k : k + len(own)] == own]
        for a, b, name in spans:
            family = name.split("-")[0]
            if not any(c <= a and b <= d and d - c > b - a and other.split("-")[0] == family for c, d, other in spans):
                wanted[i, name, marked[a][1]] += 1
    assert got == wanted


def test_full_text_parts(spark, documents):
    every = licenses.FULL_TEXT_TEMPLATES
    rows = [(k, f"text before. {text} and text behind") for k, text in enumerate(every.values())]
    found = defaultdict(set)
    for r in licenses.scan_licenses(documents(rows)).collect():
        found[r["doc_id"]].add(r["license"])
    assert [found[k] for k in range(len(rows))] == [{name} for name in every]


def test_sliding_least():
    values = np.random.default_rng(1).integers(0, 1000, 57).astype(np.uint64)
    for window in (1, 2, 3, 7, 8, 60):
        wanted = [values[k : k + window].min() for k in range(len(values))]
        assert licenses._sliding_least(values, window).tolist() == wanted


# ----------------------------------------------------------------------- top-k
def brute_top(rows, asks):
    """Answers of every asking row, in the order of its id; a row meets all rows but itself."""
    whole = [
        (i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    found = []
    for q, (i, v) in enumerate(whole):
        if i in asks:
            scores = [(-sum(a * b for a, b in zip(v, w)), j) for c, (j, w) in enumerate(whole) if c != q]
            found += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:10], 1)]
    return Counter(found)


@pytest.mark.parametrize("count", [0, 5, 400])
def test_top_k(spark, monkeypatch, count):
    monkeypatch.setattr(topk, "CHUNK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    draw = np.random.default_rng(6)
    rows = [(int(k), [float(x) for x in draw.normal(size=6).round(2)]) for k in range(count)]
    if count:
        rows += [(1000 + k, rows[0][1]) for k in range(30)] + [rows[1], (2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 6), (None, rows[0][1])]
        # rows that repeat, asking ones too, an id with two vectors, an empty vector
        rows += [rows[0], rows[0], rows[2], (0, rows[4][1]), (50, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score")
    vectors = topk.whole_numbers(frame)
    asked = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    found = topk.exact_top_k(vectors, asked).select("query_id", "rank", "vec_id", "score").collect()
    assert Counter(map(tuple, found)) == brute_top(rows, {i for i, _ in rows if i is not None and i % 50 == 0})


# ---------------------------------------------------------------------- shards
@pytest.mark.parametrize("hot", [False, True])
def test_shards(spark, documents, hot):
    draw = random.Random(7)
    rows = [(k if not hot or k % 3 else 77, "x" * draw.randrange(0, 200)) for k in range(3000)] + EDGES[:5] + EDGES[6:7]
    found = sharding.shard_documents(documents(rows)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    sizes, slots = Counter(), defaultdict(list)
    for r in found:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 0.005 * sum(sizes.values()) / 8 + 2 * 201


def test_splitters_name_the_parts_of_the_exchange(spark, documents):
    """A third of all rows share a key; parts within shards are even too, and shards stay as even as before."""
    draw = random.Random(9)
    rows = [(k if k % 3 else 77, "x" * draw.randrange(0, 200)) for k in range(6000)]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = sharding.shard_documents(documents(rows)).collect()
        sized = sharding.sized_rows(documents(rows)).withColumn("key", F.col("doc_id")).cache()
        cuts = sharding.find_splitters(sized, 40, sharding.PART_TOLERANCE, sharding.PART_PROBES)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert len(found) == 6000
    slots, sizes = defaultdict(list), Counter()
    for r in found:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 0.005 * sum(sizes.values()) / 8 + 2 * 201
    parts = Counter()
    for r in sized.collect():
        parts[sum((r["key"], r["place"]) >= cut for cut in cuts)] += r["size"]
    share = sum(sizes.values()) / 40
    assert len(parts) == 40 and max(parts.values()) <= 1.5 * share


def test_shards_of_nothing_and_of_one_giant(spark, documents):
    assert sharding.shard_documents(documents([])).collect() == []
    found = sharding.shard_documents(documents([(1, "a"), (2, "b" * 100_000), (None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in found) == [(0, 1), (1, 2), (2, 100_001)]


# -------------------------------------------------------------------- pipeline
def test_pipeline(spark, tmp_path):
    docs, labels = labelled(spark, 3, 300)
    base = " ".join(f"n{k}" for k in range(120))
    docs += [(1000, base), (1001, base), (1002, base + " more"), (1003, "my token = abcdef123 " + "q r s t u v"), (1004, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, str(tmp_path))
        assert kept.columns == before.columns
    kept = {r["doc_id"]: r["text"] for r in kept.collect()}
    clean = {i for i, toxic in labels if not toxic}
    assert len(clean - kept.keys()) <= 3 and len(kept.keys() & {i for i, toxic in labels if toxic}) <= 3
    assert kept.keys() & {1000, 1001, 1002} == {1000}
    assert kept[1003] == "my [secret] q r s t u v" and kept[1004] is None
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == kept.keys()
