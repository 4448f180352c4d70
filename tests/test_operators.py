"""Operators against small loops and hand-made corpora."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.functions import phonetics, text
from glossweave.operators import graph, lookup, vectors, wordplay
from glossweave.operators.ranking import diversify, global_index, nearest_rank, quantile_picks, round_robin
from glossweave.operators.requests import answer_shared, validate
from glossweave.plans import layout, quality
from glossweave.schemas import TABLES, Corpus, assert_schema
from glossweave.sources.common import intern, term_key


def fair_share(groups: list[list], budget: int) -> list[list]:
    taken = [[] for _ in groups]
    turn = 0
    while budget > 0 and any(turn < len(g) for g in groups):
        for index, group in enumerate(groups):
            if turn < len(group) and budget > 0:
                taken[index].append(group[turn])
                budget -= 1
        turn += 1
    return taken


def test_round_robin_equals_loop(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for q in range(150):
        groups = [list(range(rng.randint(0, 6))) for _ in range(rng.randint(1, 5))]
        budget = rng.randint(0, 12)
        rows += [(q, g, i, budget) for g, items in enumerate(groups) for i in items]
        expected[q] = {(g, i) for g, items in enumerate(fair_share(groups, budget)) for i in items}
    df = spark.createDataFrame(rows, "q int, g int, i int, budget int")
    got = {q: set() for q in expected}
    for r in round_robin(df, ["q"], ["g"], ["i"], F.col("budget"), 100).collect():
        got[r["q"]].add((r["g"], r["i"]))
    assert got == expected


def test_diversify_equals_loop(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for q in range(100):
        listed = [(rng.randint(0, 4), rng.choice([None, "a", "b"])) for _ in range(rng.randint(1, 12))]
        rows += [(q, n, t, s) for n, (t, s) in enumerate(listed)]
        unique = list(dict.fromkeys(listed))
        first, rest, seen = [], [], set()
        for t, s in unique:
            (rest if t in seen else first).append((t, s))
            seen.add(t)
        expected[q] = first + rest
    df = spark.createDataFrame(rows, "q int, n int, target int, sense string")
    got = {}
    for r in diversify(df, ["q"], ["target", "sense"], ["target"], ["n"]).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["target"], r["sense"]))
    assert got == expected


def test_global_index_percentile_and_picks(spark):
    rng = random.Random(1)
    values = [(rng.choice("aab"), rng.randint(0, 50) / 2, n) for n in range(400)]
    df = spark.createDataFrame(values, "k string, v double, n int").repartition(7)
    indexed = global_index(df, ["v", "n"]).orderBy("index").collect()
    assert [r["index"] for r in indexed] == list(range(400))
    assert [(r["v"], r["n"]) for r in indexed] == sorted((v, n) for _, v, n in values)
    for r in nearest_rank(df, "k", "v", [0.5, 0.95]).collect():
        own = sorted(v for k, v, _ in values if k == r["k"])
        assert r["value"] == own[max(1, int(np.ceil(len(own) * r["quantile"]))) - 1]
    picks = quantile_picks(df, "k", "n", 5).collect()
    for key in "ab":
        own = sorted(n for k, _, n in values if k == key)
        assert sorted(r["n"] for r in picks if r["k"] == key) == [own[(2 * i + 1) * len(own) // 10] for i in range(5)]


def test_phonetic_keys(spark):
    rng = random.Random(2)
    tokens = phonetics.CONSONANTS[:6] + ["AH0", "AH1", "ER2", "IY0", "AXR1"]
    rows = [" ".join(rng.choice(tokens) for _ in range(rng.randint(1, 6))) for _ in range(400)]

    def rhyme(line):
        parts = line.split()
        for marks in ("12", "0123456789"):
            hits = [i for i, p in enumerate(parts) if p[-1] in marks]
            if hits:
                return " ".join(parts[hits[-1]:])
        return " ".join(parts[-2:])

    def split(line):
        parts = line.split()
        at = next((i for i, p in enumerate(parts) if p.rstrip("012") in phonetics.VOWELS), len(parts))
        return " ".join(parts[:at]), " ".join(parts[at:])

    p = F.col("p")
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    for r in df.select("p", phonetics.rhyme_key(p).alias("k"), phonetics.onset(p).alias("o"), phonetics.remainder(p).alias("m")).collect():
        assert r["k"] == rhyme(r["p"])
        assert (r["o"], r["m"]) == split(r["p"])
    assert len(phonetics.INVENTORY) == 88


def test_near_keys_equal_brute_force(spark):
    rng = random.Random(4)
    alphabet = ["AA1", "N", "D", "T", "QQ"]  # QQ is no known sound
    keys = sorted({" ".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(120)})

    def edits(key):
        t = key.split()
        out = set()
        for i in range(len(t)):
            out.add(" ".join(t[:i] + t[i + 1:]))
            out.update(" ".join(t[:i] + [p] + t[i + 1:]) for p in phonetics.INVENTORY if p != t[i])
        for i in range(len(t) + 1):
            out.update(" ".join(t[:i] + [p] + t[i:]) for p in phonetics.INVENTORY)
        return out - {""}

    expected = {(a, b) for a in keys for b in edits(a) & set(keys)}
    got = wordplay.near_keys(spark.createDataFrame([(k,) for k in keys], "key string"))
    assert {(r["key"], r["near_key"]) for r in got.collect()} == expected


def test_text_keys(spark):
    import unicodedata

    words = ["Straße", "ﬁne", "ÉTÉ", "İx", "  a  b ", "ΣΑΣ", "plain", "x\x1cy", "ＡＢ"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.lookup_key(F.col("w")).alias("k"))
    for r in rows.collect():
        assert r["k"] == " ".join(unicodedata.normalize("NFKC", r["w"]).casefold().split())
    tags = spark.createDataFrame([("EN_us",), ("x",), (None,), ("zh-Hant",)], "t string")
    assert [r[0] for r in tags.select(text.language_tag(F.col("t"))).collect()] == ["en-us", "und", "und", "zh-hant"]
    patterns = spark.createDataFrame([("a?b*",), ("50%_\\",)], "t string").select(text.like_pattern(F.col("t")))
    assert [r[0] for r in patterns.collect()] == ["a_b%", "50\\%\\_\\\\"]


def test_validation(spark):
    rows = [(1, "Word", "en", 5, 2), (2, " ", "en", 5, 2), (3, "a\tb", "en", 5, 2), (4, "w" * 257, "en", 5, 2),
            (5, "w", "e", 5, 2), (6, "w", "en", 0, 0), (7, "w", "en", 5, -1), (8, "w", "en", 5, 6), (9, None, "en", 5, 1)]
    df = spark.createDataFrame(rows, "request_id int, word string, language string, limit int, unsensed_limit int")
    valid, rejects = validate(df, texts=["word"], languages=["language"], limits=["limit"], allocations=["unsensed_limit"])
    assert [(r["request_id"], r["word"]) for r in valid.collect()] == [(1, "word")]
    reasons = {r["request_id"]: r["reason"] for r in rejects.collect()}
    assert set(reasons) == set(range(2, 10))
    assert reasons[7].endswith("reserved") and reasons[8].endswith("must not exceed limit")


def test_equal_questions_are_answered_once(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "x")], "request_id int, word string, sense string")
    seen = []

    def answer(questions):
        seen.append(questions.count())
        return questions.select("request_id", F.upper("word").alias("out"))

    got = {r["request_id"]: r["out"] for r in answer_shared(df, ["word", "sense"], answer).collect()}
    assert got == {1: "A", 2: "A", 3: "B"} and seen == [2]


def graph_corpus(spark, edges, senses=()):
    """edges: (source, source_sense, code, target, target_sense, direction, provenance); names are lang:term."""
    names = sorted({e[0] for e in edges} | {e[3] for e in edges})
    pairs = spark.createDataFrame([tuple(n.split(":")) for n in names], "language string, term string")
    raw = spark.createDataFrame(edges, "s string, source_sense_id string, relation_code int, t string, target_sense_id string, direction_code int, provenance_id int")
    key = lambda c: term_key(F.substring_index(c, ":", 1), F.substring_index(c, ":", -1))
    relations = raw.select(
        key("s").alias("source_term_id"), "source_sense_id", "relation_code", key("t").alias("target_term_id"),
        "target_sense_id", "direction_code", "provenance_id",
    )
    terms = intern(pairs)
    owned = spark.createDataFrame(list(senses) or [("", "", "")], "name string, sense_id string, gloss string").filter("name <> ''")
    entries = owned.select(F.concat(F.lit("e"), "name").alias("entry_id"), key("name").alias("term_id"), F.lit("noun").alias("part_of_speech"),
                           F.lit(None).cast("string").alias("etymology"), F.lit(1).alias("provenance_id")).distinct()
    corpus = Corpus(
        provenance=spark.createDataFrame([(1, "s1", "l", None), (2, "s2", "l", None)], TABLES["provenance"]),
        terms=terms, relations=relations, entries=entries,
        senses=owned.select("sense_id", F.concat(F.lit("e"), "name").alias("entry_id"), F.nullif("gloss", F.lit("")).alias("gloss")),
    )
    return corpus.extended(term_counts=layout.term_counts(corpus))


def test_two_hop_continuity_and_cross_language(spark):
    corpus = graph_corpus(spark, [
        ("en:dog", None, 3, "en:canine", None, 1, 1), ("en:canine", None, 3, "en:animal", None, 1, 1),
        ("en:canine", None, 3, "fr:bête", None, 1, 1), ("en:canine", None, 3, "en:other", None, 1, 2),
        ("en:dog", "d1", 3, "en:canine", "c1", 1, 1), ("en:canine", "c1", 3, "en:animal", "a1", 1, 1),
        ("en:canine", "c2", 3, "en:tooth", "t1", 1, 1), ("en:canine", None, 3, "en:dog", None, 1, 1),
        ("en:pup", None, 4, "en:dog", None, 2, 1),
    ])
    asked = spark.createDataFrame([(1, "dog", "hypernym", None), (2, "dog", "hypernym", "fr"), (3, "dog", "synonym", None)],
                                  "request_id int, word string, relation string, target_language string")
    rows = graph.relations(corpus, asked).orderBy("request_id", "rank").collect()
    paths = {(r["request_id"], r["target_term"], r["source_sense_id"], r["target_sense_id"]) for r in rows if r["distance"] == 2}
    assert paths == {(1, "animal", None, None), (1, "animal", "d1", "a1"), (1, "bête", None, None), (2, "bête", None, None)}
    # the unsensed path that a sensed one backs comes before all others
    first = next(r for r in rows if r["distance"] == 2)
    assert (first["target_term"], first["source_sense_id"]) == ("animal", None)
    direct = {(r["request_id"], r["target_term"], r["direction"]) for r in rows if r["distance"] == 1}
    # stored hyponym edges are read backwards as hypernyms
    assert direct == {(1, "canine", "outbound"), (1, "pup", "outbound")}


def test_inverse_reading_of_edges(spark):
    corpus = graph_corpus(spark, [("en:a", None, 5, "en:b", None, 1, 1), ("en:c", "s", 12, "en:a", None, 3, 2)])
    asked = spark.createDataFrame([(1, "b", "holonym"), (2, "a", "related"), (3, "b", "meronym")], "request_id int, word string, relation string")
    got = {(r["request_id"], r["target_term"], r["direction"], r["target_sense_id"]) for r in graph.relations(corpus, asked).collect()}
    assert got == {(1, "a", "inbound", None), (2, "c", "symmetric", "s")}


def test_synset_synonyms_by_position(spark):
    rng = random.Random(6)
    members = [(f"y{rng.randint(0, 2)}", f"s{n}", rng.randint(0, 30), None) for n in range(90)]
    df = spark.createDataFrame(members, "synset_id string, sense_id string, term_id bigint, part_of_speech string")
    got = {(r["sense_id"], r["target_term_id"], r["position"]) for r in graph.synset_synonyms(df).collect()}
    expected = set()
    for synset, sense, term, _ in members:
        others = sorted({t for y, _, t, _ in members if y == synset and t != term})
        expected |= {(sense, t, i) for i, t in enumerate(others)}
    assert got == expected


def test_lookup_prefers_translated_senses_and_shares_details(spark):
    corpus = graph_corpus(spark, [("en:w", None, 12, "fr:m", None, 3, 1), ("en:w", None, 12, "de:n", None, 3, 1)],
                          [("en:w", f"s{i}", "" if i > 6 else "g") for i in range(9)])
    target = {r["term"]: r["term_id"] for r in corpus.terms.collect()}
    corpus = corpus.extended(
        translations=spark.createDataFrame([("s8", target["m"], None, 1, 0), ("s8", target["n"], None, 1, 1), ("s5", target["m"], None, 1, 0)], TABLES["translations"]),
        examples=spark.createDataFrame([("s0", f"x{i}", i) for i in range(5)] + [("s8", "y0", 0)], TABLES["examples"]),
        pronunciations=spark.createDataFrame([("een:w", "/w/", "", 0)], TABLES["pronunciations"]),
    )
    asked = spark.createDataFrame([(1, "w", 4, 3)], "request_id int, word string, limit int, examples_limit int")
    assert [r["sense_id"] for r in lookup.lookup(corpus, asked).orderBy("rank").collect()] == ["s0", "s1", "s2", "s8"]
    items, cuts = lookup.lookup_details(corpus, asked)
    examples = {(r["sense_id"], r["value"]) for r in items.filter("field = 'examples'").collect()}
    assert examples == {("s0", "x0"), ("s8", "y0"), ("s0", "x1")}
    assert {(r["rank"], r["field"]) for r in cuts.collect()} == {(1, "examples")}
    nested = {r["sense_id"]: r for r in lookup.lookup_nested(corpus, asked).collect()}
    assert [t["term"] for t in nested["s8"]["translations"]] == ["m", "n"] and nested["s0"]["truncated_fields"] == ["examples"]
    translated = lookup.translate(corpus, spark.createDataFrame([(1, "w", "en", "fr")], "request_id int, word string, source_language string, target_language string"))
    assert [(r["sense_id"], r["term"]) for r in translated.orderBy("group_index").collect()] == [("s5", "m"), ("s8", "m")]


def spoken_corpus(spark, words):
    pairs = spark.createDataFrame([("en", w) for w in words], "language string, term string")
    terms = intern(pairs)
    rows = spark.createDataFrame([(w, p) for w, ps in words.items() for p in ps], "term string, phonemes string")
    spoken = rows.join(terms, "term").select("term_id", "phonemes", phonetics.rhyme_key(F.col("phonemes")).alias("rhyme_key"))
    none = spark.createDataFrame([], TABLES["entries"])
    return Corpus(terms=terms, spoken=spoken, entries=none, senses=spark.createDataFrame([], TABLES["senses"]))


WORDS = {
    "light": ["L AY1 T"], "right": ["R AY1 T"], "write": ["R AY1 T"], "Right": ["R AY1 T"], "ride": ["R AY1 D"],
    "leap": ["L IY1 P"], "reap": ["R IY1 P"], "level": ["L EH1 V AH0 L"], "noon": ["N UW1 N"], "bob": ["B AA1 B"],
    "read": ["R IY1 D", "R EH1 D"], "dear": ["D IY1 R"], "dare": ["D EH1 R"], "a_b": ["AH0"],
}


def test_wordplay(spark):
    corpus = spoken_corpus(spark, WORDS)
    ask = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "request_id int, text string")
    listed = lambda df, column="normalized_term": [(r["request_id"], r[column]) for r in df.orderBy("request_id", "rank").collect()]
    assert listed(wordplay.rhymes(corpus, ask("light"))) == [(0, "right"), (0, "write")]
    assert listed(wordplay.sounds_like(corpus, ask("right", "write"))) == [(0, "write"), (1, "right")]
    assert listed(wordplay.near_rhymes(corpus, ask("ride"))) == [(0, "light"), (0, "read"), (0, "right"), (0, "write")]
    assert listed(wordplay.prefixed(corpus, ask("l", "ri"))) == [(0, "leap"), (0, "level"), (0, "light"), (1, "ride"), (1, "right")]
    every = sorted({w.lower() for w in WORDS})
    patterns = ["*ight", "r?a*", "*ea*", "????", "*", "??*", "a_b*", "a*b"]

    def matches(pattern):
        import re
        body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
        return [w for w in every if re.fullmatch(body, w) and w != pattern]

    expected = [(i, w) for i, p in enumerate(patterns) for w in matches(p)]
    assert listed(wordplay.spelled_like(corpus, ask(*patterns))) == expected
    assert listed(wordplay.anagrams(corpus, ask("dare", "read"), 9)) == [(0, "dear"), (0, "read"), (1, "dare"), (1, "dear")]
    assert listed(wordplay.palindromes(corpus, ask("level", "c", "cat", "zz"), 9)) == [
        (0, "noon"), (0, "bob"), (2, "level"), (2, "noon"), (2, "bob"), (3, "bob"), (3, "level"), (3, "noon"),
    ]
    pair = spark.createDataFrame([(1, "light", "reap")], "request_id int, left string, right string")
    swap = wordplay.spoonerisms(corpus, pair).collect()[0]
    assert (swap["swapped_left_terms"], swap["swapped_right_terms"]) == (["right", "write"], ["leap"])
    assert swap["lexicality_scope"] == "lexical_term"


def vector_corpus(spark, n=300, d=8, languages=3):
    rng = np.random.default_rng(0)
    rows = [(i, f"l{i % languages}", f"w{i // 2 if i < 40 else i}", [float(x) for x in rng.normal(size=d)]) for i in range(n)]
    raw = spark.createDataFrame(rows, "semantic_id bigint, language string, term string, embedding array<float>")
    vectors_table = raw.select("semantic_id", F.col("term").alias("concept"), term_key(F.col("language"), F.col("term")).alias("term_id"), "embedding")
    return Corpus(terms=intern(raw), vectors=vectors_table), rows


def brute_force(rows, word, language, target, k):
    seed = min((r for r in rows if r[1] == language and r[2] == word), key=lambda r: r[0])
    q = np.array(seed[3], dtype=np.float32).astype(float)
    best = {}
    for i, lang, term, v in rows:
        if (lang, term) == (language, word) or (target and lang != target):
            continue
        v = np.array(v, dtype=np.float32).astype(float)
        s = float(q @ v / np.linalg.norm(q) / np.linalg.norm(v))
        if (lang, term) not in best or (-s, i) < best[lang, term]:
            best[lang, term] = (-s, i)
    return [i for _, i in sorted(best.values())[:k]]


@pytest.mark.parametrize("target", [None, "l1"])
def test_neighbours(spark, monkeypatch, target):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "STORED_BLOCK", 50)
    corpus, rows = vector_corpus(spark)
    words = sorted({(r[2], r[1]) for r in rows})[:40]
    asked = spark.createDataFrame([(n, w, lang, target, 5) for n, (w, lang) in enumerate(words)],
                                  "request_id int, word string, source_language string, target_language string, limit int")
    got = {}
    for r in vectors.neighbours(corpus, asked).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append(r["semantic_id"])
    assert got == {n: brute_force(rows, w, lang, target, 5) for n, (w, lang) in enumerate(words)}


def clustered(spark, n, d, clusters):
    """Vectors around a few hundred directions, as word vectors are, in three languages."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(clusters, d))
    points = centres[rng.integers(0, clusters, n)] + 0.35 * rng.normal(size=(n, d))
    rows = [(k, f"w{k}", ("en", "fr", "de")[k % 3], [float(x) for x in p]) for k, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "semantic_id long, term string, language string, embedding array<float>")
    frame = frame.withColumn("term_id", F.col("semantic_id")).withColumn("normalized_term", F.col("term")).cache()
    return Corpus(
        terms=lambda: frame.select("term_id", "term", "normalized_term", "language"),
        vectors=lambda: frame.select("semantic_id", F.col("term").alias("concept"), "term_id", "embedding"),
    )


def test_approximate_recall_of_clustered_vectors_at_a_tenth_of_the_cells(spark):
    corpus = clustered(spark, 20_000, 24, 150)
    report = vectors.recall_report(corpus, 10, 20, 0.1)
    summary = {r["index_scope"]: r for r in vectors.recall_summary(report).collect()}
    assert set(summary) == {"global", "language"} and all(r["passed"] for r in summary.values())
    assert all(r["mean_recall"] >= 0.9 for r in summary.values())


def test_recall_bar_can_fail(spark):
    corpus, _ = vector_corpus(spark, n=900, d=12)
    report = vectors.recall_report(corpus, 10, 20, 0.05, check_repeat=False)
    report = report.withColumn("deterministic", F.lit(True))
    assert not any(r["passed"] for r in vectors.recall_summary(report).collect())


def test_partition_assignment_equals_loop(spark):
    rng = random.Random(8)
    sizes = [(f"l{n}", rng.randint(1, 4000)) for n in range(60)]
    expected, filled, bundle = {}, 0, 1
    for language, terms in sorted(sizes, key=lambda s: (-s[1], s[0])):
        size = terms * 160
        if size >= 500_000:
            expected[language] = f"lexical-{language}"
            continue
        expected[language] = f"lexical-bundle-{bundle:03d}"
        filled += size
        if filled >= 900_000:
            filled, bundle = 0, bundle + 1
    plan = layout.assign_partitions(spark.createDataFrame(sizes, "language string, terms bigint"), 500_000, 900_000)
    assert {r["language"]: r["pack_id"] for r in plan.collect()} == expected


def test_partitions_are_closed_and_equal_the_whole(spark, tmp_path):
    corpus = graph_corpus(spark, [
        ("en:a", None, 12, "fr:b", None, 3, 1), ("fr:b", None, 3, "fr:c", None, 1, 1), ("de:d", None, 3, "en:a", None, 1, 2),
    ], [("en:a", "s1", "g"), ("fr:b", "s2", ""), ("fr:c", "s3", "g")])
    target = {r["term"]: r["term_id"] for r in corpus.terms.collect()}
    corpus = corpus.extended(
        translations=spark.createDataFrame([("s1", target["b"], None, 1, 0)], TABLES["translations"]),
        synonyms=spark.createDataFrame([("s2", target["c"], None, 1, 0)], TABLES["synonyms"]),
    )
    plan = spark.createDataFrame([("en", "p1"), ("fr", "p2"), ("de", "p2")], "language string, pack_id string")
    tables = layout.repartition_by_language(corpus, plan)
    assert all(r["closed"] for r in layout.closure_report(tables).collect())
    assert {(r["pack_id"], r["term"], r["sense_count"]) for r in tables["target_catalogue"].collect()} == {
        ("p1", "b", 1), ("p1", "d", 0), ("p2", "a", 1)}
    assert all(r["divergent"] == 0 and r["checked"] > 0 for r in quality.differential_summary(
        quality.differential_check(corpus, tables, plan, words=10)).collect())
    broken = {**tables, "target_catalogue": tables["target_catalogue"].filter("term <> 'b'")}
    assert {r["pack_id"]: r["dangling"] for r in layout.closure_report(broken).collect()} == {"p1": 1, "p2": 0}
    wrong = {**tables, "relations": tables["relations"].filter("relation_code <> 12")}
    assert sum(r["divergent"] for r in quality.differential_summary(quality.differential_check(corpus, wrong, plan, words=10)).collect()) > 0
    layout.write_partitions(tables, str(tmp_path / "out"), rows_per_file=2)
    again = spark.read.parquet(str(tmp_path / "out" / "relations"))
    assert again.count() == tables["relations"].count()


def test_sources_are_verified_and_schema_checked(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    profile = quality.source_profile(rows, "x", F.col("t"), F.col("t").isNull())
    other = quality.source_profile(rows.repartition(3).orderBy(F.desc("t")), "x", F.col("t"), F.col("t").isNull())
    assert profile.collect() == other.collect() and profile.collect()[0]["row_count"] == 2
    assert quality.verify_sources(profile, other).count() == 0
    assert quality.verify_sources(profile, other.withColumn("row_count", F.lit(5).cast("bigint"))).count() == 1
    floors = quality.floors_table(spark, {"s": {"m": 3, "n": 1}})
    report = quality.floor_report(spark.createDataFrame([("s", "m", 3)], "stage string, metric string, observed bigint"), floors)
    assert {(r["metric"], r["observed"], r["passed"]) for r in report.collect()} == {("m", 3, True), ("n", -1, False)}
    with pytest.raises(ValueError):
        assert_schema(rows, "terms")


def test_plans_prune_before_the_shuffle(spark):
    """Rankings cut hot groups map-side, and nothing is a Cartesian product."""
    corpus = graph_corpus(spark, [("en:a", None, 3, "en:b", None, 1, 1)])
    asked = spark.createDataFrame([(1, "a", "hypernym")], "request_id int, word string, relation string")
    plan = graph.relations(corpus, asked)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    spoken = spoken_corpus(spark, {"light": ["L AY1 T"]})
    words = spark.createDataFrame([(1, "l*")], "request_id int, text string")
    for frame in (wordplay.near_rhymes(spoken, words), wordplay.spelled_like(spoken, words)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_front_door_rejects_and_answers(spark):
    from glossweave.operators.front import OPERATORS, ask

    corpus = graph_corpus(spark, [("en:a", None, 3, "en:b", None, 1, 1)])
    asked = spark.createDataFrame(
        [(1, " A ", "hypernym", "en"), (2, "a", "synonym", "en"), (3, "a", "hypernym", "fr"), (4, "", "hypernym", "en")],
        "request_id int, word string, relation string, language string",
    )
    in_place = spark.createDataFrame([("lexical", "en", "installed"), ("lexical", "fr", "language_not_installed")],
                                     "capability string, language string, reason string")
    rows, rejects = ask("relations", corpus, asked, in_place)
    assert [(r["request_id"], r["target_term"]) for r in rows.collect()] == [(1, "b")]
    assert {r["request_id"]: r["reason"] for r in rejects.collect()} == {
        2: "relation is not supported", 3: "language: language_not_installed", 4: "word cannot be empty"}
    spoken = spoken_corpus(spark, WORDS)
    modes = spark.createDataFrame([(1, "prefix", "le"), (2, "rhyme", "light"), (3, "other", "x")], "request_id int, mode string, text string")
    rows, rejects = ask("search", spoken, modes)
    assert {(r["request_id"], r["mode"], r["normalized_term"]) for r in rows.collect()} == {
        (1, "prefix", "leap"), (1, "prefix", "level"), (2, "rhyme", "right"), (2, "rhyme", "write")}
    assert [r["request_id"] for r in rejects.collect()] == [3]
    contexts = spark.createDataFrame([(1, "right", "c" * 513)], "request_id int, text string, context string")
    assert ask("puns", spoken, contexts, spoken_provenance=9)[1].count() == 1
    assert set(OPERATORS) >= {"lookup", "synonyms", "translate", "neighbours", "spoonerisms", "anagrams"}


def test_percentile_of_a_value_that_most_rows_share(spark):
    values = [7.0] * 900 + [float(k) for k in range(100)]
    rows = [("a", v) for v in values] + [("b", 1.0), (None, 2.0), (None, 3.0)]
    frame = spark.createDataFrame(rows, "k string, v double")
    found = {(r["k"], r["quantile"]): (r["n"], r["v"]) for r in
             nearest_rank(frame, "k", "v", [0.05, 0.5, 0.99]).withColumnRenamed("value", "v").collect()}
    ordered = sorted(values)
    for q in (0.05, 0.5, 0.99):
        assert found["a", q] == (1000, ordered[max(1, int(np.ceil(1000 * q))) - 1])
        assert found["b", q] == (1, 1.0)
    assert found[None, 0.99] == (2, 3.0)


def test_limits_past_the_bound_are_refused(spark):
    corpus, _ = vector_corpus(spark, n=30)
    asked = spark.createDataFrame([("1", "w20", "l2", 101)], "request_id string, word string, source_language string, limit int")
    with pytest.raises(Exception, match="limit must be between"):
        vectors.neighbours(corpus, asked).collect()


def test_prefetch_sees_variants_past_the_scan_ceiling(spark):
    """660 variants of one target: the sensed ones come last by variant rank but first in the prefetch."""
    edges = [("en:a", "sa", 3, "en:b", "s560", 1, 1)]
    edges += [("en:b", f"s{k:03d}", 3, "en:t", None, 1, 1) for k in range(560)]
    edges += [("en:b", f"s{k:03d}", 3, "en:t", f"t{k}", 1, 1) for k in range(560, 660)]
    corpus = graph_corpus(spark, edges)
    asked = spark.createDataFrame([("q", "a", "hypernym")], "request_id string, word string, relation string")
    found = graph.relations(corpus, asked).filter("distance = 2").collect()
    assert [(r["middle_term"], r["target_term"]) for r in found] == [("b", "t")]


def test_a_synset_of_150_members_is_kept_whole(spark):
    rows = [("big", f"s{k}", k, "n") for k in range(150)] + [("one", "alone", 7, "n")]
    members = spark.createDataFrame(rows, "synset_id string, sense_id string, term_id long, part_of_speech string")
    assert graph.synset_places(members).count() == 151
    counts = {r["sense_id"]: r["synonyms"] for r in graph.synonym_counts(members).collect()}
    assert counts == {f"s{k}": 149 for k in range(150)} | {"alone": 0}
    read = graph.synset_synonyms(members).filter("sense_id = 's120'").orderBy("position").collect()
    assert [r["target_term_id"] for r in read] == [k for k in range(150) if k != 120]


def test_request_for_one_sense_meets_that_sense_only(spark):
    """The sense is a key of the join: a word's senses are not paired with all requests for the word."""
    n = 40
    corpus = Corpus(
        terms=spark.createDataFrame([(1, "ring", "ring", "en")], "term_id long, term string, normalized_term string, language string"),
        entries=spark.createDataFrame([("e", 1, "noun", None, 1)], "entry_id string, term_id long, part_of_speech string, etymology string, provenance_id int"),
        senses=spark.createDataFrame([(f"s{i}", "e", "g") for i in range(n)], "sense_id string, entry_id string, gloss string"),
    )
    asked = spark.createDataFrame(
        [(f"r{i}", "ring", "en", f"s{i}", "noun" if i % 2 else None) for i in range(n)] + [("open", "ring", "en", None, None)],
        "request_id string, word string, language string, sense_id string, part_of_speech string",
    )
    found = lookup.sense_candidates(corpus, asked, F.lit(100))
    got = {}
    for r in found.collect():
        got.setdefault(r["request_id"], []).append((r["sense_rank"], r["sense_id"]))
    assert {got[f"r{i}"][0] for i in range(n)} == {(1, f"s{i}") for i in range(n)} and len(got["open"]) == n
    assert sum(map(len, got.values())) == 2 * n
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "OR (sense_id" not in plan


def test_approximate_neighbours_visit_the_nearest_cells_only(spark, monkeypatch):
    """Cells as bits, blocks of several cells, and cells cut over blocks, against plain scoring."""
    monkeypatch.setattr(vectors, "STORED_BLOCK", 16)
    draw = np.random.default_rng(5)
    rows = [(i, f"/c/x/{i}", i, [float(x) for x in draw.normal(size=6)]) for i in range(90)]
    rows += [(90 + i, f"/c/x/{90 + i}", i, [float(x) for x in draw.normal(size=6)]) for i in range(10)]
    stored = spark.createDataFrame(rows, "semantic_id long, concept string, term_id long, embedding array<float>")
    terms = spark.createDataFrame(
        [(i, f"t{i}", f"t{i}", "ab"[i % 2]) for i in range(90)], "term_id long, term string, normalized_term string, language string"
    )
    corpus = Corpus(terms=terms, vectors=stored)
    units = np.array([np.float32(r[3]) for r in rows], np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    centres = vectors.pick_centroids(vectors.named_vectors(corpus), 10, 17)
    near = np.argsort(-(units @ centres.T), axis=1, kind="stable")
    bits = vectors.visited_cells(stored, centres, 3).select("semantic_id", "visited").collect()
    for r in bits:
        told = np.flatnonzero(np.unpackbits(np.frombuffer(r["visited"], np.uint8)))
        assert sorted(near[r["semantic_id"]][:3]) == list(told)
    asked = spark.createDataFrame(
        [(i, f"t{i}", "ab"[i % 2], ["a", None][i % 3 == 0], 7) for i in range(90)],
        "request_id long, word string, source_language string, target_language string, limit int",
    )
    got = {}
    for r in vectors.approximate_neighbours(corpus, asked, 0.3, already_distinct=True).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append(r["semantic_id"])
    for i in range(90):
        best = {}
        for j, (_, _, term, _) in enumerate(rows):
            if term != i and near[j][0] in near[i][:3] and (i % 3 == 0 or term % 2 == 0):
                best[term] = max(best.get(term, (-2, 0)), (round(float(units[i] @ units[j]), 12), -j))
        wanted = [-j for _, j in sorted(best.values(), key=lambda b: (-b[0], -b[1]))[:7]]
        assert got.get(i, []) == wanted, i


def test_synonyms_of_memberships_are_not_paired(spark):
    """Synsets hold their terms once; senses of one word or another read them there, and take turns as before."""
    rng = random.Random(8)
    names = [(k, w, w.lower(), "en") for k, w in enumerate(w for i in range(60) for w in (f"w{i}", f"W{i}"))]
    senses = [(f"s{':unsensed:' if n % 5 == 0 else ''}{n}", f"e{rng.randrange(len(names))}", "g" if n % 3 else None) for n in range(300)]
    members = spark.createDataFrame(
        [(f"y{rng.choice([0, 0, 1, 2])}", s, int(e[1:]), "n", 2) for s, e, _ in senses],
        "synset_id string, sense_id string, term_id long, part_of_speech string, provenance_id int",
    )
    whole = Corpus(
        provenance=spark.createDataFrame([(2, "p", "l", None)], TABLES["provenance"]), terms=spark.createDataFrame(names, TABLES["terms"]),
        entries=spark.createDataFrame([(f"e{k}", k, "noun", None, 2) for k, *_ in names], TABLES["entries"]),
        senses=spark.createDataFrame(senses, TABLES["senses"]),
        relations=spark.createDataFrame([(k, None, 1, k + 7, None, 3, 2) for k in range(0, 100, 3)], TABLES["relations"]),
        synonyms=graph.synset_synonyms(members).withColumn("provenance_id", F.lit(2)),
    )
    whole = whole.extended(term_counts=layout.term_counts(whole))
    held = whole.without("synonyms").extended(synset_members=members, synset_places=graph.synset_places(members))
    word = {f"e{k}": n for k, _, n, _ in names}
    asked = spark.createDataFrame(
        [(s, word[e], s, rng.choice([1, 20, 100])) for s, e, _ in senses] + [(f"all {n}", n, None, rng.choice([3, 20, 100])) for n in set(word.values())],
        "request_id string, word string, sense_id string, limit int",
    )
    columns = ["request_id", "group_index", "position", "sense_id", "sense_scope", "gloss", "term", "provenance_id"]
    plain, found = (sorted(map(repr, lookup.synonyms(c, asked).select(*columns).collect())) for c in (whole, held))
    assert found == plain and len(found) > 2_000
    # the links of one sense, in order: the first terms of its synset by id, one per normalised form
    synset = {r["sense_id"]: r["synset_id"] for r in members.collect()}
    ids = {y: sorted({r["term_id"] for r in members.collect() if r["synset_id"] == y}) for y in set(synset.values())}
    sense, entry, _ = senses[1]
    others = [names[k] for k in ids[synset[sense]] if k != int(entry[1:])][:100]
    firsts = {n: t for _, t, n, _ in reversed(others) if n != word[entry]}
    order = list(dict.fromkeys(n for _, _, n, _ in others if n != word[entry]))
    limit = asked.filter(F.col("request_id") == sense).first()["limit"]
    got = lookup.synonyms(held, asked.filter(F.col("request_id") == sense)).orderBy("position").collect()
    assert [r["term"] for r in got] == [firsts[n] for n in order][:limit]
