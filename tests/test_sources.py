"""Loaders on small hand-written files."""

from __future__ import annotations

import bz2
import gzip
import json

import pytest

from glossweave.sources.cmudict import build_cmudict
from glossweave.sources.common import id_collisions, merge_terms, refresh_source
from glossweave.sources.conceptnet import build_conceptnet
from glossweave.sources.text import invalid_bytes, positioned, read_lines
from glossweave.sources.vectors import build_vectors
from glossweave.sources.wiktionary import build_wiktionary
from glossweave.sources import wordnet
from glossweave.sources.wordnet import build_wordnet
from glossweave.session import reliable_cut

WORDNET = """<?xml version="1.0" encoding="UTF-8"?>
<LexicalResource xmlns:dc="http://purl.org/dc/elements/1.1/"><Lexicon id="t">
<LexicalEntry id="w-boat"><Lemma writtenForm="boat" partOfSpeech="n"><Pronunciation variety="GB">bəʊt</Pronunciation></Lemma>
  <Sense id="boat-1" synset="ss-1"><SenseRelation relType="derivation" target="sail-1"/></Sense></LexicalEntry>
<LexicalEntry id="w-dinghy"><Lemma writtenForm="dinghy" partOfSpeech="n"/><Sense id="dinghy-1" synset="ss-1"/></LexicalEntry>
<LexicalEntry id="w-craft"><Lemma writtenForm="craft"/><Sense id="craft-1" synset="ss-2"><Definition>own  words</Definition></Sense></LexicalEntry>
<LexicalEntry id="w-sail"><Lemma writtenForm="sail" partOfSpeech="v"/><Sense id="sail-1" synset="ss-3"/></LexicalEntry>
<LexicalEntry id="w-none"><Lemma partOfSpeech="v"/></LexicalEntry>
<Synset id="ss-1" partOfSpeech="n"><Definition>a small
   vessel</Definition><Definition>for water</Definition><SynsetRelation relType="hypernym" target="ss-2"/>
  <SynsetRelation relType="unknown" target="ss-2"/><Example>row the boat</Example><Example dc:source="x">tie it up</Example></Synset>
<Synset id="ss-2" partOfSpeech="n"><Definition>a vessel</Definition></Synset>
<Synset id="ss-3" partOfSpeech="v"><Definition>travel by wind</Definition></Synset>
</Lexicon></LexicalResource>
"""


def counts(built) -> dict[str, int]:
    return {r["metric"]: r["observed"] for r in built.counters.collect()}


def names(built) -> dict[int, str]:
    return {r["term_id"]: r["term"] for r in built.tables["terms"].collect()}


def test_wordnet(spark, tmp_path):
    path = tmp_path / "wn.xml"
    path.write_text(WORDNET, encoding="utf-8")
    built = build_wordnet(spark, str(path))
    term = names(built)
    assert sorted(term.values()) == ["boat", "craft", "dinghy", "sail"]
    gloss = {r["sense_id"]: r["gloss"] for r in built.tables["senses"].collect()}
    assert gloss["wordnet:sense:boat-1"] == "a small vessel; for water"
    assert gloss["wordnet:sense:craft-1"] == "own words"
    examples = {(r["sense_id"], r["position"], r["example"]) for r in built.tables["examples"].collect()}
    assert ("wordnet:sense:dinghy-1", 1, "tie it up") in examples and len(examples) == 4
    synonyms = {(r["sense_id"], term[r["target_term_id"]], r["position"]) for r in built.tables["synonyms"].collect()}
    assert synonyms == {("wordnet:sense:boat-1", "dinghy", 0), ("wordnet:sense:dinghy-1", "boat", 0)}
    edges = {
        (term[r["source_term_id"]], r["relation_code"], term[r["target_term_id"]]) for r in built.tables["relations"].collect()
    }
    assert edges == {("boat", 3, "craft"), ("dinghy", 3, "craft"), ("boat", 7, "sail")}
    sounds = [(r["ipa"], r["region"]) for r in built.tables["pronunciations"].collect()]
    assert sounds == [("bəʊt", "GB")]
    seen = counts(built)
    assert (seen["synsets"], seen["entries"], seen["senses"]) == (3, 4, 4)


def wiktionary_lines() -> list[str]:
    entry = {
        "word": "bank", "lang_code": "en", "pos": "noun", "etymology_texts": ["from x", " ", "from y"],
        "sounds": [{"ipa": "/bæŋk/", "tags": ["US", "UK"]}, {"ipa": "/bæŋk/", "tags": ["US", "UK"]}, {"ipa": "/b/"}, {"audio": "f"}],
        "senses": [
            {"id": "b1", "glosses": ["money house"], "examples": [{"text": " "}, {"text": "a bank"}],
             "synonyms": [{"word": "Bank"}, {"word": "lender"}, {"term": "LENDER"}, {"alt": "vault"}], "antonyms": [{"word": "foe"}, {"word": "Foe"}]},
            {"raw_glosses": ["river side"], "id": ["q", "p"]},
        ],
        "translations": [
            {"word": "Bank", "code": "de", "sense": "money"}, {"word": "banque", "code": "fr", "sense": "money", "pos": "name"},
            {"word": "bank", "code": "de", "sense": "money"}, {"word": "x", "code": "??"}, {"word": "orilla", "code": "es"},
        ],
        "synonyms": [{"word": "shore", "sense": "side"}],
    }
    bare = {"word": "zed", "lang_code": "en"}
    odd = {"word": "odd", "lang_code": "fr", "senses": {"not": "a list"}}
    return [json.dumps(entry), "{broken", "[1]", "", json.dumps({"lang_code": "en"}), json.dumps(bare), json.dumps(odd)]


def test_wiktionary(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(wiktionary_lines()[:5]) + "\n", encoding="utf-8")
    with gzip.open(tmp_path / "b.jsonl.gz", "wt", encoding="utf-8") as out:
        out.write("\n".join(wiktionary_lines()[5:]) + "\n")
    built = build_wiktionary(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl.gz")])
    seen = counts(built)
    assert (seen["entries"], seen["malformed_lines"], seen["missing_word"]) == (3, 2, 1)
    # bank: 2 native + labels money, side + unsensed; zed and odd: one unsensed each
    assert (seen["senses"], seen["labeled_senses"], seen["unsensed_senses"]) == (7, 2, 3)
    assert seen["language_codes"] == 2
    term = names(built)
    sense = {r["sense_id"]: r["gloss"] for r in built.tables["senses"].collect()}
    assert sorted(g for g in sense.values() if g) == ["money", "money house", "river side", "side"]
    moved = [
        (sense[r["sense_id"]], term[r["target_term_id"]], r["part_of_speech"], r["position"])
        for r in built.tables["translations"].collect()
    ]
    assert set(moved) == {
        (None, "orilla", "noun", 0), ("money", "Bank", "noun", 0), ("money", "banque", "name", 1),
    }
    same = {(sense[r["sense_id"]], term[r["target_term_id"]], r["position"]) for r in built.tables["synonyms"].collect()}
    assert same == {("money house", "lender", 0), ("money house", "vault", 1), ("side", "shore", 0)}
    opposed = {(term[r["source_term_id"]], term[r["target_term_id"]], r["direction_code"]) for r in built.tables["relations"].collect()}
    assert opposed == {("bank", "foe", 3)}
    assert [(r["example"], r["position"]) for r in built.tables["examples"].collect()] == [("a bank", 1)]
    sounds = sorted((r["position"], r["ipa"], r["region"]) for r in built.tables["pronunciations"].collect())
    assert sounds == [(0, "/bæŋk/", "US, UK"), (1, "/b/", "")]
    origin = {r["etymology"] for r in built.tables["entries"].collect()}
    assert "from x\n\nfrom y" in origin
    assert all(":unsensed:" in s for s, g in sense.items() if g is None)
    only_english = build_wiktionary(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl.gz")], ["en"])
    assert counts(only_english)["entries"] == 2 and counts(only_english)["translations"] == 0


def test_conceptnet(spark, tmp_path):
    rows = [
        "/a/1\t/r/IsA\t/c/en/guide_dog/n\t/c/en/dog\t{\"weight\": 2.0}",
        "/a/2\t/r/IsA\t/c/en/guide_dog/v\t/c/en/dog\t{\"weight\": 1.0}",
        "/a/3\t/r/PartOf\t/c/fr/caf%C3%A9\t/c/fr/a+b\tnot json",
        "/a/4\t/r/UsedFor\t/c/en/pen\t/c/en/write\t{\"weight\": 0}",
        "/a/5\t/r/Strange\t/c/en/a\t/c/en/b\t{}",
        "/a/6\t/r/SimilarTo\t/c/en/a\t/c/e!/b\t{}",
        "/a/7\t/r/RelatedTo\t/c/en/100%zz\t/c/en/pure",
        "short\trow", "",
    ]
    path = tmp_path / "edges.tsv.bz2"
    path.write_bytes(bz2.compress("\n".join(rows).encode()))
    built = build_conceptnet(spark, str(path))
    assert counts(built) == {"source_assertions": 7, "assertions": 4, "relations": 3, "skipped": 3, "malformed": 1}
    term = names(built)
    edges = {
        (term[r["source_term_id"]], r["relation_code"], term[r["target_term_id"]], r["direction_code"])
        for r in built.tables["relations"].collect()
    }
    assert edges == {("guide dog", 3, "dog", 1), ("café", 6, "a+b", 1), ("100%zz", 12, "pure", 3)}
    assert counts(build_conceptnet(spark, str(path), ["fr"]))["relations"] == 1


def test_vectors(spark, tmp_path):
    rows = ["9 2", "/c/en/two_words 3 4", "/c/fr/%C3%A9t%C3%A9 1 0", "/c/en/two_words 1 1", "/c/en/zero 0 0",
            "/c/en/short 1", "/c/en/nan nan 1", "bad 1 2", "/c/de/x 0 -2", "/c/es/y 1 1"]
    path = tmp_path / "v.txt"
    path.write_text("\n".join(rows) + "\n", encoding="utf-8")
    built = build_vectors(spark, str(path), ["en", "fr", "de"])
    seen = counts(built)
    assert (seen["terms"], seen["malformed"], seen["filtered"], seen["duplicates"], seen["unaccounted"]) == (3, 4, 1, 1, 0)
    got = {r["semantic_id"]: (r["concept"], [round(x, 4) for x in r["embedding"]]) for r in built.tables["vectors"].collect()}
    assert got == {0: ("/c/en/two_words", [0.6, 0.8]), 1: ("/c/fr/%C3%A9t%C3%A9", [1.0, 0.0]), 2: ("/c/de/x", [0.0, -1.0])}
    assert set(names(built).values()) == {"two words", "été", "x"}
    (tmp_path / "bad.txt").write_text("x y\n")
    with pytest.raises(ValueError):
        build_vectors(spark, str(tmp_path / "bad.txt"))


def test_cmudict(spark, tmp_path):
    text = ";;; note\n# note\nread R IY1 D\nREAD(2) R EH1 D\nred r eh1 d\nice_cream AY1 S K R IY1 M\nread R IY1 D\nlonely\n\n"
    path = tmp_path / "cmu.dict.gz"
    path.write_bytes(gzip.compress(text.encode()))
    built = build_cmudict(spark, str(path))
    term = names(built)
    got = {(term[r["term_id"]], r["phonemes"], r["rhyme_key"]) for r in built.tables["spoken"].collect()}
    assert got == {("read", "R IY1 D", "IY1 D"), ("READ", "R EH1 D", "EH1 D"), ("red", "R EH1 D", "EH1 D"),
                   ("ice cream", "AY1 S K R IY1 M", "IY1 M")}
    assert counts(built) == {"entries": 5, "pronunciations": 5, "malformed": 1}
    merged = merge_terms(built.tables["terms"], built.tables["terms"])
    assert merged.count() == 4 and id_collisions(merged).count() == 0


def test_lines_positions_and_damage(spark, tmp_path):
    (tmp_path / "b.txt").write_text("b1\nb2\n")
    (tmp_path / "a.txt").write_bytes(b"a1\na\xff2\na3\n")
    paths = [str(tmp_path / "b.txt"), str(tmp_path / "a.txt")]
    rows = positioned(reliable_cut(read_lines(spark, paths)).filter("line <> 'a3'"))
    got = [r["line"] for r in rows.orderBy("source_position").collect()]
    assert got == ["a1", "a�2", "b1", "b2"]
    damage = {r["file"].rsplit("/", 1)[1]: r["invalid_lines"] for r in invalid_bytes(spark, paths).collect()}
    assert damage == {"a.txt": 1, "b.txt": 0}


def test_refresh_replaces_one_source(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "value string, provenance_id int")
    refresh_source(make([("a", 1), ("b", 2)]), path)
    refresh_source(make([("c", 2), ("d", 2)]), path)
    got = sorted((r["value"], r["provenance_id"]) for r in spark.read.parquet(path).collect())
    assert got == [("a", 1), ("c", 2), ("d", 2)]


def test_profiles_ignore_layout(spark, tmp_path):
    from glossweave.sources import profiles

    def digest(df):
        row = df.collect()[0]
        return row["row_count"], row["malformed"], row["row_digest"]

    (tmp_path / "a.jsonl").write_text('{"b": 1, "a": [1, 2]}\n{"a": {"y": 1, "x": null}}\nbroken\n[1]\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as out:
        out.write('{"a":{"x":null,"y":1}}\n\n[1]\nbroken\n{"a":[1,2],"b":1}\n')
    one = digest(profiles.profile_wiktionary(spark, str(tmp_path / "a.jsonl")))
    assert one == digest(profiles.profile_wiktionary(spark, str(tmp_path / "b.jsonl.gz"))) and one[:2] == (2, 2)
    (tmp_path / "w1.xml").write_text(WORDNET, encoding="utf-8")
    (tmp_path / "w2.xml").write_text(WORDNET.replace("><", ">\n  <").replace('id="w-boat"', 'id = "w-boat"'), encoding="utf-8")
    assert digest(profiles.profile_wordnet(spark, str(tmp_path / "w1.xml"))) == digest(
        profiles.profile_wordnet(spark, str(tmp_path / "w2.xml")))
    (tmp_path / "v.txt").write_text("3 2\n/c/en/a 1 2\n/c/en/b nan 2\n/c/en/c 1\n")
    assert digest(profiles.profile_vectors(spark, str(tmp_path / "v.txt"), 2))[:2] == (1, 2)
    (tmp_path / "c.tsv").write_text("a\tb\tc\td\nx\ty\n\n")
    assert digest(profiles.profile_conceptnet(spark, str(tmp_path / "c.tsv")))[:2] == (1, 1)
    (tmp_path / "d.dict").write_text(";;; c\nword  W  ER1 D\nlonely\n")
    assert digest(profiles.profile_cmudict(spark, str(tmp_path / "d.dict")))[:2] == (1, 1)


def test_member_relations_repeat_no_row_and_are_counted_without_pairing(spark):
    """Members of several synsets and sense links that synset links give too, against plain pairing."""
    members = [("A", "a1", 1), ("A", "a2", 2), ("B", "b1", 3), ("B", "a1", 1), ("C", "c1", 4), ("C", "b1", 3), ("D", "d1", 1)]
    links = [("A", 1, "B"), ("A", 1, "C"), ("B", 1, "C"), ("A", 2, "A"), ("D", 1, "none"), ("none", 1, "D")]
    senses = [(2, "a2", 1, 3, "b1"), (2, "a2", 3, 3, "b1"), (2, "a2", 3, 3, "b1"), (4, "c1", 1, 1, "d1")]
    key = "source_term_id int, source_sense_id string, relation_code int, target_term_id int, target_sense_id string"
    rows, numbers = wordnet.member_relations(
        spark.createDataFrame(links, "synset_id string, relation_code int, target string"),
        spark.createDataFrame(members, "synset_id string, sense_id string, term_id int"),
        spark.createDataFrame(senses, key),
    )
    wanted = set(senses) | {
        (t, s, code, u, v) for a, code, b in links for m, s, t in members if m == a for n, v, u in members if n == b
    }
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    assert sum(r["n"] for r in numbers.collect()) == len(wanted)


def test_lines_of_a_small_file_are_parsed_by_all_cores(spark):
    from glossweave.plans import source_queries

    cores = spark.sparkContext.defaultParallelism
    for lines in (source_queries.dictionary_lines, source_queries.thesaurus_elements):
        assert lines(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= cores


def test_rows_of_member_relations_are_named_without_a_join_by_the_row(spark):
    """Names come along with the ends: no row of the product is shuffled or looked up for its names."""
    from glossweave.plans import source_queries

    members = [("A", "a1", 1, "one"), ("A", "a2", 2, "two"), ("B", "b1", 3, "three"), ("B", "a1", 1, "one"), ("C", "c1", 4, "four")]
    links = [("A", 1, "B"), ("B", 1, "C"), ("A", 2, "A")]
    senses = [(2, "a2", 1, 3, "b1", "two", "three"), (4, "c1", 1, 1, "a1", "four", "one")]
    key = "source_term_id int, source_sense_id string, relation_code int, target_term_id int, target_sense_id string"
    rows, _ = wordnet.member_relations(
        spark.createDataFrame(links, "synset_id string, relation_code int, target string"),
        spark.createDataFrame(members, "synset_id string, sense_id string, term_id int, term string"),
        spark.createDataFrame(senses, f"{key}, source_term string, target_term string"),
    )
    name = {1: "one", 2: "two", 3: "three", 4: "four"}
    got = rows.collect()
    assert len(got) == 4 + 2 + 4 + 1 and ("four", "one") in {(r["source_term"], r["target_term"]) for r in got}
    assert all((r["source_term"], r["target_term"]) == (name[r["source_term_id"]], name[r["target_term_id"]]) for r in got)
    plan = source_queries.loaded_sense_relations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # above the union of the products there is no join
    assert "Join" not in plan[: plan.index("Union")], plan
