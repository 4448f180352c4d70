"""Piece encoding, token alignment and importance resampling against plain Python and the libraries."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from glossweave.llm import alignment, bpe, pieces, resampling

from .conftest import EDGES

TEXTS = [t for _, t in EDGES] + ["▁ a▁b", "  two  blanks ", "a" * 5_000, "中文" * 900, "<s>x</s><0x0A>\0", " " * 400, "ab\ncd"]


@pytest.fixture(scope="module")
def model(vocabulary):
    return pieces.pieces(vocabulary("piece_bpe_32k.model"))


# ---------------------------------------------------------------------- pieces
def _same_as_library(model, texts):
    for first, last, ids, bounds in model.encode(pa.array(texts, pa.string())):
        spelled, starts = model.decode(ids, bounds)
        for k in range(first, last):
            wanted = model.library.encode(texts[k] or "")
            assert ids[bounds[k - first] : bounds[k - first + 1]].tolist() == wanted
            own = spelled[starts[k - first] : starts[k - first + 1]].tobytes().decode()
            assert own == model.library.decode(wanted)


def test_pieces_equal_the_library(model):
    _same_as_library(model, TEXTS)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.text(), st.text("the in▁ \n\tZé1²_.<|>　中Σ́한0")), min_size=1, max_size=6))
    def check(texts):
        _same_as_library(model, texts)

    check()


def test_long_cuts_use_a_heap_and_agree_with_the_flat_agendas(model):
    """Repeated letters and ties of score, in both forms of the agenda."""
    random.seed(3)
    for size in (2, 7, 20, 48):
        for _ in range(40):
            text = "".join(random.choice("abtheing ") for _ in range(size)).replace(" ", "▁")
            symbols = model.symbols[[ord(c) for c in text]]
            flat, _ = model._merge(symbols.copy(), np.array([size]))
            assert flat.tolist() == model._merge_long(symbols.tolist())


def test_full_table_of_cuts_starts_anew(vocabulary):
    model = pieces.Pieces(vocabulary("piece_bpe_32k.model"))
    model.cuts = bpe.WordTable(bits=5)
    _same_as_library(model, [" ".join(f"w{k}{j}" for k in range(60)) for j in range(3)])


def test_encode_and_decode_documents(spark, documents, vocabulary, model):
    path = vocabulary("piece_bpe_32k.model")
    docs = documents(EDGES).withColumnRenamed("length", "ids")  # replaced by the operator's column
    encoded = pieces.encode_documents(docs, path, agrees="agrees")
    rows = pieces.decode_documents(encoded, path, agrees="agrees").collect()
    assert len(rows) == len(EDGES) and all(r["agrees"] for r in rows)
    assert Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in rows) == Counter((i, t or "") for i, t in EDGES)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert ids == model.library.encode(bytes(r["decoded"]).decode())
    digests = {r["ids_sha256"] for r in pieces.id_digests(encoded.select("doc_id", "ids"), model.size).collect()}
    wanted = {hashlib.sha256(",".join(map(str, model.library.encode(t or ""))).encode()).hexdigest() for _, t in EDGES}
    assert digests == wanted
    assert pieces.decode_documents(pieces.encode_documents(documents([]), path), path).collect() == []


def test_disagreement_is_reported(spark, vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    wrong = spark.createDataFrame([(1, np.array([450, 5], "<u4").tobytes(), True), (2, None, False)], "doc_id long, ids binary, agrees boolean")
    rows = {r["doc_id"]: r for r in pieces.decode_documents(wrong, path, agrees="agrees").collect()}
    assert rows[2]["agrees"] is False and bytes(rows[2]["decoded"]) == b""


# ------------------------------------------------------------------- alignment
def test_merge_path_divides_evenly_and_finds_all_common_ends():
    draw = np.random.default_rng(5)
    for _ in range(400):
        a = np.unique(draw.integers(1, 80, draw.integers(0, 50)))
        b = np.unique(draw.integers(1, 80, draw.integers(0, 50)))
        width = int(draw.integers(1, 9))
        at_a, at_b = alignment.common_ends(a, b, width)
        shared = np.intersect1d(a, b)
        assert a[at_a].tolist() == b[at_b].tolist() == shared.tolist()
        if len(a) and len(b):
            from_a, from_b = alignment.merge_path(a, b, width)
            assert (np.diff(from_a + from_b)[:-1] == width).all()
            for i, j in zip(from_a, from_b, strict=True):
                assert (not i or not j) or max(a[i - 1], b[j - 1]) <= min(a[i : i + 1].tolist() + b[j : j + 1].tolist() + [99])


def _align_plainly(texts, vocabulary):
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    byte_of = {c: b for b, c in enumerate(bpe.byte_letters())}
    spelling = {i: bytes(byte_of.get(c, 0) for c in t) for t, i in one.get_vocab().items()}
    rows, counts = [], Counter()
    for text in texts:
        text = text or ""
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        a_bytes = [spelling[i] for i in a]
        b_bytes = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != b"".join(b_bytes) or b"".join(b_bytes) != (" " + text).encode():
            rows.append(None)
            continue
        shared, at_a, at_b = np.intersect1d(np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes]), return_indices=True)
        links = [(a[i], b[j]) for i, j in zip(at_a, at_b, strict=True)]
        counts.update(links)
        cut_a, cut_b = [0, *(at_a + 1)], [0, *(at_b + 1)]
        groups = ";".join(
            ",".join(map(str, a[cut_a[k] : cut_a[k + 1]])) + "|" + ",".join(map(str, b[cut_b[k] : cut_b[k + 1]]))
            for k in range(len(shared))
        )
        rows.append((len(a), len(b), links, groups))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (0, 0, 0, 0, 0, 0, "", "") if r is None else (
            r[0], r[1], len(r[2]), len(r[2]), sum(counts[x] == best[x[1]] for x in r[2]), sum(counts[x] for x in r[2]),
            hashlib.sha256(r[3].encode()).hexdigest(), r[3],
        )
        for r in rows
    ]


def test_alignment(spark, documents, vocabulary, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 500)
    given = EDGES + [(100 + k, t) for k, t in enumerate(TEXTS)] + [(200, "<|endoftext|> is text"), (201, "naïve ﬁne \U0001F600")]
    wanted = Counter((i, *r) for (i, _), r in zip(given, _align_plainly([t for _, t in given], vocabulary), strict=True))
    path_a, path_b = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    got = alignment.align_documents(documents(given).repartition(3), path_a, path_b, with_groups=True)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    assert got.columns == names
    assert Counter(tuple(r) for r in got.collect()) == wanted
    assert sum(r[1] == 0 for r in wanted.elements()) >= 5
    assert alignment.align_documents(documents([]), path_a, path_b).collect() == []


# ------------------------------------------------------------------ resampling
def _words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def _runs(text, shortest, longest):
    words = _words(text)
    return [" ".join(words[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]


def _resample_plainly(rows, target, share, min_words, buckets, shortest, longest, seed=2024):
    own = [[zlib.crc32(f.encode()) % buckets for f in _runs(t, shortest, longest)] for _, t in rows]
    s = Counter(b for bs in own for b in bs)
    t = Counter(zlib.crc32(f.encode()) % buckets for x in target for f in _runs(x, shortest, longest))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    scored = []
    for (i, text), bs in zip(rows, own, strict=True):
        weight = sum(map(gain, bs)) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((i, len(_words(text)), len(bs), weight, score))
    able = sorted((-r[4], 1 << 63 if r[0] is None else r[0]) for r in scored if r[1] >= min_words)
    return scored, able[: len(able) * share[0] // share[1]]


@pytest.mark.parametrize("shortest,longest,buckets", [(1, 1, 50), (1, 2, 10_000), (2, 3, 997)])
def test_resampling(spark, documents, shortest, longest, buckets):
    random.seed(longest)
    some = ["alpha", "BETA", "gämma", "d3lta", "x" * 60, "中文", "it's"]
    rows = EDGES + [(20 + k // 2, " ".join(random.choice(some) for _ in range(random.randint(0, 30)))) for k in range(60)]
    target = ["alpha beta gämma", None, "", "beta beta D3LTA"]
    goal = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    got = resampling.resample(documents(rows), goal, (30, 100), 3, buckets, shortest, longest).collect()
    scored, drawn = _resample_plainly(rows, target, (30, 100), 3, buckets, shortest, longest)
    assert Counter(tuple(r)[:5] for r in got) == Counter(scored)
    ranked = sorted((r["rank"], -r["score"], 1 << 63 if r["doc_id"] is None else r["doc_id"]) for r in got if r["rank"])
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r[1:] for r in ranked] == drawn
    empty = resampling.resample(documents([]), goal)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_one_id_in_a_third_of_all_rows_is_drawn_to_the_row(spark, documents):
    rows = [(7, "same words here")] * 40 + [(100 + k, f"other words {k}") for k in range(80)]
    goal = spark.createDataFrame([("same words",)], "text string")
    got = resampling.resample(documents(rows), goal, (20, 100), 2).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 25))


def test_selection_in_rounds(spark):
    random.seed(9)
    keys = [(random.randint(-5, 5), random.randint(0, 9), k) for k in range(3000)]
    frame = spark.createDataFrame(keys, "k0 long, k1 long, k2 long").repartition(7)
    ordered = sorted(keys)
    for count in (1, 2, 700, 1500, 2999, 3000):
        assert resampling.select_key(frame, count, last_keys=3) == ordered[count - 1]
    assert resampling.select_key(frame, 0) is None
    with pytest.raises(ValueError):
        resampling.select_key(frame, 3001)
