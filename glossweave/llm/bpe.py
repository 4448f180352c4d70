"""Byte-pair encoding and decoding in batched numpy merge rounds.

The distinct words of a batch stand in one flat array of symbols. Each round looks up all
neighbouring pairs by binary search over the sorted pair keys, finds every word's lowest
rank and merges its pairs of that rank, left to right; words without a known pair leave.
A table of words seen before (bounded, per worker) spares their rounds.

How a text falls into words is worked out on whole arrays of code points. The classes of
characters (letter, number, space, other) and their lower case are asked of the tokenizers
library once per character, so they are the library's own. Rows with a character whose
treatment depends on its neighbours (combining marks, composing letters) or with a special
token are split by the library itself; their words still pass through the merge rounds.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import arrow_map, code_points, gather, range_hashes, row_slices, text_bytes

_SPACE, _LETTER, _NUMBER, _OTHER, _UNSURE = 1, 2, 3, 4, 5
_NONE = np.int64(1 << 40)
_LONG_WORD = 64


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class WordTable:
    """Open-addressed table from word hashes to token ids, probed for whole arrays at once."""

    def __init__(self, bits: int = 21):
        self.size = 1 << bits
        self.limit = self.size // 3
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.size, np.uint64)
        self.entry = np.full(self.size, -1, np.int32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        place = (hashes & np.uint64(self.size - 1)).astype(np.int64)
        found = self.entry[place]
        open_ = np.flatnonzero((found >= 0) & (self.keys[place] != hashes))
        while open_.size:
            place[open_] = (place[open_] + 1) & (self.size - 1)
            found[open_] = self.entry[place[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[place[open_]] != hashes[open_])]
        return found

    def add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Distinct hashes that are not in the table, with their ids one after the other."""
        base = len(self.lengths)
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.ids = np.concatenate((self.ids, ids))
        place = (hashes & np.uint64(self.size - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while left.size:
            free = self.entry[place[left]] < 0
            candidates = left[free]
            _, one = np.unique(place[candidates], return_index=True)
            won = candidates[one]
            self.entry[place[won]] = base + won
            self.keys[place[won]] = hashes[won]
            lost = np.ones(len(hashes), bool)
            lost[won] = False
            left = left[lost[left]]
            place[left] = (place[left] + 1) & (self.size - 1)


class Bpe:
    """Encoder and decoder of one vocabulary file.

    Two kinds are known: byte-level with spaces kept in front of words, and lower-cased
    words with word ends and white space dropped.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.drops_space = described["normalizer"] is not None
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        vocab, letters = model["vocab"], byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.pair_ids = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.kinds = np.zeros(0x110000, np.uint8)
        self.lowered = np.arange(0x110000, dtype=np.uint32)
        self.words = WordTable()
        byte_of = {c: b for b, c in enumerate(letters)}
        tokens = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()} | {
            i: t.encode() for t, i in self.special.items()
        }
        count = max(tokens) + 1
        spelled = [tokens.get(i, b"") for i in range(count)]
        self.token_lengths = np.array([len(x) for x in spelled], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(spelled), np.uint8)

    # ------------------------------------------------------------------ characters
    def _kind(self, point: int) -> tuple[int, int]:
        """Class and lower case of a character, as the library treats it."""
        letter = chr(point)
        jamo = 0x1100 <= point <= 0x11FF or 0xA960 <= point <= 0xA97F or 0xD7B0 <= point <= 0xD7FF
        if 0xD800 <= point < 0xE000 or unicodedata.category(letter)[0] == "M" or jamo:
            return (_UNSURE if self.drops_space else self._split_kind(letter)), point
        if not self.drops_space:
            return self._split_kind(letter), point
        framed = self.library.normalizer.normalize_str(f"a{letter}a")
        if len(framed) != 3 or not unicodedata.is_normalized("NFC", letter):
            return _UNSURE, point
        if framed[1] == " ":
            return _SPACE, point
        return self._split_kind(framed[1]), ord(framed[1])

    def _split_kind(self, letter: str) -> int:
        """The class, from where the library cuts small probes around the character."""

        def cut(text: str) -> list[tuple[int, int]]:
            return [place for _, place in self.library.pre_tokenizer.pre_tokenize_str(text)]

        if 0xD800 <= ord(letter) < 0xE000:
            return _OTHER
        if cut(f"a{letter}a") == [(0, 3)]:
            return _LETTER
        if cut(f".{letter}.") == [(0, 3)]:
            return _OTHER
        if self.drops_space:
            return _NUMBER if cut(letter) else _SPACE
        return _NUMBER if cut(f"1{letter}") == [(0, 2)] else _SPACE

    def kinds_of(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if (kinds == 0).any():
            for point in np.unique(points[kinds == 0]).tolist():
                self.kinds[point], self.lowered[point] = self._kind(point)
            kinds = self.kinds[points]
        return kinds

    # ----------------------------------------------------------------------- words
    def _split(self, points: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of the rows start and end."""
        size = len(points)
        space = kinds == _SPACE
        before = np.concatenate(([0], kinds[:-1]))
        rows = bounds[:-1][bounds[:-1] < bounds[1:]]
        row_start = np.zeros(size + 1, bool)
        row_start[rows] = True
        row_start[size] = True
        row_end = row_start[1:]
        row_start = row_start[:-1]
        before[row_start] = 0
        blank = points == 32
        if self.drops_space:
            start = ~space & ((kinds != before) | (kinds == _NUMBER))
            joined = np.zeros(size, bool)
        else:
            joined = np.concatenate(([False], blank[:-1])) & ~row_start  # a blank right before belongs to the word
            last = space & ~row_end & np.concatenate((~space[1:], [False]))
            start = np.where(space, (before != _SPACE) | last, (kinds != before) & ~joined)
        start |= row_start if not self.drops_space else row_start & ~space
        self._contractions(points, kinds, before, row_start, joined, start)
        if not self.drops_space:
            starts = np.flatnonzero(start)
            return starts, np.append(starts[1:], size)
        edge = start | space
        places = np.flatnonzero(edge)
        ends = np.append(places[1:], size)
        keep = start[places]
        starts, ends = places[keep], ends[keep]
        return starts, ends

    @staticmethod
    def _contractions(points, kinds, before, row_start, joined, start) -> None:
        """'s 't 're 've 'm 'll 'd stand alone where a word could begin with the apostrophe."""
        marks = np.flatnonzero((points == 39) & (before != _OTHER) & ~joined)
        if not marks.size:
            return
        size = len(points)
        row = np.cumsum(row_start)
        at = lambda k: np.where((marks + k < size) & (row[np.minimum(marks + k, size - 1)] == row[marks]), points[np.minimum(marks + k, size - 1)], 0)
        one, two = at(1), at(2)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for chosen, length in ((marks[single], 2), (marks[double], 3)):
            start[chosen] = True
            start[chosen + 1] = False
            after = chosen + length
            after = after[after < size]
            after = after[(kinds[after] == _LETTER) & ~row_start[after]]
            start[after] = True

    def _merge(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the given words, and how many each has."""
        lengths = ends - starts
        picked = points[gather(starts, lengths)]
        wide = 1 + (picked >= 0x80).astype(np.int64) + (picked >= 0x800) + (picked >= 0x10000)
        raw = np.frombuffer(picked.astype("<u4").tobytes().decode("utf-32-le", "replace").encode(), np.uint8)
        word_end = np.cumsum(wide)[np.cumsum(lengths) - 1]
        symbols = self.inner[raw]
        symbols[word_end - 1] = self.last[raw[word_end - 1]]
        word = np.repeat(np.arange(len(starts)), np.diff(word_end, prepend=0))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while symbols.size:
            key = np.empty(len(symbols), np.int64)
            key[:-1] = symbols[:-1] << 32 | symbols[1:]
            key[-1] = -1
            key[:-1][word[:-1] != word[1:]] = -1
            where = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[where] == key, self.pair_ranks[where], _NONE)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(first, len(word)))
            best = np.minimum.reduceat(rank, first)
            over = np.repeat(best == _NONE, sizes)
            if over.any():
                done.append((word[over], symbols[over]))
            chosen = np.flatnonzero(~over & (rank == np.repeat(best, sizes)))
            if not chosen.size:
                break
            # of pairs that overlap (aaa), every second one counted from the left
            run = np.concatenate(([True], np.diff(chosen) != 1))
            nth = np.arange(len(chosen)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            chosen = chosen[nth % 2 == 0]
            symbols[chosen] = self.pair_ids[where[chosen]]
            stays = ~over
            stays[chosen + 1] = False
            symbols, word = symbols[stays], word[stays]
        words = np.concatenate([w for w, _ in done]) if done else np.empty(0, np.int64)
        ids = np.concatenate([s for _, s in done]) if done else np.empty(0, np.int64)
        order = np.argsort(words, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(words, minlength=len(starts))

    def _ids_of_words(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and the number of ids of each word."""
        hashes = range_hashes(points, starts, ends)
        for k in np.flatnonzero(ends - starts > _LONG_WORD):  # a short hash of sums is not trusted with these
            digest = hashlib.blake2b(points[starts[k] : ends[k]].tobytes(), digest_size=8).digest()
            hashes[k] = np.uint64(int.from_bytes(digest, "little"))
        table = self.words
        if len(table.lengths) + len(starts) > table.limit:
            new = np.unique(hashes[table.find(hashes) < 0]).size
            if len(table.lengths) + new > table.limit:
                self.words = table = WordTable(max(21, int(new * 3).bit_length()))
        entry = table.find(hashes)
        missing = np.flatnonzero(entry < 0)
        if missing.size:
            distinct, where = np.unique(hashes[missing], return_index=True)
            chosen = missing[where]
            table.add(distinct, *self._merge(points, starts[chosen], ends[chosen]))
            entry = table.find(hashes)
        counts = table.lengths[entry]
        return table.ids[gather(table.starts[entry], counts)], counts

    # ---------------------------------------------------------------------- texts
    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Blocks of rows: first row, last row, ids of these rows, where each row's ids start."""
        raw, offsets = text_bytes(column)
        for first, last in row_slices(offsets):
            own = raw[offsets[first] : offsets[last]]
            points, bounds = code_points(own, offsets[first : last + 1] - offsets[first])
            yield (first, last, *self._encode(points, bounds))

    def _encode(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(bounds) - 1
        kinds = self.kinds_of(points)
        unsure = np.zeros(rows, bool)
        odd = np.flatnonzero(kinds == _UNSURE)
        unsure[np.searchsorted(bounds, odd, side="right") - 1] = True
        angle = np.flatnonzero((points[:-1] == ord("<")) & (points[1:] == ord("|")))
        for row in np.unique(np.searchsorted(bounds, angle, side="right") - 1):
            text = _text(points[bounds[row] : bounds[row + 1]])
            unsure[row] |= any(t in text for t in self.special)
        lowered = self.lowered[points] if self.drops_space else points
        if not unsure.any():
            starts, ends = self._split(lowered, kinds, bounds)
            ids, counts = self._ids_of_words(lowered, starts, ends)
            sums = np.concatenate(([0], np.cumsum(counts)))
            return ids, sums[np.searchsorted(starts, bounds)]
        parts = []
        for row in range(rows):
            a, b = bounds[row], bounds[row + 1]
            if unsure[row]:
                parts.append(self._encode_split(_text(points[a:b])))
            else:
                starts, ends = self._split(lowered[a:b], kinds[a:b], np.array([0, b - a]))
                parts.append(self._ids_of_words(lowered[a:b], starts, ends)[0])
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _encode_split(self, text: str) -> np.ndarray:
        """Ids of a text that the library splits: special tokens first, then its words."""
        parts, at = [], 0
        while at <= len(text):
            hits = [(k, -len(t), t) for t in self.special if (k := text.find(t, at)) >= 0]
            stop, _, token = min(hits, default=(len(text), 0, ""))
            piece = text[at:stop]
            if piece:
                if self.library.normalizer:
                    piece = self.library.normalizer.normalize_str(piece)
                spelled = [word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]
                parts.append(self._merge_spelled(spelled))
            if not token:
                break
            parts.append(np.array([self.special[token]], np.uint32))
            at = stop + len(token)
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def _merge_spelled(self, words: list[str]) -> np.ndarray:
        """Ids of words given in byte letters."""
        if not words:
            return np.empty(0, np.uint32)
        byte_of = _byte_of()
        raw = b"".join(bytes(byte_of[c] for c in word) for word in words)
        ends = np.cumsum([len(word) for word in words])
        points, first = code_points(np.frombuffer(raw, np.uint8), np.concatenate(([0], ends)))
        return self._merge(points, first[:-1], first[1:])[0]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows one after the other, and where each row starts."""
        lengths = self.token_lengths[ids]
        sums = np.concatenate(([0], np.cumsum(lengths)))
        return self.token_bytes[gather(self.token_starts[ids], lengths)], sums[bounds]


def _text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "replace")


@cache
def _byte_of() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_letters())}


@cache
def bpe(path: str) -> Bpe:
    """One encoder per worker process and vocabulary file."""
    return Bpe(path)


def _passed(schema: T.StructType, *dropped: str) -> list[str]:
    return [f.name for f in schema.fields if f.name not in dropped]


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a binary column ``ids`` (little-endian unsigned 32-bit) in place of the text.

    Null text counts as empty and gives no ids. Columns other than the text pass through; a
    column already named ``ids`` is replaced. Every row is worked on alone, so repeated rows
    and ties need no rule.
    """
    kept = _passed(docs.schema, text, ids)
    schema = T.StructType([docs.schema[k] for k in kept] + [T.StructField(ids, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            for first, last, flat, bounds in model.encode(batch.column(batch.schema.get_field_index("text "))):
                flat = np.ascontiguousarray(flat, "<u4")
                own = pa.Array.from_buffers(
                    pa.binary(), last - first,
                    [None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())],
                )
                columns = [batch.column(k).slice(first, last - first) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, own], names=[*kept, ids])

    # the name with a blank cannot clash with a column that passes through
    chosen = docs.select(*[docs[f"`{k}`"] for k in kept], docs[f"`{text}`"].cast("string").alias("text "))
    return chosen.transform(arrow_map, run, schema)


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with a column of decoded bytes added; null ids give empty bytes.

    The bytes of a text that was valid UTF-8 are that text again.
    """
    kept = _passed(encoded.schema, text)
    schema = T.StructType([encoded.schema[k] for k in kept] + [T.StructField(text, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(batch.schema.get_field_index(ids)))
            for first, last in row_slices(offsets):
                flat = np.frombuffer(raw[offsets[first] : offsets[last]].tobytes(), "<u4")
                spelled, starts = model.decode(flat, (offsets[first : last + 1] - offsets[first]) // 4)
                own = pa.Array.from_buffers(
                    pa.binary(), last - first,
                    [None, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(spelled.tobytes())],
                )
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, own], names=[*kept, text])

    return encoded.select(*[encoded[f"`{k}`"] for k in kept]).transform(arrow_map, run, schema)
