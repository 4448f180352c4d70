"""Encoding and decoding with merge-type piece vocabularies (``.model`` files).

A text is one row of symbols, its characters at first. An agenda holds the adjacent pairs
that spell a piece, ordered by the piece's score and then by place; the top pair is merged,
its neighbours' pairs are looked up anew, and so on until no pair spells a piece.

Pairs of characters that stand side by side in no piece can never be merged across, so the
text is cut there and the agendas of the cuts are independent. The agendas of a batch's
distinct short cuts are kept in flat numpy arrays, one top entry of each popped at a time;
long cuts (no blanks for many characters) use a heap. A bounded table per worker remembers
cuts seen before. Characters that no piece spells become the pieces of their bytes.

Every Arrow batch can be checked against the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .bpe import WordTable
from .common import arrow_map, code_points, gather, range_hashes, row_slices, text_bytes

#: The character that stands for a blank in pieces (fixed by the file format).
BLANK = 0x2581
#: Symbols of a cut from which on its agenda is a heap of its own.
LONG_CUT = 48
_NONE = np.int64(1) << np.int64(60)
_BARE = 1 << 24  # symbols of characters that are no pieces: this plus the code point
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6  # kinds of entries, fixed by the file format


class Pieces:
    """Encoder and decoder of one merge-type vocabulary with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        described = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            described.ParseFromString(file.read())
        rules, training = described.normalizer_spec, described.trainer_spec
        kinds = [p.type for p in described.pieces]
        if training.model_type != 2 or not training.byte_fallback or set(kinds) - {1, 2, 3, 6}:
            raise ValueError("a merge-type vocabulary with byte fallback and without user-defined pieces is needed")
        plain = not rules.precompiled_charsmap and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        if not plain or not rules.add_dummy_prefix:
            raise ValueError("a vocabulary is needed that puts a blank in front and changes no other character")

        texts = [p.piece for p in described.pieces]
        ids = {t: i for i, t in enumerate(texts) if kinds[i] == _NORMAL}
        self.byte_ids = np.zeros(256, np.int64)
        for i, text in enumerate(texts):
            if kinds[i] == _BYTE:
                self.byte_ids[int(text[3:5], 16)] = i

        def symbol(text: str) -> int | None:
            return ids.get(text, _BARE + ord(text) if len(text) == 1 else None)

        # the symbol of every character; characters that stand in longer pieces get a small number
        self.symbols = _BARE + np.arange(0x110000, dtype=np.int64)
        long_pieces = [t for t in ids if len(t) > 1]
        letters = sorted({c for t in long_pieces for c in t})
        self.small = np.zeros(0x110000, np.int32)
        self.small[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        for text, i in ids.items():
            if len(text) == 1:
                self.symbols[ord(text)] = i
        number = {c: k + 1 for k, c in enumerate(letters)}
        self.joins = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        pairs: dict[int, int] = {}
        for text in long_pieces:
            for a, b in zip(text, text[1:]):
                self.joins[number[a], number[b]] = True
            for k in range(1, len(text)):
                left, right = symbol(text[:k]), symbol(text[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = ids[text]
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = keys
        self.pair_ids = np.array([pairs[k] for k in keys.tolist()], np.int64)
        scores = np.array([described.pieces[i].score for i in self.pair_ids.tolist()], np.float32)
        # places in the order of falling scores; equal scores share one
        _, self.pair_places = np.unique(-scores, return_inverse=True)
        self.pair_places = self.pair_places.astype(np.int64)
        self.pair_table = dict(zip(keys.tolist(), zip(self.pair_places.tolist(), self.pair_ids.tolist()), strict=True))
        self.cuts = WordTable()

        spelled = [
            bytes([int(t[3:5], 16)]) if k == _BYTE else t.replace(chr(BLANK), " ").encode() if k == _NORMAL
            else " ⁇ ".encode() if k == _UNKNOWN else b""
            for t, k in zip(texts, kinds, strict=True)
        ]
        self.token_lengths = np.array([len(x) for x in spelled], np.int64)
        self.size = len(spelled)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.leads_blank = np.array([k == _NORMAL and t[0] == chr(BLANK) for t, k in zip(texts, kinds, strict=True)])

    # -------------------------------------------------------------------- agendas
    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the order of scores and id of the piece that two symbols spell."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        known = self.pair_keys[at] == key
        return np.where(known, self.pair_places[at], _NONE), self.pair_ids[at]

    def _merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of each cut when its agenda is empty, and how many there are."""
        cut = np.repeat(np.arange(len(lengths)), lengths)
        place = np.full(len(symbols), _NONE)
        piece = np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(cut[1:] == cut[:-1])
        place[inner], piece[inner] = self._look_up(symbols[inner], symbols[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while symbols.size:
            first = np.flatnonzero(np.concatenate(([True], cut[1:] != cut[:-1])))
            # the top entry of every agenda: best score, then leftmost
            entry = np.where(place == _NONE, _NONE, place << 32 | np.arange(len(place)))
            top = np.minimum.reduceat(entry, first)
            over = top == _NONE
            if over.any():
                gone = np.repeat(over, np.diff(np.append(first, len(cut))))
                done.append((cut[gone], symbols[gone]))
            else:
                gone = np.zeros(len(symbols), bool)
            at = top[~over] & np.int64(0xFFFFFFFF)
            symbols[at] = piece[at]
            gone[at + 1] = True
            shift = np.cumsum(gone)
            stays = ~gone
            at = at - shift[at]
            symbols, cut, place, piece = symbols[stays], cut[stays], place[stays], piece[stays]
            # only the pairs on both sides of a merged symbol are new
            changed = np.unique(np.concatenate((at, at[at > 0] - 1)))
            place[changed] = _NONE
            changed = changed[changed + 1 < len(cut)]
            changed = changed[cut[changed] == cut[changed + 1]]
            place[changed], piece[changed] = self._look_up(symbols[changed], symbols[changed + 1])
        cuts = np.concatenate([c for c, _ in done]) if done else np.empty(0, np.int64)
        left = np.concatenate([s for _, s in done]) if done else np.empty(0, np.int64)
        order = np.argsort(cuts, kind="stable")
        return left[order], np.bincount(cuts, minlength=len(lengths))

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same for one long cut, whose agenda is a heap; out-of-date entries are passed over."""
        size = len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        table, agenda = self.pair_table, []

        def enter(left: int) -> None:
            right = after[left]
            if right < size and (found := table.get(symbols[left] << 32 | symbols[right])):
                agenda.append((found[0], left, symbols[left], symbols[right], found[1]))

        for left in range(size):
            enter(left)
        heapq.heapify(agenda)
        while agenda:
            _, left, one, two, piece = heapq.heappop(agenda)
            right = after[left]
            if symbols[left] != one or right >= size or symbols[right] != two:
                continue
            symbols[left], symbols[right] = piece, -1
            after[left] = after[right]
            if after[left] < size:
                before[after[left]] = left
            known = len(agenda)
            if before[left] >= 0:
                enter(before[left])
            enter(left)
            new = agenda[known:]
            del agenda[known:]
            for entry in new:
                heapq.heappush(agenda, entry)
        return [s for s in symbols if s >= 0]

    def _spelled(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols: characters without a piece become the pieces of their bytes."""
        bare = symbols >= _BARE
        if not bare.any():
            return symbols.astype(np.uint32), counts
        points = np.where(bare, symbols - _BARE, 0)
        wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        raw = points[bare].astype("<u4").tobytes().decode("utf-32-le", "replace").encode()
        ids = np.repeat(symbols, wide)
        ids[np.repeat(bare, wide)] = self.byte_ids[np.frombuffer(raw, np.uint8)]
        sums = np.concatenate(([0], np.cumsum(wide)))
        ends = np.cumsum(counts)
        return ids.astype(np.uint32), sums[ends] - sums[ends - counts]

    # ---------------------------------------------------------------------- texts
    def _ids_of_cuts(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all cuts in order, and the number of ids of each cut."""
        hashes = range_hashes(points, starts, ends)
        for k in np.flatnonzero(ends - starts > LONG_CUT):  # a short hash of sums is not trusted with these
            digest = hashlib.blake2b(points[starts[k] : ends[k]].tobytes(), digest_size=8).digest()
            hashes[k] = np.uint64(int.from_bytes(digest, "little"))
        table = self.cuts
        entry = table.find(hashes)
        missing = np.flatnonzero(entry < 0)
        if missing.size:
            distinct, where = np.unique(hashes[missing], return_index=True)
            if len(table.lengths) + len(distinct) > table.limit:
                self.cuts = table = WordTable(max(21, int(len(starts) * 3).bit_length()))
                distinct, where = np.unique(hashes, return_index=True)
                missing = np.arange(len(starts))
            chosen = missing[where]
            lengths = ends[chosen] - starts[chosen]
            short = lengths <= LONG_CUT
            some = chosen[short]
            symbols = self.symbols[points[gather(starts[some], lengths[short])]]
            table.add(distinct[short], *self._spelled(*self._merge(symbols, lengths[short])))
            for k in np.flatnonzero(~short):
                own = self.symbols[points[starts[chosen[k]] : ends[chosen[k]]]].tolist()
                left = np.array(self._merge_long(own), np.int64)
                table.add(distinct[k : k + 1], *self._spelled(left, np.array([len(left)])))
            entry = table.find(hashes)
        counts = table.lengths[entry]
        return table.ids[gather(table.starts[entry], counts)], counts

    def encode_block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of UTF-8 texts, and where each row's ids start."""
        points, bounds = code_points(raw, offsets)
        filled = np.diff(bounds) > 0
        # a blank goes in front of every text that is not empty
        points = np.insert(points, bounds[:-1][filled], 32).astype(np.uint32)
        bounds = bounds + np.concatenate(([0], np.cumsum(filled)))
        points[points == 32] = BLANK
        if not points.size:
            return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64)
        small = self.small[points]
        start = np.ones(len(points), bool)
        start[1:] = ~self.joins[small[:-1], small[1:]]
        start[bounds[:-1][filled]] = True
        starts = np.flatnonzero(start)
        ids, counts = self._ids_of_cuts(points, starts, np.append(starts[1:], len(points)))
        sums = np.concatenate(([0], np.cumsum(counts)))
        return ids, sums[np.searchsorted(starts, bounds)]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Blocks of rows: first row, last row, ids of these rows, where each row's ids start."""
        raw, offsets = text_bytes(column)
        for first, last in row_slices(offsets):
            own = raw[offsets[first] : offsets[last]]
            yield (first, last, *self.encode_block(own, offsets[first : last + 1] - offsets[first]))

    def token_spelling(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all tokens one after the other."""
        return self.token_bytes[gather(self.token_starts[ids], self.token_lengths[ids])]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows one after the other, and where each row starts.

        The blank that was put in front of a text is taken away again.
        """
        starts, lengths = self.token_starts[ids], self.token_lengths[ids]
        rows = bounds[:-1][bounds[:-1] < bounds[1:]]
        rows = rows[self.leads_blank[ids[rows]]]
        starts[rows] += 1
        lengths[rows] -= 1
        sums = np.concatenate(([0], np.cumsum(lengths)))
        return self.token_bytes[gather(starts, lengths)], sums[bounds]


@cache
def pieces(path: str) -> Pieces:
    """One encoder per worker process and vocabulary file."""
    return Pieces(path)


def binary_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column of the rows that ``bounds`` cut out of ``data``."""
    width = data.dtype.itemsize
    places = pa.py_buffer((bounds * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, places, pa.py_buffer(np.ascontiguousarray(data))])


def _schema(df: DataFrame, *added: T.StructField, dropped: tuple[str, ...] = ()) -> tuple[list[str], T.StructType]:
    gone = {f.name for f in added} | set(dropped)
    kept = [f for f in df.schema.fields if f.name not in gone]
    return [f.name for f in kept], T.StructType([*kept, *added])


def encode_documents(
    docs: DataFrame, path: str, text: str = "text", ids: str = "ids", agrees: str | None = None
) -> DataFrame:
    """``docs`` with a binary column ``ids`` (little-endian unsigned 32-bit) in place of the text.

    No begin or end ids are added; null and empty texts give no ids. Columns other than the
    text pass through; one that has the name of a new column is replaced. Every row is worked
    on alone, so repeated rows and ties need no rule; an empty table gives no rows.

    With a name for ``agrees``, each Arrow batch is also encoded by the library and that
    boolean column says whether the ids are the same.
    """
    added = [T.StructField(ids, T.BinaryType(), False)]
    if agrees:
        added.append(T.StructField(agrees, T.BooleanType(), False))
    kept, schema = _schema(docs, *added, dropped=(text,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = batch.column(len(kept))
            for first, last, flat, bounds in model.encode(texts):
                columns = [batch.column(k).slice(first, last - first) for k in range(len(kept))]
                columns.append(binary_array(flat.astype("<u4", copy=False), bounds))
                if agrees:
                    given = [t or "" for t in texts.slice(first, last - first).to_pylist()]
                    columns.append(pa.array(_same(model.library.encode(given, num_threads=1), flat, bounds)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    # the name with a blank cannot clash with a column that passes through
    chosen = docs.select(*[docs[f"`{k}`"] for k in kept], docs[f"`{text}`"].cast("string").alias("text "))
    return chosen.transform(arrow_map, run, schema)


def _same(listed: list[list[int]], flat: np.ndarray, bounds: np.ndarray) -> list[bool]:
    return [np.array_equal(own, flat[bounds[k] : bounds[k + 1]]) for k, own in enumerate(listed)]


def decode_documents(
    encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded", agrees: str | None = None
) -> DataFrame:
    """``encoded`` with a column of decoded bytes added; null ids give empty bytes.

    The bytes of a text without U+2581 are that text again; that character comes back as a
    blank. ``agrees`` adds the comparison with the library's decoding, as for encoding, and
    holds only where a column of that name, if there is one, held before.
    """
    added = [T.StructField(text, T.BinaryType(), False)]
    if agrees:
        added.append(T.StructField(agrees, T.BooleanType(), False))
    kept, schema = _schema(encoded, *added)
    given = [*kept, agrees] if agrees and agrees in encoded.columns else kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(kept.index(ids)))
            for first, last in row_slices(offsets):
                flat = np.frombuffer(raw[offsets[first] : offsets[last]].tobytes(), "<u4")
                bounds = (offsets[first : last + 1] - offsets[first]) // 4
                spelled, starts = model.decode(flat, bounds)
                part = batch.slice(first, last - first)
                columns = [*part.columns[: len(kept)], binary_array(spelled, starts)]
                if agrees:
                    rows = [flat[bounds[k] : bounds[k + 1]].tolist() for k in range(last - first)]
                    whole = spelled.tobytes()
                    same = [
                        own.encode() == whole[starts[k] : starts[k + 1]]
                        for k, own in enumerate(model.library.decode(rows, num_threads=1) if rows else [])
                    ]
                    if len(given) > len(kept):
                        same = [a and b for a, b in zip(same, part.column(len(kept)).to_pylist(), strict=True)]
                    columns.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return encoded.select(*[encoded[f"`{k}`"] for k in given]).transform(arrow_map, run, schema)


class Decimals:
    """Numbers below a bound written in decimal, whole arrays at a time."""

    def __init__(self, count: int):
        self.widths = np.array([len(str(n)) for n in range(count)], np.int64)
        self.width = int(self.widths.max()) + 1
        rows = b"".join(str(n).encode().ljust(self.width, b"\0") for n in range(count))
        self.rows = np.frombuffer(rows, np.uint8).reshape(count, self.width)

    def joined(self, numbers: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all numbers, each followed by its mark unless that is 0, and where each starts."""
        rows, widths = self.rows[numbers], self.widths[numbers]
        rows[np.arange(len(numbers)), widths] = marks
        used = widths + (marks != 0)
        return rows[np.arange(self.width) < used[:, None]], np.concatenate(([0], np.cumsum(used)))


@cache
def decimals(count: int) -> Decimals:
    return Decimals(count)


def id_digests(encoded: DataFrame, vocabulary: int, ids: str = "ids", digest: str = "ids_sha256") -> DataFrame:
    """``encoded`` with the SHA-256 of each row's decimal ids joined by commas, in place of the ids.

    Null ids count as none.
    """
    kept, schema = _schema(encoded, T.StructField(digest, T.StringType(), False), dropped=(ids,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = decimals(vocabulary)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(len(kept)))
            for first, last in row_slices(offsets):
                flat = np.frombuffer(raw[offsets[first] : offsets[last]].tobytes(), "<u4")
                bounds = (offsets[first : last + 1] - offsets[first]) // 4
                marks = np.full(len(flat), ord(","), np.uint8)
                marks[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = 0
                text, starts = written.joined(flat, marks)
                text, cut = text.tobytes(), starts[bounds].tolist()
                digests = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(cut, cut[1:])]
                columns = [batch.column(k).slice(first, last - first) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], names=schema.names)

    return encoded.select(*[encoded[f"`{k}`"] for k in [*kept, ids]]).transform(arrow_map, run, schema)
