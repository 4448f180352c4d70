"""License scans: MinHash bands over overlapping text windows, then exact containment.

A template of n shingles is looked for with windows of about n shingles that overlap so far
that one of them holds the whole passage. A window and a template meet if they share the
least hash of one band; the number of bands makes a meeting all but certain for a passage
that holds the wanted share of the template. What meets is verified on the shingles
themselves: a span is reported if it holds enough of the template's distinct shingles.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import arrow_map, mixed, range_hashes, row_slices, shingle_hashes, text_bytes

WORDS = 5
CONTAINED = 0.8
CERTAINTY = 0.9999
#: The templates travel with the task code, so their number is bounded.
MOST_TEMPLATES = 10_000
_MOST = np.uint64((1 << 64) - 1)

# fixed values: short notices as their licenses give them
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR"
        " CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT": "Released under the MIT License",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
        " and/or sell copies of the Software"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation, either version 3 of the License,"
        " or (at your option) any later version"
    ),
    "LGPL-2.1": "licensed under the GNU Lesser General Public License, version 2.1",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
#: Notices of fewer words than a shingle; one counts as one shingle of all its words.
SHORT_TEMPLATES = {"All-rights-reserved": "All rights reserved"}
_GNU_HEADER = (
    "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}"
    " Public License as published by the Free Software Foundation, either version {} of the License,"
    " or (at your option) any later version"
)
#: Licenses and versions that differ from those above in a word or two.
SIBLING_TEMPLATES = {
    "GPL-1.0": "licensed under the GNU General Public License, version 1",
    "GPL-2.0": "licensed under the GNU General Public License, version 2",
    "LGPL-2.0": "licensed under the GNU Library General Public License, version 2",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "GPL-1.0-or-later": _GNU_HEADER.format("program", "General", "1"),
    "GPL-2.0-or-later": _GNU_HEADER.format("program", "General", "2"),
    "LGPL-2.0-or-later": _GNU_HEADER.format("library", "Library General", "2"),
    "LGPL-2.1-or-later": _GNU_HEADER.format("library", "Lesser General", "2.1"),
    "LGPL-3.0-or-later": _GNU_HEADER.format("program", "Lesser General", "3"),
    "AGPL-3.0-or-later": _GNU_HEADER.format("program", "Affero General", "3"),
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    "Apache-1.1": "Licensed under the Apache License, Version 1.1",
    "CC-BY-3.0": "licensed under a Creative Commons Attribution 3.0 Unported License",
    "CC-BY-SA-3.0": "licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License",
    "CC-BY-NC-3.0": "Licensed under CC BY-NC 3.0",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0",
}

#: Parts of full texts that are also copied alone.
FULL_TEXT_TEMPLATES = {
    "MIT-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial"
        " portions of the Software"
    ),
    "MIT-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT"
        " LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"
    ),
    "BSD-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED"
        " WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A"
        " PARTICULAR PURPOSE ARE DISCLAIMED"
    ),
    "BSD-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or"
        " promote products derived from this software without specific prior written permission"
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors"
        " be held liable for any damages arising from the use of this software"
    ),
    "GPL-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
        " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
    ),
    "EPL-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
}
# fixed values: usual spellings of licenses' names; {} stands for the version
_NAMES = {
    "MIT": (("MIT License", "MIT Licence", "MIT X11 License", "Expat License"), ()),
    "ISC": (("ISC License",), ()),
    "Zlib": (("zlib License",), ()),
    "Unlicense": (("The Unlicense", "Unlicense License"), ()),
    "BSD-2-Clause": (("BSD 2-Clause", "2-Clause BSD", "Simplified BSD License"), ()),
    "BSD-3-Clause": (("BSD 3-Clause", "3-Clause BSD", "New BSD License", "Modified BSD License"), ()),
    "Apache": (("Apache License {}", "Apache Software License {}", "Apache {} License"), ("1.0", "1.1", "2.0")),
    "GPL": (("GNU General Public License {}", "GNU GPL {}", "GPL {}"), ("1.0", "2.0", "3.0")),
    "LGPL": (
        ("GNU Lesser General Public License {}", "GNU Library General Public License {}", "GNU LGPL {}", "LGPL {}"),
        ("2.0", "2.1", "3.0"),
    ),
    "AGPL": (("GNU Affero General Public License {}", "GNU AGPL {}", "AGPL {}"), ("3.0",)),
    "MPL": (("Mozilla Public License {}", "MPL {}"), ("1.0", "1.1", "2.0")),
    "EPL": (("Eclipse Public License {}", "EPL {}"), ("1.0", "2.0")),
    "BSL": (("Boost Software License {}",), ("1.0",)),
    "Artistic": (("Artistic License {}",), ("1.0", "2.0")),
    "CC0": (("CC0 {}", "CC0 {} Universal", "Creative Commons Zero {}"), ("1.0",)),
}
_CREATIVE_COMMONS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
_CC_KINDS = ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
_CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
_NAME = "-name"


def license_names() -> dict[str, list[str]]:
    """Spellings of each license's name: every form with every way to write its version.

    A version is written bare, after 'version' or after 'v', joined to it or not, and a
    trailing '.0' may be left out. Ids are those of the licenses with ``-name`` behind.
    """
    forms = dict(_NAMES)
    for kind in _CC_KINDS:
        spelled = "-".join(_CREATIVE_COMMONS[part] for part in kind.split("-"))
        forms[f"CC-{kind}"] = ((f"CC {kind} {{}}", f"Creative Commons {spelled} {{}}", f"Creative Commons {kind} {{}}"), _CC_VERSIONS)
    names: dict[str, list[str]] = {}
    for license_, (spellings, versions) in forms.items():
        for version in versions or ("",):
            numbers = dict.fromkeys((version, version.removesuffix(".0")))
            written = [style.format(n) for n in numbers for style in ("{}", "version {}", "v{}", "v {}")] if version else [""]
            key = f"{license_}-{version}{_NAME}" if version else license_ + _NAME
            names[key] = [form.format(w) for form in spellings for w in written]
            if version and license_.isupper():  # GPLv3
                names[key] += [f"{license_}v{n}" for n in numbers]
    return names


# fixed values: what tells licenses of nearly the same words apart
_FAMILIES = tuple(
    f"{name} license".split()
    for name in (
        "gnu general public", "gnu lesser general public", "gnu affero general public", "gnu library general public",
        "mozilla public", "eclipse public", "apache", "mit",
    )
)
_VERSIONED = frozenset(
    "version versions v license licence attribution sharealike noncommercial noderivatives by nc sa nd".split()
)
_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def _word_bytes() -> np.ndarray:
    inside = np.zeros(256, bool)
    inside[128:] = True
    for c in "0123456789abcdefghijklmnopqrstuvwxyz":
        inside[ord(c)] = True
    return inside


_INSIDE = _word_bytes()


def word_spans(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows: first row, word hashes, word starts and ends in bytes of the block, and of
    each row its first byte and its first word.

    Words are runs of letters and digits after lower-casing; every character outside ASCII
    counts as a letter.
    """
    raw, offsets = text_bytes(pc.ascii_lower(column))
    for first, last in row_slices(offsets):
        own, bounds = raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        inside = np.concatenate(([False], _INSIDE[own], [False]))
        edge = inside[1:] != inside[:-1]
        edge[bounds] |= inside[1:][bounds] & inside[:-1][bounds]
        starts, ends = np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])
        yield first, range_hashes(own, starts, ends), starts, ends, bounds, np.searchsorted(starts, bounds)


def window_plan(shingles: int, contained: float = CONTAINED, certainty: float = CERTAINTY) -> tuple[int, int, int]:
    """(window, stride, bands) for templates of up to ``shingles`` shingles and at least half as many.

    A passage of n shingles lies whole in some window of n + stride - 1. The least Jaccard of
    such a window with a template it holds ``contained`` of follows, and with it the bands
    of one row each that miss it with at most 1 - ``certainty``.
    """
    stride = max(1, shingles // 4)
    window = shingles + stride - 1
    least = max(1, shingles // 2 + 1) if shingles > 1 else 1
    similar = contained * least / (window + least - contained * least) if shingles > 1 else 1.0
    bands = 1 if similar >= 1 else math.ceil(math.log(1 - certainty) / math.log1p(-similar))
    return window, stride, bands


@dataclass
class _Class:
    window: int
    stride: int
    least: np.ndarray  # templates by bands: the least hash of each band
    multipliers: np.ndarray
    names: list[str]
    sets: list[np.ndarray]
    words: int  # of a shingle
    marks: list[list[np.ndarray]]  # of each template: shingles of which one must be there


def _words(text: str) -> np.ndarray:
    _, hashes, *_ = next(word_spans(pa.array([text])))
    if not len(hashes):
        raise ValueError("a template needs words")
    return hashes


def _shingles(text: str, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(_words(text), words))


def _marks(text: str, words: int) -> list[np.ndarray]:
    """For the license's name and for its version: the shingles that hold it, of which a span needs one."""
    grams, spelled = shingle_hashes(_words(text), words), _WORD.findall(pc.ascii_lower(pa.scalar(text)).as_py())
    places: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for k in range(len(spelled)):
        for family in _FAMILIES:
            if spelled[k : k + len(family)] == family:
                places.setdefault(tuple(family), []).append((k, k + len(family)))
        if spelled[k] in _VERSIONED:
            stop = k + 1
            while stop < len(spelled) and spelled[stop].isdecimal():
                stop += 1
            if stop > k + 1:
                places.setdefault(tuple(spelled[k + 1 : stop]), []).append((k, stop))
    marks = []
    for spans in places.values():
        held = {i for start, stop in spans for i in range(max(stop - words, 0), start + 1) if i < len(grams)}
        if held:
            marks.append(grams[sorted(held)])
        else:  # longer than a shingle: each of its shingles
            marks += [grams[i : i + 1] for i in range(spans[0][0], spans[0][1] - words + 1)]
    return marks


def template_classes(
    templates: dict[str, str], words: int = WORDS, names: dict[str, list[str]] | None = None
) -> list[_Class]:
    """Templates grouped by length to powers of two, with their bands.

    A template of fewer than ``words`` words is one shingle of all of them, as is every
    spelling of ``names``.
    """
    spelled = [(name, text) for name, texts in (names or {}).items() for text in texts]
    if len(templates) + len(spelled) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    by: dict[tuple[int, int], list[tuple[str, np.ndarray, list[np.ndarray]]]] = {}
    sized = [(name, text, min(words, len(_words(text)))) for name, text in templates.items()]
    for name, text, own in sized + [(name, text, len(_words(text))) for name, text in spelled]:
        grams = _shingles(text, own)
        by.setdefault((1 << (len(grams) - 1).bit_length(), own), []).append((name, grams, _marks(text, own)))
    classes = []
    for (size, own), members in sorted(by.items()):
        window, stride, bands = window_plan(size)
        multipliers = mixed(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        least = np.array([[(m * grams).min() for m in multipliers] for _, grams, _ in members], np.uint64)
        labels, sets, marks = (list(part) for part in zip(*members, strict=True))
        classes.append(_Class(window, stride, least, multipliers, labels, sets, own, marks))
    return classes


def _sliding_least(values: np.ndarray, window: int) -> np.ndarray:
    """Least value of each run of ``window`` values (shorter at the end), by doubling."""
    out, span = values, 1
    while span < window:
        step = min(span, window - span)
        shifted = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        out = np.concatenate((shifted, out[len(shifted) :]))
        span += step
    return out


def _candidates(group: _Class, grams: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """(template, window start) pairs that share the least hash of a band; windows lie a stride apart."""
    found = []
    for band, multiplier in enumerate(group.multipliers):
        least = _sliding_least(np.where(valid, grams * multiplier, _MOST), group.window)[:: group.stride]
        order = np.argsort(group.least[:, band])
        wanted = group.least[order, band]
        low, high = np.searchsorted(wanted, least, side="left"), np.searchsorted(wanted, least, side="right")
        for k in np.flatnonzero(high > low):  # templates may share a least hash
            found += [(int(t), int(k) * group.stride) for t in order[low[k] : high[k]]]
    return np.unique(np.array(found, np.int64).reshape(-1, 2), axis=0)


def _rival(a: np.ndarray, b: np.ndarray, contained: float) -> bool:
    """Whether a text of one template may be taken for the other; a notice within a longer one is none."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    low, high = common / max(len(a), len(b)), common / min(len(a), len(b))
    return low >= contained or contained <= high < 1


def _best(found: list[tuple], contained: float) -> list[tuple]:
    """``found`` without what is there only because a rival that overlaps it is.

    A find goes if the rival is contained better and no more than half of the shingles that
    only the lesser one has are in its span.
    """
    found, gone = sorted(found, key=lambda f: (f[0], f[2], f[1])), set()
    for k, one in enumerate(found):
        for j in range(k + 1, len(found)):
            other = found[j]
            if other[0] != one[0] or other[2] > one[3]:
                break
            if one[4] == other[4] or one[1] == other[1] or not _rival(one[5], other[5], contained):
                continue
            (low, lesser), (_, better) = sorted(((k, one), (j, other)), key=lambda f: f[1][4])
            apart = np.setdiff1d(lesser[5], better[5])
            if 2 * np.isin(apart, lesser[6]).sum() <= len(apart):
                gone.add(low)
    return [f[:5] for k, f in enumerate(found) if k not in gone]


def _uncovered(found: list[tuple]) -> list[tuple]:
    """``found`` without names that a notice or a longer name of the same family covers."""
    kept, reach = [], {}
    for one in sorted(found, key=lambda f: (f[0], f[2], -f[3], f[1].endswith(_NAME), f[1])):
        family = one[0], one[1].split("-")[0]
        if not one[1].endswith(_NAME) or one[3] > reach.get(family, -1):
            kept.append(one)
            reach[family] = max(one[3], reach.get(family, -1))
    return kept


def find_licenses(
    hashes: np.ndarray, bounds: np.ndarray, classes: list[_Class], contained: float = CONTAINED
) -> list[tuple[int, str, int, int, float]]:
    """(row, name, first word, last word, share of the template) of the spans in a block of texts.

    ``bounds`` says at which word each row starts; shingles that cross it belong to no row.
    Windows of one template that overlap or touch within a row are one span; a span reaches
    from the first to the last of the template's shingles in it. It must hold the license's name
    and version as the template gives them, and of rivals the best one is reported.
    """
    found, shingled = [], {}
    for words in {group.words for group in classes}:
        grams = shingle_hashes(hashes, words)
        row = np.searchsorted(bounds, np.arange(len(grams)), side="right") - 1
        ends = np.maximum(bounds[1:] - words + 1, bounds[:-1])
        shingled[words] = grams, row, ends, np.arange(len(grams)) < ends[row]
    for group in classes:
        grams, row, ends, valid = shingled[group.words]
        spans: list[list[int]] = []  # template, row, start, stop
        parts = []
        for template, start in _candidates(group, grams, valid).tolist():
            stop = min(start + group.window, len(grams))
            for own in range(int(row[start]), int(row[stop - 1]) + 1):
                parts.append((template, own, max(start, int(bounds[own])), min(stop, int(ends[own]))))
        for template, own, start, stop in sorted(p for p in parts if p[2] < p[3]):
            if spans and spans[-1][:2] == [template, own] and start <= spans[-1][3]:
                spans[-1][3] = max(stop, spans[-1][3])
            else:
                spans.append([template, own, start, stop])
        for template, own, start, stop in spans:
            wanted = group.sets[template]
            inside = np.flatnonzero(np.isin(grams[start:stop], wanted))
            share = len(np.unique(grams[start:stop][inside])) / len(wanted)
            marks = group.marks[template]
            if share >= contained and all(np.isin(mark, grams[start:stop]).any() for mark in marks):
                last = start + int(inside[-1]) + group.words - 1
                found.append((own, group.names[template], start + int(inside[0]), last, share, wanted, grams[start:stop]))
    return _uncovered(_best(found, contained))


_SPANS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("license", T.StringType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("end", T.LongType(), False),
        T.StructField("containment", T.DoubleType(), False),
    ]
)


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    words: int = WORDS,
    names: dict[str, list[str]] | None = None,
) -> DataFrame:
    """doc_id, license, start, end, containment of every license passage in ``docs(doc_id, text)``.

    ``start`` and ``end`` are bytes of the UTF-8 text, end exclusive. Null and empty texts have
    none. Rows are scanned each by itself, so repeated rows give repeated spans; other columns
    are ignored. Without ``templates`` the usual notices and names are looked for; ``names``
    are spellings that must stand word by word, reported where no notice covers them.
    """
    if templates is None:
        templates = TEMPLATES | SHORT_TEMPLATES | SIBLING_TEMPLATES | FULL_TEXT_TEMPLATES
        names = license_names() if names is None else names
    classes = template_classes(templates, words, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, starts, ends, bytes_at, split in word_spans(batch.column(1)):
                found = find_licenses(hashes, split, classes)
                if not found:
                    continue
                row, name, i, j, share = (np.array(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(first + row)), pa.array(name.tolist(), pa.string()),
                        pa.array(starts[i] - bytes_at[row]), pa.array(ends[j] - bytes_at[row]), pa.array(share),
                    ],
                    names=_SPANS.names,
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(arrow_map, run, _SPANS)
