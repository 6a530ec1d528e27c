"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Templates of like length share windows: as long as the longest of them and the distance between two windows, which is a
quarter of the shortest; so an occurrence lies in some window whole. From a template's shingles, the window's and the least
containment follows the least similarity J of the two. A band is the least hash of one order, so a window misses a template in
all bands with probability (1 - J)^bands; there are so many bands that this is under MISS for every template. A window's
least hash can only equal a template's if that very shingle is in the window, so only windows with enough shingles of
templates are hashed.
"""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .decontaminate import tokens

#: Words of a shingle, the least containment of a template in a window, the greatest chance that bands miss such a window.
SHINGLE, LEAST, MISS = 3, 0.8, 1e-6
#: Public wordings: notices by which texts name their license, the beginnings of common ones, and whole texts (a file each).
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "BSD": [  # the opening alone doesn't tell which
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
}

#: Words that must stand in a window too, for the templates of a license that hold them, and words that must not, nor beside it.
DECIDING = {
    "Apache-2.0": ["Apache License, Version 2.0", "under the Apache License"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"],
    "BSD-3-Clause": ["endorse or promote products"],
    "ISC": ["provided that the above"],
    "GFDL-1.2": ["Version 1.2, November 2002"],
    "GFDL-1.3": ["Version 1.3, 3 November 2008"],
    "MPL-1.1": ["Mozilla Public License Version 1.1"],
}
UNLESS = {"BSD-2-Clause": ["endorse or promote products"], "0BSD": ["provided that the above"]}


def _add(name: str, wordings: list[str], deciding: list[str]) -> None:
    known = TEMPLATES.setdefault(name, [])
    known += [w for w in wordings if w not in known]
    DECIDING.setdefault(name, []).extend(deciding)


def _bundle() -> None:
    for kind, full, versions in (("GPL", "GNU General Public License", ("1", "2", "3")), ("LGPL", "GNU Library General Public License", ("2",)), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",))):
        for v in versions:
            wordings = [
                f"This work is licensed under the {full}, version {v}.",
                f"This program is free software: you can redistribute it and/or modify it under the terms of the {full} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.",
                f"This program is free software; you can redistribute it and/or modify it under the terms of the {full} version {v} as published by the Free Software Foundation.",
            ]
            # a later license quotes the names of others, so its title decides on the whole text
            _add(f"{kind}-{v if '.' in v else v + '.0'}", wordings, [full, f"License, version {v}", f"either version {v}", *([f"Version {v}, 29 June 2007"] if v == "3" else [])])
    parts = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
    for short, full in parts.items():
        for v, scope in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
            old = full.replace("NoDerivatives", "NoDerivs") if v != "4.0" else full
            _add(f"CC-{short}-{v}", [f"Licensed under CC {short} {v}.", f"This work is licensed under a Creative Commons {old} {v} {scope} License."], [f"CC {short} {v}", f"Commons {old} {v}"])
    named = {
        "MIT": ["MIT License"], "ISC": ["ISC License"], "Zlib": ["zlib License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "BSL-1.0": ["Boost Software License, Version 1.0"],
        "EPL-1.0": ["Eclipse Public License, Version 1.0", "Eclipse Public License v1.0"], "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License v2.0"],
        "Apache-1.0": ["Apache License, Version 1.0"], "Apache-1.1": ["Apache License, Version 1.1"], "Apache-2.0": ["Apache License, Version 2.0"],
        "MPL-1.1": ["Mozilla Public License, Version 1.1"], "MPL-2.0": ["Mozilla Public License, Version 2.0"], "CC0-1.0": ["CC0 1.0 Universal License"], "Unlicense": ["Unlicense License"],
    }
    for name, full in named.items():
        _add(name, [f"{verb} under the {x}." for x in full for verb in ("Released", "Licensed")], [f"the {x}" for x in full])
    _add("CC0-1.0", ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."], [])
    _add("Unlicense", ["This is free and unencumbered software released into the public domain."], [])
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        _add(path.stem, [path.read_text(encoding="utf-8")], [])


_bundle()


class Templates:
    """Templates with their shingles, least hashes and window classes."""

    def __init__(self, templates: dict[str, list[str]] | None = None, least: float = LEAST):
        rows = [(name, k, text) for name, texts in (templates or TEMPLATES).items() for k, text in enumerate(texts)]
        self.names, self.numbers, self.containment = [r[0] for r in rows], [r[1] for r in rows], least
        words, offs = tokens(pa.array([r[2] for r in rows], pa.large_string()))
        grams, ends = common.shingles(words, offs, SHINGLE)
        self.sizes = np.diff(offs)
        self.sets = [np.unique(grams[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        if any(not len(s) for s in self.sets):
            raise ValueError("a template is shorter than a shingle")
        whole = [w.tobytes() for w in (words[a:b] for a, b in zip(offs[:-1], offs[1:]))]
        self.must = [self.phrases(DECIDING.get(r[0], ()), t) for r, t in zip(rows, whole)]
        self.never = [self.phrases(UNLESS.get(r[0], ()), None) for r in rows]
        self.every = np.unique(np.concatenate([*self.sets, *self.never]))
        # classes of length: the longest of a class is at most a quarter longer than its shortest
        self.classes: list[tuple[list[int], int, int]] = []
        left = sorted(range(len(rows)), key=lambda k: self.sizes[k])
        alike = 1.0
        while left:
            short = int(self.sizes[left[0]])
            own = [k for k in left if self.sizes[k] * 4 <= short * 5]
            left = left[len(own) :]
            stride = max(1, short // 4)
            width = int(self.sizes[own[-1]]) + stride
            self.classes.append((own, width, stride))
            for k in own:
                n = len(self.sets[k])
                both = math.ceil(least * n)
                alike = min(alike, both / (width - SHINGLE + 1 + n - both))
        self.shingles = [np.unique(np.concatenate([self.sets[k] for k in own])) for own, _, _ in self.classes]
        self.bands = 1 if alike >= 1 else math.ceil(math.log(MISS) / math.log(1 - alike))
        self.least = np.stack([self.signature(s) for s in self.sets])

    @staticmethod
    def phrases(phrases, held: bytes | None) -> np.ndarray:
        """Shingles of the phrases; with `held`, of those that these words hold."""
        out = [np.zeros(0, np.uint64)]
        for p in phrases:
            words, offs = tokens(pa.array([p], pa.large_string()))
            if held is None or words.tobytes() in held:
                out.append(common.shingles(words, offs, SHINGLE)[0])
        return np.unique(np.concatenate(out))

    def signature(self, grams: np.ndarray) -> np.ndarray:
        return np.array([self.ordered(grams, b).min() for b in range(self.bands)], np.uint64)

    @staticmethod
    def ordered(grams: np.ndarray, band: int) -> np.ndarray:
        return common.mix(grams ^ common.mix(np.array([band + 1], np.uint64)))


def find(texts: pa.Array, templates: Templates, bands: bool = True) -> list[tuple[int, int, float, int, int]]:
    """(row, template, containment, first word, words) of each occurrence of a template, from its first to its last shingle there.

    Of windows that overlap by over half a template's words the one with the greatest containment counts, then the first.
    Without bands every window is compared with every template of its class.
    """
    words, offs = tokens(texts)
    grams, ends = common.shingles(words, offs, SHINGLE)
    any_hit = np.flatnonzero(np.isin(grams, templates.every))
    seen: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
    for (own, width, stride), known in zip(templates.classes, templates.shingles):
        span = width - SHINGLE + 1  # shingles of a window
        hit = any_hit[np.isin(grams[any_hit], known)]
        row = np.searchsorted(ends, hit, "right") - 1
        place = hit - ends[row]
        # windows that hold the shingle begin at multiples of stride
        last = place // stride
        first = np.maximum(-(-(place - span + 1) // stride), 0)
        n = last - first + 1
        start = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        windows, held_by = np.unique(np.stack([np.repeat(row, n), start * stride]), axis=1, return_counts=True) if len(start) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        fewest = templates.containment * min(len(templates.sets[t]) for t in own)
        for r, at in windows[:, held_by >= fewest].T.tolist():  # others have too few shingles of the class
            lo, hi = ends[r] + at, min(ends[r] + at + span, ends[r + 1])
            a, b = np.searchsorted(hit, (lo, hi))
            some = grams[hit[a:b]]
            near = np.ones(len(own), bool)
            if bands:
                held = grams[lo:hi]
                least = np.array([templates.ordered(held, b).min() for b in range(templates.bands)], np.uint64)
                near = (least == templates.least[own]).any(axis=1)
            for t in np.array(own)[near].tolist():
                score = float(np.isin(templates.sets[t], some).mean())
                if score >= templates.containment and np.isin(templates.must[t], some).all() and not (len(templates.never[t]) and np.isin(templates.never[t], grams[max(lo - span, ends[r]) : min(hi + span, ends[r + 1])]).all()):
                    at_ = hit[a:b][np.isin(some, templates.sets[t])] - ends[r]
                    seen.setdefault((r, t), []).append((score, int(at_[0]), int(at_[-1]) + SHINGLE))
    out = []
    for (r, t), found in sorted(seen.items()):
        kept: list[tuple[int, int]] = []
        for score, begin, end in sorted(set(found), key=lambda x: (-x[0], x[1], x[2])):
            if all(2 * (min(end, e) - max(begin, b)) <= templates.sizes[t] for b, e in kept):
                kept.append((begin, end))
                out.append((r, t, score, begin, end - begin))
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, license, template (its number), containment, first_word and n_words of each occurrence.

    Null and empty texts hold none. Equal rows give equal rows. Of windows with one containment the first counts. Texts
    of any length are scanned whole; other columns are ignored; no rows give no rows.
    """
    known = Templates(templates, least)
    common.tune(docs)

    def run(batches):
        for batch in common.slices(batches, "text"):
            found = find(common.as_text(batch.column("text")), known)
            ids = batch.column("doc_id").cast(pa.int64()).take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([known.names[f[1]] for f in found], pa.string()), pa.array([known.numbers[f[1]] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.float64()), *(pa.array([f[k] for f in found], pa.int64()) for k in (3, 4))],
                ["doc_id", "license", "template", "containment", "first_word", "n_words"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, template int, containment double, first_word long, n_words long")
