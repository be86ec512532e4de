"""License scans by conditional compression.

The words around each cue of licensing make candidate blocks. A license is found by its exact differences in wording: the words
that name it must all stand in a stretch of the block, and of the template's words at most a share may be missing or
changed there. Each such stretch is compressed alone and with the template as a zstandard raw dictionary; of
templates of one license that match the same words, the one by which the stretch becomes smallest is reported. Nothing is dropped for its
gain. Short wordings are refused where their sentence denies them or names another license among its words.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices

#: Between two words of a cue may stand whatever is no word: line ends, marks of comments.
_CUE = re.compile("licen[cs]e|copyright|permission is|permission to|redistribution and use|public domain|cc0|cc by|creative commons|free software".replace(" ", "[^a-zA-Z0-9]+"), re.I)
_END = re.compile(r"[.!?;:](?:\s|\Z)")
_WORDS = re.compile(r"[a-zA-Z]+[0-9]*|[0-9]+(?:\.[0-9]+)?")
#: Words of a block at most.
BLOCK_WORDS = 1024
MAX_CHANGED = 0.35
#: Wordings of so many words at most are refused where their sentence denies them, or names another license among its words.
SHORT = 20
_DENIALS = frozenset("not never no isn aren wasn cannot neither nor without unlike except".split())
#: Words that name a license and stand in no other's wording by chance.
_NAMES = frozenset("mit apache bsd gpl lgpl agpl mpl affero lesser mozilla eclipse cc0 nc nd sa noncommercial noderivatives noderivs sharealike commercial derivs derivatives".split())


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text)]


# Wordings of well-known licenses and notices, with the words that tell each from the others. Of licenses that run to pages,
# the title and the first words.
_AS_IS = "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
_TWO_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NO_ENDORSEMENT = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_WORDINGS: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "apache 2.0 january 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "permission hereby granted free of charge sublicense", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("BSL-1.0", "permission hereby granted free charge object code executable derivative", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'),
    ("ISC", "permission purpose fee hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "altered misrepresented origin plainly", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSD-2-Clause", "redistribution source binary forms permitted", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "redistribution source binary forms permitted retain reproduce", _TWO_CLAUSES),
    ("BSD-3-Clause", "redistribution source binary forms permitted retain reproduce neither endorse", f"{_TWO_CLAUSES} 3. {_NO_ENDORSEMENT}"),
    ("BSD-4-Clause", "redistribution source binary forms permitted retain reproduce neither endorse advertising acknowledgement", f"{_TWO_CLAUSES} 3. {_ADVERTISING} 4. {_NO_ENDORSEMENT}"),
    ("BSD-2-Clause", "bsd 2 clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "bsd 3 clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "gnu general public 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "gnu general public 2", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "gnu affero general public 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "gnu lesser general public 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "gnu lesser general public 2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("GPL-3.0", "gnu general public 3 29 june 2007", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("GPL-2.0", "gnu general public 2 june 1991", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_VERBATIM}"),
    ("AGPL-3.0", "gnu affero general public 3 19 november 2007", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("LGPL-3.0", "gnu lesser general public 3 29 june 2007", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("LGPL-2.1", "gnu lesser general public 2.1 february 1999", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. {_VERBATIM}"),
    ("MPL-2.0", "mozilla public 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "mozilla public 2.0 definitions", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("EPL-2.0", "eclipse public 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("CC0-1.0", "cc0 1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC0-1.0", "cc0 1.0 universal", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Unlicense", "unencumbered public domain", "This is free and unencumbered software released into the public domain."),
)
# Built by rule: the notices of the GNU licenses, the Creative Commons licenses, and identifiers.
_GNU = (("GPL-3.0", "", "3"), ("GPL-2.0", "", "2"), ("AGPL-3.0", "Affero ", "3"), ("LGPL-3.0", "Lesser ", "3"), ("LGPL-2.1", "Lesser ", "2.1"))
_GNU_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, "
_CC_PARTS = {"NC": ("NonCommercial", "Non-Commercial"), "ND": ("NoDerivatives", "NoDerivs"), "SA": ("ShareAlike", "Share-Alike")}
_CC_KINDS = ("BY", "BY-NC", "BY-ND", "BY-SA", "BY-NC-ND", "BY-NC-SA")
_CC_VERSIONS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}


def _templates() -> tuple[tuple[str, str, str], ...]:
    out = list(_WORDINGS)
    for name, kind, version in _GNU:
        key = f"gnu {kind.lower()}general public {version}"
        out.append((f"{name}-or-later", f"{key} later", _GNU_NOTICE.format(kind=kind) + f"either version {version} of the License, or (at your option) any later version."))
        out.append((f"{name}-only", f"{key} only", f"Licensed under the GNU {kind}General Public License version {version} only."))
        out.append((f"{name}-or-later", f"{key} later", f"Licensed under the GNU {kind}General Public License version {version} or later."))
    for kind in _CC_KINDS:
        for version, port in _CC_VERSIONS.items():
            name, short = f"CC-{kind}-{version}", kind.lower().replace("-", " ")
            out.append((name, f"cc {short} {version}", f"Licensed under CC {kind} {version}."))
            out.append((name, f"cc {short} {version}", f"CC {kind} {version}"))
            for parts in product(*(_CC_PARTS[p] for p in kind.split("-")[1:])):
                titled = "-".join(["Attribution", *parts])
                out.append((name, f"creative commons {titled} {version}", f"This work is licensed under a Creative Commons {titled} {version} {port} License."))
    for name in dict.fromkeys(n for n, _, _ in out):
        out.append((name, f"spdx identifier {name}", f"SPDX-License-Identifier: {name}"))
    return tuple(out)


TEMPLATES = _templates()
#: Licenses that bar commercial use or bind derived works.
RESTRICTED = tuple(sorted({n for n, _, _ in TEMPLATES if n.split("-")[0] in ("GPL", "LGPL", "AGPL", "MPL", "EPL") or {"NC", "SA", "ND"} & set(n.split("-"))}))
#: Words that a confirmed wording takes up at most.
SPAN = max(len(w) + int(MAX_CHANGED * len(w)) for w in (words(t) for _, _, t in TEMPLATES))


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of candidate blocks: the words around each cue that a wording with it can take up, joined where they meet.

    More than ``BLOCK_WORDS`` words give several blocks, which overlap by as many words as a wording can take up.
    """
    if not _CUE.search(text):
        return []
    placed = [m.span() for m in _WORDS.finditer(text)]
    starts, runs = [a for a, _ in placed], []
    for m in _CUE.finditer(text):
        x, y = max(0, bisect_right(starts, m.start()) - 1 - SPAN), min(len(starts), bisect_left(starts, m.end()) + SPAN)
        if runs and x <= runs[-1][1]:
            runs[-1][1] = y
        else:
            runs.append([x, y])
    step = BLOCK_WORDS - SPAN
    return [(starts[i], placed[min(i + BLOCK_WORDS, y) - 1][1]) for x, y in runs for i in range(x, max(x + 1, y - SPAN), step)]


class Scanner:
    def __init__(self, templates=TEMPLATES, level: int = 3):
        import zstandard as z

        options = {"level": level, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.alone = z.ZstdCompressor(**options)
        self.templates = []
        for name, key, wording in templates:
            own = words(wording)
            raw = z.ZstdCompressionDict(" ".join(own).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
            self.templates.append((name, frozenset(words(key)), own, z.ZstdCompressor(dict_data=raw, **options)))
        self.empty = len(self.alone.compress(b""))

    def gain(self, stretch: list[str], template: int) -> tuple[int, float]:
        """Bytes of the stretch's compressed size that go with the template, and their share of it."""
        data = " ".join(stretch).encode()
        alone = len(self.alone.compress(data)) - self.empty
        saved = alone - len(self.templates[template][3].compress(data)) + self.empty
        return saved, saved / max(1, alone)

    def stretches(self, block: list[str], template: int) -> list[tuple[int, int, list[str], list[str]]]:
        """(first, end, template words lacking, words extra) of stretches of the block that hold the wording, apart from each other, best first.

        A stretch has the fewest words lacking and extra together, with every naming word in place.
        """
        _, key, own, _ = self.templates[template]
        most, at, n = int(MAX_CHANGED * len(own)), np.arange(len(block) + 1), len(own)
        number = {w: k for k, w in enumerate(set(own))}
        codes = np.array([number.get(w, -1) for w in block])
        # cost[i, j]: of the first i template words against the best stretch that ends before word j.
        cost = np.zeros((n + 1, len(block) + 1), np.int32)
        for i, w in enumerate(own):
            row = cost[i] + (most + 1 if w in key else 1)
            row[1:] = np.where(codes == number[w], np.minimum(row[1:], cost[i, :-1]), row[1:])
            cost[i + 1] = np.minimum.accumulate(row - at) + at
        out, free = [], np.ones(len(block), bool)
        for end in np.argsort(cost[n], kind="stable").tolist():
            if cost[n, end] > most:
                break
            i, j, lacks, extra = n, end, [], []
            while i:
                if j and block[j - 1] == own[i - 1] and cost[i, j] == cost[i - 1, j - 1]:
                    i, j = i - 1, j - 1
                elif j and cost[i, j] == cost[i, j - 1] + 1:
                    j -= 1
                    extra.append(block[j])
                else:
                    i -= 1
                    lacks.append(own[i])
            if free[j:end].all():
                free[j:end] = False
                out.append((j, end, lacks[::-1], extra[::-1]))
        return out

    def refused(self, text: str, placed: list, block: list[str], x: int, y: int, template: int, extra: list[str]) -> bool:
        """Whether a short wording is denied by its sentence (up to six words before it, or words in it), or another license is named in it."""
        _, _, own, _ = self.templates[template]
        if len(own) > SHORT:
            return False
        if (_NAMES & set(extra)) - set(own) or _DENIALS & set(extra):
            return True
        before = [w for k, w in enumerate(block[max(0, x - 6) : x], max(0, x - 6)) if not _END.search(text, placed[k].end(), placed[x].start())]
        return bool(_DENIALS & set(before))

    def scan(self, text: str) -> list[tuple]:
        """(license, start, end, gain, words lacking, words extra) of stretches with a license's wording; those of one license don't overlap.

        Of two licenses confirmed on overlapping words, the one whose naming words are part of the other's is not meant.
        """
        hits = []
        for a, b in blocks(text):
            placed = list(_WORDS.finditer(text, a, b))
            block = [m[0].lower() for m in placed]
            have = set(block)
            for i, (name, key, _, _) in enumerate(self.templates):
                if key <= have:
                    for x, y, lacks, extra in self.stretches(block, i):
                        if self.refused(text, placed, block, x, y, i, extra):
                            continue
                        saved, share = self.gain(block[x:y], i)
                        hits.append((-saved, i, key, (name, placed[x].start(), placed[y - 1].end(), round(share, 4), lacks, extra)))
        found = []
        for _, _, key, hit in sorted(hits, key=lambda h: h[:2]):
            if not any(hit[0] == o[0] and hit[1] < o[2] and o[1] < hit[2] for _, o in found):
                found.append((key, hit))
        return [h for key, h in found if not any(key < k and h[1] < o[2] and o[1] < h[2] for k, o in found)]


_FOUND = "array<struct<license:string,start:int,end:int,gain:double,lacking:array<string>,extra:array<string>>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_blocks`` (candidates) and ``found`` (confirmed licenses with their place, gain and differences) of each row.

    A null or empty text has no blocks. Repeated rows and null ids are kept; other columns are dropped, whatever their names. An empty
    table gives an empty one. A very long text is read whole, in blocks of ``BLOCK_WORDS`` words that overlap, around each of its cues. Of
    templates of equal gain on the same words the first counts.
    """
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("gain", pa.float64()), ("lacking", pa.list_(pa.string())), ("extra", pa.list_(pa.string()))]))
    names = ("license", "start", "end", "gain", "lacking", "extra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [[dict(zip(names, x)) for x in scanner.scan(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(blocks(t)) for t in texts], pa.int64()), pa.array(found, kind)], ["id", "n_blocks", "found"])

    rows = pick(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    type_ = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {type_}, n_blocks bigint, found {_FOUND}").withColumnRenamed("id", id_col)
