"""License scans with a positional index of rare tokens.

Templates are licence texts, whole, in part, and one-line notices. A first pass counts in how many documents each of their words occurs,
over all documents, and the rarer words, with their positions, form the index. For each file all
its indexed words are looked up; each posting votes for one alignment of one template with the
file; alignments that enough rare words agree on are compared word by word, and a label is given if the
weight that agrees is large and the template's mandatory phrases stand in the file.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, record, texts_of, values_of
from .decontam import words_of


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]
    words: list[bytes] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "words", words_of(self.text.encode()))


#: Phrases whose every place counts, with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GPL = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GPL_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {} along with this"

#: Whole texts of the short licences, the notices of the long ones, their opening or defining
#: passages by themselves, and the usual one-line notices.
TEMPLATES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY, ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("apache license version 2 0",)),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", ("apache license version 2 0",)),
    Template("apache", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    Template("gpl", "This program is free software: " + _GPL.format("General Public License", "3") + " This program " + _GPL_WARRANTY.format("General Public License", "General Public License") + " program.", ("gnu general public license",)),
    Template("gpl", "This program is free software; " + _GPL.format("General Public License", "2"), ("gnu general public license",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license",)),
    Template("lgpl", "This library is free software; " + _GPL.format("Lesser General Public License", "2.1") + " This library " + _GPL_WARRANTY.format("Lesser General Public License", "Lesser General Public License") + " library", ("gnu lesser general public license",)),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("agpl", "This program is free software: " + _GPL.format("Affero General Public License", "3"), ("gnu affero general public license",)),
    Template("bsd", f"{_BSD} {_BSD_WARRANTY}", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    Template("bsd", f"{_BSD} {_BSD_NAMES} {_BSD_WARRANTY}", ("redistribution and use in source and binary forms", "neither the name of")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd", "Released under the BSD 3-Clause License.", ("bsd 3 clause license",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", ("for any purpose with or without fee",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ("permission is granted to anyone to use this software for any purpose",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("mozilla public license",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative commons attribution sharealike",)),
    Template("cc-by", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("unencumbered software released into the public domain",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered software released into the public domain",)),
    Template("proprietary", "All rights reserved. No part of this publication may be reproduced without prior written permission.", ("all rights reserved",)),
]


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the templates occurs, and the number of documents. What comes
    to the driver is one number for each of the templates' words."""
    out = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        seen, total = Counter(), 0
        for batch in batches:
            for text in texts_of(batch):
                total += 1
                seen.update(vocabulary.intersection(words_of(text)))
        yield record(out, [*seen, b""], [*seen.values(), total])

    found = {bytes(r.word): r.n for r in map_text(docs.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop(b"", 0)


class RareTokenIndex:
    def __init__(self, templates: list[Template], df: dict[bytes, int], total: int, min_idf: float):
        self.templates = templates
        self.idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) for t in templates for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.rare_in: list[int] = []
        for n, t in enumerate(templates):
            rare = [(i, w) for i, w in enumerate(t.words) if self.idf[w] >= min_idf]
            self.rare_in.append(len({w for _, w in rare}))
            for i, w in rare:
                self.postings[w].append((n, i))
        self.weight = [sum(self.idf[w] for w in t.words) for t in templates]
        self.phrases = [[words_of(p.encode()) for p in t.phrases] for t in templates]

    def scan(self, words: list[bytes], min_share: float) -> tuple[set[str], float]:
        """The labels whose templates stand in the file, and the largest share of a template's weight
        that an alignment agrees with."""
        if self.postings.keys().isdisjoint(words):
            return set(), 0.0
        places = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.postings:
                places[w].append(i)
        votes: Counter = Counter()
        for w in places:
            for n, at in self.postings[w]:
                votes.update((n, p - at) for p in places[w])
        labels, score = set(), 0.0
        for (n, shift), count in votes.items():
            if count < min(2, self.rare_in[n]):
                continue
            t = self.templates[n]
            agreed = sum(self.idf[w] for i, w in enumerate(t.words) if 0 <= shift + i < len(words) and words[shift + i] == w)
            share = agreed / self.weight[n] if self.weight[n] > 0 else 0.0
            score = max(score, share)
            if share >= min_share and t.label not in labels and all(places_of(words, p) for p in self.phrases[n]):
                labels.add(t.label)
        return labels, min(1.0, score)


def places_of(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand consecutively, ascending."""
    found, at, last = [], -1, len(phrase) - 1
    while True:
        try:
            at = words.index(phrase[last], at + 1)
        except ValueError:
            return found
        if at >= last and words[at - last : at] == phrase[:last]:
            found.append(at - last)


def license_scan(docs: DataFrame, templates: list[Template] | None = None, min_idf: float = 0.7, min_share: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Words are runs of letters, digits and non-ASCII characters after A-Z are lower-cased. Base places
    are counted all; labels are distinct, sorted, comma-joined, the method's added to the base ones.
    ``min_idf``: words in more documents than that are not indexed. Null and empty texts have no words, no labels and score 0; an empty table
    gives no rows. Columns other than doc_id and text are not read.
    """
    templates = templates or TEMPLATES
    df, total = document_frequencies(docs, {w for t in templates for w in t.words})
    index = RareTokenIndex(templates, df, total, min_idf)
    base = [(words_of(p.encode()), label) for p, label in BASE_PHRASES.items()]
    text, number = pa.string(), pa.int64()
    out = pa.schema([("doc_id", number), ("n_words", number), ("n_base", number), ("first_word", number), ("last_word", number), ("base_labels", text), ("labels", text), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, raw in zip(values_of(batch, "doc_id"), texts_of(batch)):
                words = words_of(raw)
                places, own = [], set()
                for phrase, label in base:
                    if found := places_of(words, phrase):
                        places += found
                        own.add(label)
                more, score = index.scan(words, min_share)
                rows.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(own | more)), score))
            if rows:
                yield record(out, *zip(*rows))

    return map_text(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
