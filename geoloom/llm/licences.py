"""Licence scans: known sentences are named, and their sequence is matched against ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and notices, without their copyright lines.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""
#: A GNU notice: what it covers, the mark after "free software", the licence's name, and its versions.
GNU = "This {work} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{version}"
GNU_VERSIONS = {"or-later": ", either version {v} of the License, or (at your option) any later version.", "or-later, parted": "; either version {v} of the License, or (at your option) any later version.", "only": ", version {v}.", "only, of the License": ", version {v} of the License.", "only, parted": "; version {v}."}
GNU_NAMES = [("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3")]
#: Short notices by licence, which may follow other words in their sentence.
NOTICES = {
    "Released under the MIT License": "MIT", "Licensed under the MIT License": "MIT",
    "Licensed under the Apache License, Version 2.0": "Apache-2.0", "Licensed under the Apache License 2.0": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3": "GPL-3.0-only", "This work is licensed under the GNU General Public License, version 2": "GPL-2.0-only",
    "Licensed under CC BY 4.0": "CC-BY-4.0", "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0", "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0", "Licensed under CC BY-ND 4.0": "CC-BY-ND-4.0",
    "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-ND 4.0": "CC-BY-NC-ND-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
    "All rights reserved": "LicenseRef-All-Rights-Reserved",
}
#: The clause of the four-clause text that others lack, and the older wording of the third clause.
BSD_ADVERTISING = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the copyright holder."
BSD_AUTHOR = "3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."
#: Parts of normalised sentences in which names stand, and the words that take the place of any name: (pattern, instead).
SLOTS = [
    (r"^neither the names? of .+ nor the names? of .*contributors may be used to endorse or promote products", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    (r"^(?:the )?names? of .+ may not be used to endorse or promote products", "the name of the author may not be used to endorse or promote products"),
    (r"^this software is provided by .+ as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    (r"^in no event shall .+ be liable for any direct indirect incidental", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental"),
    (r"^this product includes software developed by .+", "this product includes software developed by the copyright holder"),
    (r"^.+ is free software$", "this program is free software"),
]
#: Full stops of these end no sentence: they stand in the names of holders.
_ABBREVIATED = r"\b(Inc|Ltd|Corp|Co|Dr|Mr|Mrs|Ms|St|Univ)\.([ \t\r\n,])"
#: An identifier line, and what parts it from the words around it.
_SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)"
#: What "all rights reserved" means counts only where no licence is found beside it.
RESERVED = "LicenseRef-All-Rights-Reserved"
#: Each known sentence holds one of these runs of letters, which normalising can't cut; other texts are not looked at further.
CUES = ["licen", "permission", "copyright", "redistribut", "warrant", "reserved", "software", "version", "liab", "loss", "anyone", "acknowledgment", "source", "notice", "mpl", "claim"]

#: Line ends that end a sentence: before a blank line or a list mark. Marks of comments at line starts go first.
_COMMENT = r"\n[ \t]*(?:\*+/?|//+|#+|;+|--+)[ \t]*"
_PARTED = r"(?:\n[ \t\r]*){2,}(?:(?:[-•]|[0-9]{1,2}[.)]|\([A-Za-z0-9]{1,2}\))[ \t]+)?|\n[ \t\r]*(?:[-•]|[0-9]{1,2}[.)]|\([A-Za-z0-9]{1,2}\))[ \t]+"
_ENDED = r"([.!?:;])[ \t\n\x0b\f\r]+"


def normalised(text: str) -> list[str]:
    """The sentences of a text as sentences() gives them, those without a letter or digit left out."""
    marked = re.sub(_ABBREVIATED, "\\1\\2", re.sub(_SPDX, "\x01spdx license identifier \\1\x01", "\n" + text))
    parts = re.sub(_ENDED, "\\1\x01", re.sub(_PARTED, "\x01", re.sub(_COMMENT, "\n", marked))).split("\x01")
    found = [s for p in parts if (s := re.sub(r"[\W_]+", " ", p.lower()).strip())]
    for pattern, instead in SLOTS:
        found = [re.sub(pattern, instead, s) for s in found]
    return found


def _build() -> tuple[dict[str, str], dict[str, str], list[tuple[str, list[str]]]]:
    """Known whole sentences and notices by identifier, and the rules, longest first: whole texts, then what tells a licence apart."""
    known: dict[str, str] = {}  # sentence -> identifier
    rules: list[tuple[str, list[str]]] = []

    def named(text: str, stem: str) -> list[str]:
        return [known.setdefault(s, f"{stem}-{len(known) + 1}") for s in normalised(text) if not s.replace(" ", "").isdigit()]

    mit, conditions, names, disclaimer = named(MIT, "mit"), named(BSD_CONDITIONS, "bsd"), named(BSD_NAMES, "bsd-names"), named(BSD_DISCLAIMER, "bsd-disclaimer")
    author, advertising = named(BSD_AUTHOR, "bsd-author"), named(BSD_ADVERTISING, "bsd-advertising")
    rules += [("BSD-4-Clause", conditions + advertising + x + y) for x in (names, author, []) for y in (disclaimer, [])]
    rules += [("BSD-3-Clause", conditions + author + y) for y in (disclaimer, [])]
    rules += [("MIT", mit), ("MIT", mit[:1]), ("BSD-3-Clause", conditions + names + disclaimer), ("BSD-3-Clause", conditions + names), ("BSD-2-Clause", conditions + disclaimer), ("BSD-2-Clause", conditions)]
    for licence, text, least in (("ISC", ISC, 1), ("Apache-2.0", APACHE, 2), ("MPL-2.0", MPL, 1), ("Zlib", ZLIB, 4), ("Unlicense", UNLICENSE, 1), ("BSL-1.0", BOOST, 1)):
        ids = named(text, licence.lower())
        rules += [(licence, ids), (licence, ids[:least])]
    for licence, name, v in GNU_NAMES:
        for kind, version in GNU_VERSIONS.items():
            for work in ("program", "library"):
                for mark in ";:":
                    ids = named(GNU.format(work=work, mark=mark, name=name, version=version.format(v=v)), "gnu")
                    rules.append((f"{licence}-{kind.partition(',')[0]}", ids))
    for licence in sorted({x for x, _ in rules} | set(NOTICES.values()) - {RESERVED}):
        rules.append((licence, named(f"SPDX-License-Identifier: {licence}", "spdx")))
        for bare in {licence.removesuffix("-only"), licence.replace("-or-later", "+")} - {licence}:
            if licence.endswith(("-only", "-or-later")):
                rules.append((licence, named(f"SPDX-License-Identifier: {bare}", "spdx")))
    short: dict[str, str] = {}
    for notice, licence in NOTICES.items():
        (sentence,) = normalised(notice)
        short[sentence] = f"notice-{licence.lower()}-{len(short) + 1}"
        rules.append((licence, [short[sentence]]))
    different = {(licence, tuple(ids)) for licence, ids in rules}
    order = sorted(different, key=lambda r: (-len(r[1]), r[0], r[1]))
    return known, short, [(licence, list(ids)) for licence, ids in order]


SENTENCES, SHORT, RULES = _build()


def sentences(text: Column) -> Column:
    """Normalised sentences: lower case, letters and digits, single blanks.

    Names of holders and programs are replaced by the usual words (SLOTS), and an SPDX line is a sentence of its own.
    They end at .!?:; before white space, at a blank line and before a list mark; other line ends are wrapped lines, of
    which comment marks are taken away.
    """
    marked = F.regexp_replace(F.regexp_replace(F.concat(F.lit("\n"), text), _SPDX, "\x01spdx license identifier $1\x01"), _ABBREVIATED, "$1$2")
    parted = F.regexp_replace(F.regexp_replace(marked, _COMMENT, "\n"), _PARTED, "\x01")
    ended = F.regexp_replace(parted, _ENDED, "$1\x01")
    return F.transform(F.split(ended, "\x01"), lambda s: _filled(F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "))))


def _filled(sentence: Column) -> Column:
    """A normalised sentence with any holder's, author's or program's name replaced by the usual words."""
    for pattern, instead in SLOTS:
        sentence = F.regexp_replace(sentence, pattern, instead)
    return sentence


def identifier(sentence: Column, known: dict[str, str] = SENTENCES, short: dict[str, str] = SHORT) -> Column:
    """The known sentence that this one is; else the longest notice that it ends with: a notice may follow other words."""
    table = F.create_map(*[F.lit(x) for s, name in sorted(known.items()) for x in (s, name)])
    longest = sorted(short.items(), key=lambda x: (-len(x[0]), x[1]))
    spaced = F.concat(F.lit(" "), sentence)
    return F.coalesce(F.element_at(table, sentence), *[F.when(F.endswith(spaced, F.lit(" " + s)), F.lit(name)) for s, name in longest])


def scan_licences(docs: DataFrame, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """`docs` with licence_sentences, licences and n_licence_sentences, in one pass without a shuffle.

    licence_sentences are the identifiers of the known sentences in the order of the text, joined by commas; licences
    are the distinct licences whose rules match a run of them, sorted and joined by commas. Longer rules come first, of
    equal length the licence that sorts first, and a rule takes its sentences away from later ones. Other sentences
    between two known ones do not part them. A text without any, empty or null, has empty strings and 0; texts of any
    length are read whole. Repeated rows get equal results; an empty table gives none; other columns stay, unless they
    bear the names of the results.
    """
    names = [c for c in docs.columns if c not in ("licence_sentences", "licences", "n_licence_sentences")]
    low = F.lower(F.coalesce("text", F.lit("")))
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.contains(low, F.lit(c))
    found = F.filter(F.transform(sentences(F.col("text")), lambda s: identifier(s)), lambda i: i.isNotNull())
    ids = F.when(cue, found).otherwise(F.array().cast("array<string>"))
    named = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)], ids.alias("ids"))
    line = F.concat(F.lit("|"), F.array_join("ids", "||"), F.lit("|"))
    steps = [F.struct(F.lit(licence).alias("licence"), F.lit("|" + "||".join(sequence) + "|").alias("mark")) for licence, sequence in rules]
    zero = F.struct(line.alias("line"), F.array().cast("array<string>").alias("found"))
    step = lambda s, r: F.when(
        F.contains(s["line"], r["mark"]), F.struct(F.replace(s["line"], r["mark"], F.lit("*")).alias("line"), F.array_append(s["found"], r["licence"]).alias("found"))
    ).otherwise(s)
    matched = F.when(F.size("ids") > 0, F.aggregate(F.array(*steps), zero, step)["found"]).otherwise(F.array().cast("array<string>"))
    held = F.array_sort(F.array_distinct(matched))
    licences = F.array_join(F.when(F.size(held) > 1, F.array_remove(held, RESERVED)).otherwise(held), ",")
    results = [F.array_join("ids", ",").alias("licence_sentences"), licences.alias("licences"), F.size("ids").cast("bigint").alias("n_licence_sentences")]
    return named.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], *results)


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document."""
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


def _oracle() -> str:
    whole = ", ".join(f"('{s}', '{name}')" for s, name in SENTENCES.items())
    short = ", ".join(f"('{s}', '{name}')" for s, name in SHORT.items())
    rules = ", ".join(f"({k}, '{licence}', '|{'||'.join(sequence)}|')" for k, (licence, sequence) in enumerate(RULES))
    sql = lambda x: x.replace("'", "''")
    filled = "s"
    for pattern, instead in SLOTS:
        filled = f"regexp_replace({filled}, '{pattern}', '{instead}')"
    return f"""
WITH RECURSIVE whole(s, id) AS (VALUES {whole}), short(s, id) AS (VALUES {short}), rules(k, licence, mark) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
p AS (SELECT r, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(chr(10) || text, '{sql(_SPDX)}', chr(1) || 'spdx license identifier \\1' || chr(1), 'g'), '{sql(_ABBREVIATED)}', '\\1\\2', 'g'), '{sql(_COMMENT)}', chr(10), 'g'), '{sql(_PARTED)}', chr(1), 'g'), '{sql(_ENDED)}', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM d),
e AS (SELECT r, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part FROM p),
n AS (SELECT r, i, {filled} AS s FROM (SELECT r, i, trim(regexp_replace(lower(part), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS s FROM e)),
k AS (SELECT n.r, n.i, coalesce(max(whole.id), max_by(short.id, strlen(short.s))) AS id FROM n LEFT JOIN whole ON whole.s = n.s LEFT JOIN short ON suffix(' ' || n.s, ' ' || short.s)
      WHERE whole.id IS NOT NULL OR short.id IS NOT NULL GROUP BY n.r, n.i),
f AS (SELECT r, string_agg(id, ',' ORDER BY i) AS ids, '|' || string_agg(id, '||' ORDER BY i) || '|' AS seq, count(*) AS n FROM k GROUP BY r),
m AS (SELECT r, -1 AS k, seq, CAST([] AS VARCHAR[]) AS found FROM f
      UNION ALL SELECT r, rules.k, replace(seq, mark, '*'), CASE WHEN contains(seq, mark) THEN list_append(found, licence) ELSE found END FROM m JOIN rules ON rules.k = m.k + 1),
l AS (SELECT r, list_sort(list_distinct(found)) AS held FROM m WHERE k = {len(RULES) - 1})
SELECT doc_id, coalesce(ids, '') AS licence_sentences,
  coalesce(array_to_string(CASE WHEN len(held) > 1 THEN list_filter(held, lambda x: x <> '{RESERVED}') ELSE held END, ','), '') AS licences, coalesce(n, 0) AS n_licence_sentences
FROM d LEFT JOIN f USING (r) LEFT JOIN l USING (r)
"""


OP7_SQL = _oracle()
