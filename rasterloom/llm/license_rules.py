"""License scans by sentence rules, in DataFrame operations throughout.

A text is cut into sentences at lines without letters or digits and after . ; : ! ? before white
space; single line breaks, as of wrapped paragraphs and comments, stay within a sentence. A sentence
is normalised (lower case, runs of anything but letters, digits, dots and plus signs to one space,
trailing dots off) and mapped to the identifier of a known licence sentence. One of several lines
that is unknown is looked at by its lines: the longest run of last lines that is a known sentence,
such as a grant under a copyright line, and each line before it. What is still unknown has no
identifier, and numbers or letters of lists are left out. The sequence of identifiers is matched
against the ordered rules, longest first, with up to GAP unknown sentences or "all rights reserved"
between the parts, so the sentences of a full licence text are not reported again by a shorter rule.
Known sentences are those of whole public licence texts and notices, cut and normalised the same way.
All of it happens within the row: no shuffle, nothing grows with the corpus but the scan.

Null and empty texts have no sentences and no licences. A null doc_id stays. Repeated rows stay rows.
Rules of one length are tried in the order of RULES, the only tie. An empty table gives no rows. Texts
of any length are read whole. Only doc_id and text are read, so further columns may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licence texts and notices: fixed values.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
BSD_3 = BSD_2.replace("THIS SOFTWARE", BSD_THIRD + "THIS SOFTWARE", 1)
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
GNU = """This {kind} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.

This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details."""
NOTICES = {
    "MIT": [MIT],
    "BSD-3-Clause": [BSD_3],
    "BSD-2-Clause": [BSD_2],
    "ISC": [ISC],
    "Zlib": [ZLIB],
    "Unlicense": [UNLICENSE],
    "Apache-2.0": [APACHE, APACHE.replace("; you may", ".\n\nYou may")],
    "MPL-2.0": [MPL, MPL.replace("You can", "you can").replace("https", "http")],
    "GPL-3.0-or-later": [GNU.format(kind="program", name="General", mark=":", comma=",", version="3")],
    "GPL-2.0-or-later": [GNU.format(kind="program", name="General", mark=";", comma=c, version="2") for c in (";", ",")],
    "LGPL-3.0-or-later": [GNU.format(kind=k, name="Lesser General", mark=m, comma=",", version="3") for k, m in (("library", ":"), ("program", ":"))],
    "LGPL-2.1-or-later": [GNU.format(kind="library", name="Lesser General", mark=";", comma=c, version="2.1") for c in (";", ",")],
    "AGPL-3.0-or-later": [GNU.format(kind="program", name="Affero General", mark=":", comma=",", version="3")],
}
#: How many sentences of a notice tell it when the rest is missing or altered (all, if not named here): fixed values.
ENOUGH = {"MIT": (3, 2), "BSD-2-Clause": (3,), "BSD-3-Clause": (4,), "ISC": (1,), "Zlib": (3,), "Unlicense": (1,), "Apache-2.0": (3, 2), "GPL-3.0-or-later": (2,), "GPL-2.0-or-later": (3, 2), "LGPL-3.0-or-later": (2,), "LGPL-2.1-or-later": (3, 2), "AGPL-3.0-or-later": (2,)}
#: Titles and short statements, sentence by sentence: fixed values.
STATEMENTS = (
    ("Apache-2.0", ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",)),
    ("Apache-2.0", ("Apache License", "Version 2.0, January 2004")),
    ("Apache-2.0", ("Licensed under the Apache License, Version 2.0",)),
    ("GPL-3.0", ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",)),
    ("GPL-3.0", ("This work is licensed under the GNU General Public License, version 3",)),
    ("GPL-3.0", ("Licensed under the GNU General Public License, version 3",)),
    ("GPL-2.0", ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",)),
    ("LGPL-3.0", ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",)),
    ("AGPL-3.0", ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",)),
    ("MPL-2.0", ("Mozilla Public License Version 2.0",)),
    ("MIT", ("Released under the MIT License",)),
    ("MIT", ("Licensed under the MIT License",)),
    ("CC-BY-NC-4.0", ("Licensed under CC-BY-NC-4.0",)),
    ("CC-BY-4.0", ("Licensed under CC-BY-4.0",)),
    ("CC-BY-SA-4.0", ("Licensed under CC-BY-SA-4.0",)),
    ("CC0-1.0", ("To the extent possible under law, the author has dedicated all copyright and related rights to the public domain",)),
    ("BSD", ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",)),
    ("Proprietary", ("All rights reserved",)),
)
#: Titles that belong to a notice where one follows, and say nothing alone.
TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License",), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",)}
#: Each known sentence has one of these, so texts with none need no look at their sentences.
HINTS = "licen[sc]e|permission|warrant|copyright|redistribut|rights|software|liable|public domain|as such|this notice|distributed|profits|version|2[.]0"
GAP = 6
BLANK, MARK, CUT = r"\n([^\p{L}\p{N}\n]*\n)+", r"([.;:!?])[ \t\r\n\x0b\x0c]+", "\x01"
ODD = "[^\\p{L}\\p{N}.+]+"


def normalised_sentences(text: str) -> list[str]:
    """What scan() makes of a text, for the constants above (ASCII)."""
    parts = re.sub(MARK, rf"\1{CUT}", re.sub(BLANK.replace(r"\p{L}\p{N}", "A-Za-z0-9"), CUT, text)).split(CUT)
    plain = (re.sub("[. ]+$", "", re.sub("[^A-Za-z0-9.+]+", " ", p.lower()).strip()) for p in parts)
    return [p for p in plain if len(p) > 1]


def _rules() -> list[tuple[str, tuple[str, ...]]]:
    found = []
    for licence, texts in NOTICES.items():
        for text in texts:
            whole = normalised_sentences(text)
            heads = [whole, *(whole[:n] for n in ENOUGH.get(licence, ()))]
            found += [(licence, (*normalised_sentences(title), *head)) for head in heads for title in ("", *TITLES.get(licence, ()))]
    found += [(licence, tuple(x for s in parts for x in normalised_sentences(s))) for licence, parts in STATEMENTS]
    return list(dict.fromkeys(found))


#: (licence, known sentences in order).
RULES = _rules()
#: Known sentences; the place of one is its identifier.
SENTENCES = list(dict.fromkeys(s for _, parts in RULES for s in parts))
RESERVED = SENTENCES.index("all rights reserved")
#: A run of lines longer than a known sentence has words can't be one.
MOST_LINES = max(len(s.split()) for s in SENTENCES)


def ordered_rules() -> list[tuple[str, str]]:
    """(licence, pattern over the identifier sequence), longest rules first."""
    number, gap = {s: i for i, s in enumerate(SENTENCES)}, f"(?:<(?:{RESERVED})?>){{0,{GAP}}}"
    return [(licence, gap.join(f"<{number[x]}>" for x in parts)) for licence, parts in sorted(RULES, key=lambda r: -len(r[1]))]


def _grouped() -> list[tuple[str, str]]:
    """Rules of one licence that follow one another as one pattern; (?: | ) takes the first that fits, the longest."""
    out: list[tuple[str, list[str]]] = []
    for licence, pattern in ordered_rules():
        if out and out[-1][0] == licence:
            out[-1][1].append(pattern)
        else:
            out.append((licence, [pattern]))
    return [(licence, "|".join(patterns)) for licence, patterns in out]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_known, n_matches, licenses of each row of docs(doc_id, text).

    licenses: the licences found, each once, in the order of the code points, joined by ;.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.array(*map(F.lit, SENTENCES))
    told = lambda s: s.rlike(r"[\p{L}\p{N}]")

    def place(s: Column) -> Column:
        return F.array_position(known, F.regexp_replace(F.trim(F.regexp_replace(F.lower(s), ODD, " ")), "[. ]+$", ""))

    def named(s: Column) -> Column:
        at = place(s)
        return F.when(at > 0, F.concat(F.lit("<"), (at - 1).cast("string"), F.lit(">"))).when(F.length(F.regexp_replace(s, ODD, "")) < 3, "").otherwise("<>")

    def by_lines(s: Column) -> Column:
        lines = F.filter(F.split(s, "\n"), told)
        n = F.size(lines)
        run = lambda i: F.array_join(F.slice(lines, i + 1, n - i), " ")
        from_ = F.coalesce(F.get(F.filter(F.sequence(F.greatest(F.lit(1), n - MOST_LINES), n - 1), lambda i: place(run(i)) > 0), F.lit(0)), n)
        return F.concat(F.array_join(F.transform(F.slice(lines, F.lit(1), from_), named), ""), F.when(from_ < n, named(run(from_))).otherwise(""))

    def identified(s: Column) -> Column:
        several = F.size(F.filter(F.split(s, "\n"), told)) > 1
        return F.when(several & (place(s) == 0), by_lines(s)).otherwise(named(s))

    marked = F.regexp_replace(F.regexp_replace(text, BLANK, CUT), MARK, f"$1{CUT}")
    cut = docs.select("doc_id", F.filter(F.split(marked, CUT), told).alias("parts"), F.lower(text).rlike(HINTS).alias("hinted"))
    chain = F.when(F.col("hinted"), F.array_join(F.transform("parts", identified), "")).otherwise("")
    rows = cut.select("doc_id", F.size("parts").cast("long").alias("n_sentences"), chain.alias("c"))
    found = rows.select("doc_id", "n_sentences", F.regexp_count("c", F.lit("<[0-9]+>")).cast("long").alias("n_known"), "c", F.array().cast("array<string>").alias("hits"), F.lit(0).cast("long").alias("n_matches"))
    for licence, pattern in _grouped():
        times = F.regexp_count("c", F.lit(pattern)).cast("long")
        found = found.select("doc_id", "n_sentences", "n_known", "c", "hits", "n_matches", F.when(F.col("n_known") > 0, times).otherwise(0).alias("t"))
        found = found.select("doc_id", "n_sentences", "n_known", F.when(F.col("t") > 0, F.regexp_replace("c", pattern, "<>")).otherwise(F.col("c")).alias("c"), F.when(F.col("t") > 0, F.array_append("hits", F.lit(licence))).otherwise(F.col("hits")).alias("hits"), (F.col("n_matches") + F.col("t")).alias("n_matches"))
    return found.select("doc_id", "n_sentences", "n_known", "n_matches", F.array_join(F.array_sort(F.array_distinct("hits")), ";").alias("licenses"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    told = lambda s: f"regexp_matches({s}, '[\\p{{L}}\\p{{N}}]')"
    known = f"[{', '.join(map(quote, SENTENCES))}]"
    place = lambda s: f"coalesce(list_position({known}, regexp_replace(trim(regexp_replace(lower({s}), '{ODD}', ' ', 'g')), '[. ]+$', '')), 0)"
    named = lambda s: f"(CASE WHEN {place(s)} > 0 THEN '<' || ({place(s)} - 1) || '>' WHEN length(regexp_replace({s}, '{ODD}', '', 'g')) < 3 THEN '' ELSE '<>' END)"
    blank, mark = BLANK.replace("'", "''"), MARK
    steps, last = [], "step0"
    for i, (licence, pattern) in enumerate(_grouped(), 1):
        t = f"len(regexp_extract_all(c, '{pattern}'))"
        steps.append(f"step{i} AS (SELECT doc_id, n_sentences, n_known, regexp_replace(c, '{pattern}', '<>', 'g') c, CASE WHEN {t} > 0 THEN list_append(hits, '{licence}') ELSE hits END hits, n_matches + {t} n_matches FROM {last})")
        last = f"step{i}"
    return f"""
    WITH numbered AS (SELECT row_number() OVER () r, doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '{blank}', chr(1), 'g'), '{mark}', '\\1' || chr(1), 'g') t FROM documents),
    cut AS MATERIALIZED (SELECT r, doc_id, list_filter(string_split(t, chr(1)), lambda s: {told("s")}) parts FROM numbered),
    sentence AS MATERIALIZED (SELECT r, unnest(parts) s, generate_subscripts(parts, 1) k FROM cut),
    lined AS MATERIALIZED (SELECT r, k, s, list_filter(string_split(s, chr(10)), lambda x: {told("x")}) l FROM sentence),
    tried AS MATERIALIZED (SELECT r, k, s, l, CASE WHEN len(l) > 1 AND {place("s")} = 0 THEN coalesce(list_filter(range(greatest(1, len(l) - {MOST_LINES}), len(l)), lambda i: {place("array_to_string(l[i + 1:], ' ')")} > 0)[1], len(l)) END f FROM lined),
    ids AS (SELECT r, string_agg(CASE WHEN f IS NULL THEN {named("s")} ELSE array_to_string(list_transform(l[1:f], lambda x: {named("x")}), '') || CASE WHEN f < len(l) THEN {named("array_to_string(l[f + 1:], ' ')")} ELSE '' END END, '' ORDER BY k) c FROM tried GROUP BY r),
    step0 AS (SELECT doc_id, len(parts) n_sentences, len(regexp_extract_all(coalesce(c, ''), '<[0-9]+>')) n_known, coalesce(c, '') c, []::VARCHAR[] hits, 0::BIGINT n_matches FROM cut LEFT JOIN ids USING (r)),
    {", ".join(steps)}
    SELECT doc_id, n_sentences::BIGINT n_sentences, n_known::BIGINT n_known, n_matches::BIGINT n_matches, coalesce(array_to_string(list_sort(list_distinct(hits)), ';'), '') licenses FROM {last}"""
