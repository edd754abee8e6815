"""Licence scans: sentences to known identifiers, identifier sequences to ordered licence rules (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences as published, and their identifiers.
SENTENCES: dict[str, str] = {
    "mit-name": "Released under the MIT License.",
    "mit-name-2": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-name": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-may-not": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl3-name": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software:",
    "gpl-terms-3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-nc-name": "Licensed under CC BY-NC 4.0.",
    "cc-by-name": "Licensed under CC BY 4.0.",
    "cc0-name": "Licensed under CC0 1.0.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
}
#: licence -> ordered identifiers that must occur in this order, other sentences between them allowed.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-name"]),
    ("MIT", ["mit-name-2"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-name"]),
    ("Apache-2.0", ["apache-grant", "apache-may-not", "apache-obtain", "apache-basis"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0", ["gpl3-name"]),
    ("GPL-3.0", ["gpl-free", "gpl-terms-3", "gpl-hope"]),
    ("MPL-2.0", ["mpl2-form", "mpl2-copy"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-name"]),
    ("CC-BY-4.0", ["cc-by-name"]),
    ("CC0-1.0", ["cc0-name"]),
    ("Unlicense", ["unlicense-free"]),
]
#: A licence whose rule another licence's rule includes is left out where that one matches.
COVERED = {"BSD-2-Clause": ["BSD-3-Clause", "BSD-4-Clause"]}
#: Further sentences that only scan() knows, oracle() doesn't: headers and titles as published.
MORE_SENTENCES: dict[str, str] = {
    "mit-notice-next": "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-title": "Apache License Version 2.0, January 2004",
    "library-free": "This library is free software:",
    "library-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-terms-2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-terms-2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-terms-3-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    "lgpl-terms-2.1": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-terms-3": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-terms-3": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "mpl2-copy-http": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "zlib-notice": "This notice may not be removed or altered from any source distribution.",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "epl1-title": "Eclipse Public License - v 1.0",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl2-made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "artistic2-title": "The Artistic License 2.0",
    "artistic2-terms": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.",
    "cddl1-title": "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0",
    "mspl-title": "Microsoft Public License (Ms-PL)",
    "ofl-grant": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "wtfpl-terms": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "mpl11-terms": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-sa-name": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-name": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-name": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-name": "Licensed under CC BY-NC-ND 4.0.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
MORE_RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-grant", "mit-notice-next"]),
    ("ISC", ["isc-grant-and"]),
    ("Apache-2.0", ["apache-title"]),
    ("GPL-3.0", ["gpl-free", "gpl-terms-3-only", "gpl-hope"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("MPL-2.0", ["mpl2-form", "mpl2-copy-http"]),
    ("GPL-2.0", ["gpl-free", "gpl-terms-2", "gpl-hope"]),
    ("GPL-2.0", ["gpl-free", "gpl-terms-2-only", "gpl-hope"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("LGPL-2.1", ["library-free", "lgpl-terms-2.1", "library-hope"]),
    ("LGPL-2.1", ["gpl-free", "lgpl-terms-2.1", "gpl-hope"]),
    ("LGPL-2.1", ["lgpl2.1-title"]),
    ("LGPL-3.0", ["library-free", "lgpl-terms-3", "library-hope"]),
    ("LGPL-3.0", ["gpl-free", "lgpl-terms-3", "gpl-hope"]),
    ("LGPL-3.0", ["lgpl3-title"]),
    ("AGPL-3.0", ["gpl-free", "agpl-terms-3", "gpl-hope"]),
    ("AGPL-3.0", ["agpl3-title"]),
    ("MIT-0", ["mit0-grant", "mit-as-is", "mit-liable"]),
    ("0BSD", ["0bsd-grant", "isc-as-is"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-as-is"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"]),
    ("BSL-1.0", ["boost-title"]),
    ("BSL-1.0", ["boost-grant"]),
    ("EPL-1.0", ["epl1-title"]),
    ("EPL-2.0", ["epl2-title"]),
    ("EPL-2.0", ["epl2-made"]),
    ("Artistic-2.0", ["artistic2-title", "artistic2-terms"]),
    ("CDDL-1.0", ["cddl1-title"]),
    ("MS-PL", ["mspl-title"]),
    ("OFL-1.1", ["ofl-grant"]),
    ("PostgreSQL", ["postgresql-grant"]),
    ("WTFPL", ["wtfpl-terms"]),
    ("MPL-1.1", ["mpl11-terms"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-name"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-work"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-name"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-work"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-name"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-work"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-name"]),
    ("Unlicense", ["unlicense-anyone"]),
]
#: Ways to name a licence in one sentence, and the names of each.
NAMED = ["Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This project is licensed under the {}.", "This project is licensed under the terms of the {}.", "This software is licensed under the {}."]
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License"],
    "ISC": ["ISC License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License, version 1.0"],
    "Zlib": ["zlib License"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1"],
    **{n: [] for n in ("CC-BY-NC-4.0", "CC-BY-4.0", "CC0-1.0", "Unlicense", "MIT-0", "0BSD", "BSD-4-Clause", "Artistic-2.0", "CDDL-1.0", "MS-PL", "PostgreSQL", "WTFPL", "MPL-1.1", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0")},
}
SPDX, SPDX_ENDS = "SPDX-License-Identifier: {}", {"GPL-2.0": ["-only", "-or-later", "+"], "GPL-3.0": ["-only", "-or-later", "+"], "LGPL-2.1": ["-only", "-or-later", "+"], "LGPL-3.0": ["-only", "-or-later", "+"], "AGPL-3.0": ["-only", "-or-later", "+"]}
#: Sentence that names its holder, in normal form with line ends as they come.
HOLDER = r"(?<=\n)((?:[0-9] )?)neither[ \n]the[ \n]names?[ \n]of[ \n](?:[a-z0-9]+[ \n]){1,16}?nor[ \n]the[ \n]names[ \n]of[ \n](?:its|their|any)[ \n]contributors"
#: Ends of sentences in running text, and what normalisation takes out.
END, DROP = r"([.;:!?])\s+", "[^a-z0-9]+"


def normalise(sentence: str) -> str:
    import re

    return re.sub(DROP, " ", sentence.lower()).strip()


def known() -> dict[str, str]:
    return {normalise(s): i for i, s in SENTENCES.items()}


def _sequence(text: Column) -> Column:
    """The identifiers of a text's known sentences in order, as '<a><b>'."""
    table = F.create_map(*(F.lit(x) for pair in known().items() for x in pair))
    norm = F.transform(F.split(F.regexp_replace(text, END, "$1\n"), "\n"), lambda s: F.trim(F.regexp_replace(F.lower(s), DROP, " ")))
    return F.array_join(F.transform(F.filter(norm, lambda s: s.isin(list(known()))), lambda s: F.concat(F.lit("<"), F.element_at(table, s), F.lit(">"))), "")


def _all_known() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Normal form -> identifier of every sentence that scan() knows, and every rule."""
    sentences, rules = known() | {normalise(s): i for i, s in MORE_SENTENCES.items()}, RULES + MORE_RULES
    for name, names in NAMES.items():
        named = [t.format(n) for t in NAMED for n in names] + [SPDX.format(name + e) for e in ("", *SPDX_ENDS.get(name, []))]
        for s in named:
            sentences.setdefault(normalise(s), f"{name.lower()}-named")
        rules = rules + [(name, [f"{name.lower()}-named"])]
    return sentences, rules


def _runs(text: Column) -> Column:
    """The identifiers of known sentences that begin where a line or sentence does and end where one does, by position.

    Between its ends a sentence may run over lines, blank ones and marks of comments included.
    """
    sentences, _ = _all_known()
    t = F.regexp_replace(F.regexp_replace(F.lower(text), END, "$1\n"), r"https?://[^\s>)]+", "\n$0\n")
    t = F.regexp_replace(F.regexp_replace(F.concat(F.lit("\n"), t, F.lit("\n")), "[^a-z0-9\n]+", " "), " ?\n[ \n]*", "\n")
    t = F.regexp_replace(t, HOLDER, "$1neither the name of the copyright holder nor the names of its contributors")
    longest = "|".join(s.replace(" ", r"[ \n]") for s in sorted(sentences, key=len, reverse=True))
    # a look ahead, so that a sentence that begins inside another is found too
    runs = F.regexp_extract_all(t, F.lit(rf"(?<=\n)(?=(?:[a-d1-9] )?({longest})\n)"), F.lit(1))
    table = F.create_map(*(F.lit(x) for pair in sentences.items() for x in pair))
    return F.array_join(F.transform(runs, lambda s: F.concat(F.lit("<"), F.element_at(table, F.translate(s, "\n", " ")), F.lit(">"))), "")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (of the lines, in order), licenses ('|'-joined, in the order of RULES), n_licenses, clean.

    Sentences end at line ends or at punctuation before white space; a second reading joins the lines, and a third
    has the sentences that begin and end with lines or sentences, however many lines they run over, with those of
    MORE_SENTENCES and NAMES. A rule holds if one reading has its identifiers in order. A null text has none and is
    clean. Other columns are ignored; repeated rows are scanned each; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", _sequence(text).alias("sentence_ids"), _sequence(F.regexp_replace(text, "\n", " ")).alias("flow"), _runs(text).alias("runs"))
    hit: dict[str, Column] = {}
    for name, ids in _all_known()[1]:
        like = "%" + "%".join(f"<{i}>" for i in ids) + "%"
        cond = F.col("runs").like(like)
        if (name, ids) in RULES:
            cond = F.col("sentence_ids").like(like) | F.col("flow").like(like) | cond
        hit[name] = hit[name] | cond if name in hit else cond
    for name, others in COVERED.items():
        for by in others:
            hit[name] = hit[name] & ~hit[by]
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in hit.items())))
    df = df.withColumn("found", found)
    return df.select("doc_id", "sentence_ids", F.array_join("found", "|").alias("licenses"), F.size("found").cast("long").alias("n_licenses"), (F.size("found") == 0).alias("clean"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """The scan in DuckDB SQL, without the third reading and its sentences: it finds no more than scan()."""
    values = ", ".join(f"({_quoted(k)}, {_quoted(i)})" for k, i in known().items())
    hit: dict[str, str] = {}
    for name, ids in RULES:
        like = _quoted("%" + "%".join(f"<{i}>" for i in ids) + "%")
        cond = f"(sentence_ids like {like} or flow like {like})"
        hit[name] = f"{hit[name]} or {cond}" if name in hit else cond
    cases = []
    for name, cond in hit.items():
        cond = f"({cond})" + "".join(f" and not ({hit[by]})" for by in COVERED.get(name, []) if by in hit)
        cases.append(f"case when {cond} then {_quoted(name)} end")
    return f"""
with known(s, i) as (values {values}),
readings as (
  select doc_id, 'line' as kind, coalesce(text, '') as t from documents
  union all select doc_id, 'flow', replace(coalesce(text, ''), chr(10), ' ') from documents),
lines as (select doc_id, kind, string_split(regexp_replace(t, '{END}', '\\1' || chr(10), 'g'), chr(10)) as l from readings),
flat as (select doc_id, kind, unnest(l) as s, generate_subscripts(l, 1) as k from lines),
named as (select doc_id, kind, k, i from (select doc_id, kind, k, trim(regexp_replace(lower(s), '{DROP}', ' ', 'g')) as s from flat) join known using (s)),
seqs as (
  select d.doc_id,
    coalesce(string_agg('<' || i || '>', '' order by k) filter (where kind = 'line'), '') as sentence_ids,
    coalesce(string_agg('<' || i || '>', '' order by k) filter (where kind = 'flow'), '') as flow
  from documents d left join named using (doc_id) group by d.doc_id),
hits as (select doc_id, sentence_ids, list_filter([{", ".join(cases)}], lambda x: x is not null) as found from seqs)
select doc_id, sentence_ids, coalesce(array_to_string(found, '|'), '') as licenses, cast(len(found) as bigint) as n_licenses, len(found) = 0 as clean from hits
"""
