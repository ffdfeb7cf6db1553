"""License scans by sentence rules, in DataFrame functions only.

A text is cut into units: its lines, and within lines what ends at ``. ! ? ; :`` or a closing
bracket before white space. Units are normalised to lower-case words, which drops comment marks.
A known licence sentence is recognised where it is the words of one unit or of several units
following each other, however it is wrapped; of those that start at a unit the longest counts. A
document's sentence identifiers, in their order, are matched against rules, each an ordered
sequence of identifiers that may have others in between. Where a rule's sequence is part of
another's that matches too, the other, longer one wins: BSD-3-Clause, not BSD-2-Clause as well. The
plain reservation of all rights counts where no licence is found.

All of it is one pass over the texts without a shuffle.

Cases: null and empty texts have no sentences and no licence; a rule counts once however often
it matches; repeated rows are matched each; rows without an id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Known sentences of public licences and the notices that name them, in natural
#: wording; they are normalised like a text's own.
SENTENCES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice-the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-2.0-copy": "You may obtain a copy of the License at",
    "apache-2.0-copy-at": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-title": "Apache License",
    "apache-2.0-version": "Version 2.0, January 2004",
    "apache-2.0-license-means": '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document',
    "file-in-compliance": "you may not use this file except in compliance with the License",
    "mit-title": "MIT License",
    "mit-title-the": "The MIT License (MIT)",
    "mit-notice": "Released under the MIT License",
    "mit-notice-licensed": "Licensed under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-0-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "x11-no-promotion": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium",
    "json-good": "The Software shall be used for Good, not Evil",
    "ncsa-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "beerware": '"THE BEER-WARE LICENSE" (Revision 42)',
    "cc0-title": "CC0 1.0 Universal",
    "cc0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "gnu-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "gnu-1991": "Version 2, June 1991",
    "gnu-1999": "Version 2.1, February 1999",
    "gnu-2007-june": "Version 3, 29 June 2007",
    "gnu-2007-november": "Version 3, 19 November 2007",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-notice-v3": "Licensed under the GNU General Public License v3.0",
    "gpl-2.0-notice-v2": "Licensed under the GNU General Public License v2.0",
    "mpl-2.0-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-2.0-title": "Mozilla Public License Version 2.0",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "epl-2.0-notice-at": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-2.0-title": "Eclipse Public License - v 2.0",
    "epl-1.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at",
    "epl-1.0-title": "Eclipse Public License - v 1.0",
    "cddl-subject": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License")',
    "artistic-2.0-title": "The Artistic License 2.0",
    "artistic-2.0-establishes": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed",
    "python-2.0-title": "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
    "ofl-1.1-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "ofl-1.1-title": "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007",
    "ms-pl-title": "Microsoft Public License (Ms-PL)",
    "eupl-1.2-notice": "Licensed under the EUPL, Version 1.2",
    "eupl-1.2-compliance": "You may not use this work except in compliance with the Licence",
    "all-rights-reserved": "All rights reserved",
}
#: Licences and the ordered sentences that show them.
RULES = [
    ("Apache-2.0", ("apache-2.0-notice",)),
    ("Apache-2.0", ("apache-2.0-notice-the", "file-in-compliance", "apache-2.0-copy", "apache-2.0-as-is")),
    ("Apache-2.0", ("apache-2.0-notice-the", "file-in-compliance", "apache-2.0-copy-at")),
    ("Apache-2.0", ("apache-title", "apache-2.0-version")),
    ("Apache-2.0", ("apache-2.0-license-means",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-licensed",)),
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is")),
    ("MIT", ("mit-title", "mit-grant")),
    ("MIT", ("mit-title-the", "mit-grant")),
    ("MIT-0", ("mit-0-grant", "mit-as-is")),
    ("X11", ("mit-grant", "mit-keep", "mit-as-is", "x11-no-promotion")),
    ("JSON", ("mit-grant", "mit-keep", "json-good", "mit-as-is")),
    ("NCSA", ("ncsa-grant",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-university")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse-university")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and",)),
    ("0BSD", ("0bsd-grant",)),
    ("PostgreSQL", ("postgresql-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin", "zlib-altered")),
    ("BSL-1.0", ("boost-notice",)),
    ("BSL-1.0", ("boost-title", "boost-grant")),
    ("Unlicense", ("unlicense-domain",)),
    ("Unlicense", ("unlicense-anyone",)),
    ("WTFPL", ("wtfpl-title",)),
    ("Beerware", ("beerware",)),
    ("CC0-1.0", ("cc0-title",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("GPL-2.0", ("gpl-title", "gnu-1991")),
    ("GPL-3.0", ("gpl-title", "gnu-2007-june")),
    ("LGPL-2.1", ("lgpl-title", "gnu-1999")),
    ("LGPL-3.0", ("lgpl-title", "gnu-2007-june")),
    ("AGPL-3.0", ("agpl-title", "gnu-2007-november")),
    ("GPL-3.0", ("gpl-3.0-notice",)),
    ("GPL-3.0", ("gpl-3.0-notice-v3",)),
    ("GPL-2.0", ("gpl-2.0-notice-v2",)),
    ("MPL-2.0", ("mpl-2.0-subject",)),
    ("MPL-2.0", ("mpl-2.0-title",)),
    ("EPL-2.0", ("epl-2.0-notice",)),
    ("EPL-2.0", ("epl-2.0-notice-at",)),
    ("EPL-2.0", ("epl-2.0-title",)),
    ("EPL-1.0", ("epl-1.0-notice",)),
    ("EPL-1.0", ("epl-1.0-title",)),
    ("CDDL-1.0", ("cddl-subject", "file-in-compliance")),
    ("Artistic-2.0", ("artistic-2.0-title",)),
    ("Artistic-2.0", ("artistic-2.0-establishes",)),
    ("Python-2.0", ("python-2.0-title",)),
    ("OFL-1.1", ("ofl-1.1-notice",)),
    ("OFL-1.1", ("ofl-1.1-title",)),
    ("MS-PL", ("ms-pl-title",)),
    ("EUPL-1.2", ("eupl-1.2-notice",)),
    ("EUPL-1.2", ("eupl-1.2-compliance",)),
    ("Proprietary", ("all-rights-reserved",)),
]
#: What is found only where nothing else is.
LAST_RESORT = "Proprietary"
_CC = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
_GNU = (("GPL", "General", "2.0", "2"), ("GPL", "General", "3.0", "3"), ("LGPL", "Lesser General", "2.1", "2.1"), ("LGPL", "Lesser General", "3.0", "3"), ("AGPL", "Affero General", "3.0", "3"))


def _families() -> None:
    """Adds the notices of licences that differ by version and terms only, and a tag for each licence."""

    def add(licence, name, sentence):
        SENTENCES[name] = sentence
        RULES.append((licence, (name,)))

    for terms in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        words = "-".join(_CC[t] for t in terms.split("-"))
        for version, edition in (("4.0", "International"), ("3.0", "Unported")):
            name = f"CC-{terms}-{version}"
            add(name, f"{name.lower()}-notice", f"Licensed under CC {terms} {version}")
            add(name, f"{name.lower()}-work", f"This work is licensed under a Creative Commons {words} {version} {edition} License")
    for short, words, version, number in _GNU:
        for thing in ("program", "library"):
            head = f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {words} Public License as published by the Free Software Foundation, "
            name = f"{short}-{version}"
            add(f"{name}-or-later", f"{name.lower()}-{thing}-later", f"{head}either version {number} of the License, or (at your option) any later version")
            add(f"{name}-only", f"{name.lower()}-{thing}-only", f"{head}version {number} of the License")
    for name in sorted({licence for licence, _ in RULES} - {LAST_RESORT}):
        add(name, f"{name.lower()}-tag", f"SPDX-License-Identifier: {name}")


_families()
_UNIT_END = r"[.!?;:)][\"'”’]*\s+"


def _units(text: str) -> str:
    """``units`` of one of the table's own sentences, its words joined by single spaces."""
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def units(text: Column) -> Column:
    """The normalised units of a text, each after a line break; a line break ends the last one."""
    cut = F.lower(F.regexp_replace(text, _UNIT_END, "\n"))
    words = F.regexp_replace(F.regexp_replace(cut, r"[^\p{L}\p{N}\n]+", " "), r" *\n[ \n]*", "\n")
    return F.concat(F.lit("\n"), F.trim(words, F.lit(" \n")), F.lit("\n"))


def overruled() -> list[tuple[str, str]]:
    """(winner, loser): licences of which a rule is part of a longer one of another licence."""

    def part_of(a, b):
        rest = iter(b)
        return len(a) < len(b) and all(x in rest for x in a)

    names = {licence for licence, _ in RULES}
    pairs = {(x, y) for x, a in RULES for y, b in RULES if x != y and part_of(b, a)}
    return sorted(pairs | {(x, LAST_RESORT) for x in names - {LAST_RESORT}})


def cues(least: int = 6) -> list[str]:
    """A few words of ``least`` letters or more, one of which is in each known sentence."""
    left, out = [{w for w in _units(s).split() if len(w) >= least} for s in SENTENCES.values()], []
    while left:
        words = sorted(set().union(*left))
        out.append(max(words, key=lambda w: sum(w in x for x in left)))
        left = [x for x in left if out[-1] not in x]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_known, sequence, licenses) for each row: known sentences, their identifiers in order, rules that match."""
    by_length = sorted(((_units(s), k) for k, s in SENTENCES.items()), key=lambda x: (-len(x[0]), x[0]))
    # looked for behind each line break without being consumed, the longest first
    pattern = r"\n(?=(" + "|".join(s.replace(" ", r"[ \n]") for s, _ in by_length) + r")\n)"
    known = F.create_map(*[F.lit(x) for pair in by_length for x in pair])
    # a text without any cue holds no known sentence, so it need not be cut
    text = F.when(F.lower("text").rlike("|".join(cues())), F.col("text")).otherwise("")
    rows = common.documents_of(docs).select("doc_id", F.regexp_extract_all(units(text), F.lit(pattern), F.lit(1)).alias("found"))
    rows = rows.select("doc_id", F.transform("found", lambda s: F.translate(s, "\n", " ")).alias("found"))
    rows = rows.select("doc_id", F.size("found").cast("long").alias("n_known"), F.array_join(F.transform("found", lambda s: F.concat(F.lit("<"), known[s], F.lit(">"))), "").alias("sequence"))
    pairs = lambda names, rows: F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    tables = {
        "rules": pairs(("licence", "pattern"), [(licence, "%" + "%".join(f"<{s}>" for s in rule) + "%") for licence, rule in RULES]),
        "wins": pairs(("winner", "loser"), overruled()),
    }
    out = rows.withColumns(tables).withColumn("names", F.expr("if(n_known = 0, array(), array_sort(array_distinct(transform(filter(rules, r -> sequence like r.pattern), r -> r.licence))))"))
    losers = "transform(filter(wins, w -> array_contains(names, w.winner)), w -> w.loser)"
    return out.select("doc_id", "n_known", "sequence", F.expr(f"if(size(names) > 1, array_except(names, {losers}), names)").cast("array<string>").alias("licenses"))


def oracle_sql() -> str:
    """The same scan in DuckDB SQL, by joins of units with sentences, and texts of the columns joined by commas."""
    table = ", ".join(f"('{_units(s)}', '{k}')" for k, s in SENTENCES.items())
    rules = ", ".join(f"('{name}', '%{'%'.join(f'<{s}>' for s in rule)}%')" for name, rule in RULES)
    wins = ", ".join(f"('{a}', '{b}')" for a, b in overruled())
    most = max(len(_units(s).split()) for s in SENTENCES.values())
    return f"""
WITH known(sentence, known) AS (VALUES {table}), rules(license, pattern) AS (VALUES {rules}), wins(winner, loser) AS (VALUES {wins}),
docs AS (SELECT doc_id, row_number() OVER () AS r, lower(regexp_replace(coalesce(text, ''), '[.!?;:)]["''”’]*\\s+', chr(10), 'g')) AS t FROM documents),
cut AS (SELECT r, string_split(trim(regexp_replace(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), ' *\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10)), chr(10)) AS parts FROM docs),
unit AS (SELECT r, parts, unnest(parts) AS unit, generate_subscripts(parts, 1) AS pos FROM cut),
begun AS (SELECT r, parts, pos, sentence, known FROM unit JOIN known ON starts_with(sentence || ' ', unit || ' ')),
hits AS (SELECT r, pos, arg_max(known, length(sentence)) AS known FROM begun
  WHERE list_contains(list_transform(generate_series(pos, least(pos + {most}, len(parts))), lambda j: array_to_string(parts[pos:j], ' ')), sentence) GROUP BY 1, 2),
seq AS (SELECT r, count(*) AS n_known, string_agg('<' || known || '>', '' ORDER BY pos) AS sequence FROM hits GROUP BY 1),
named AS (SELECT DISTINCT r, license FROM seq JOIN rules ON sequence LIKE pattern),
found AS (SELECT r, string_agg(license, ',' ORDER BY license) AS licenses FROM named n WHERE NOT EXISTS (SELECT 1 FROM named m JOIN wins ON winner = m.license WHERE m.r = n.r AND loser = n.license) GROUP BY 1)
SELECT doc_id, coalesce(n_known, 0)::BIGINT AS n_known, coalesce(sequence, '') AS sequence, coalesce(licenses, '') AS licenses
FROM docs LEFT JOIN seq USING (r) LEFT JOIN found USING (r)
"""
