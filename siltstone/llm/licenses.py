"""Licence scans by sentence rules.

A text is cut into sentences twice, with line ends as breaks and with single line ends as spaces. Each
sentence is normalised (lower case, runs of other characters than a-z, 0-9, dot, plus and hyphen to one
space) and mapped to the identifier of a known licence sentence. The identifiers in text order are then
matched against rules: a rule is an ordered list of identifiers, and other sentences may stand between.
All of it is one projection of built-in functions: no shuffle, and no state that grows with the data.

An equal text has an equal result, however often it is there; an empty table gives no rows, and a text of any
length is read whole. A null or empty text has no sentences and no licences. Repeated sentences repeat their identifier. Only
the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, as they read once cut and normalised.
NOTICES = (
    "released under the mit license",
    "licensed under the mit license",
    "this project is licensed under the mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "licensed under the apache license version 2.0",
    "licensed under the apache license version 2.0 the license",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "see the license for the specific language governing permissions and limitations under the license",
    "this work is licensed under the gnu general public license version 3",
    "this work is licensed under the gnu general public license version 2",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "without even the implied warranty of merchantability or fitness for a particular purpose",
    "see the gnu general public license for more details",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "this source code form is subject to the terms of the mozilla public license v",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "this is free and unencumbered software released into the public domain",
    "licensed under cc by-nc 4.0",
    "licensed under cc by 4.0",
    "licensed under cc by-sa 4.0",
    "licensed under cc by-nc-sa 4.0",
    "licensed under cc by-nd 4.0",
    "licensed under cc by-nc-nd 4.0",
    "this work is licensed under a creative commons attribution 4.0 international license",
    "this work is licensed under a creative commons attribution-sharealike 4.0 international license",
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
    "spdx-license-identifier mit",
    "spdx-license-identifier apache-2.0",
    "spdx-license-identifier gpl-3.0-only",
    "spdx-license-identifier gpl-3.0-or-later",
    "spdx-license-identifier bsd-3-clause",
    "all rights reserved",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "either version 2 of the license or at your option any later version",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "either version 2.1 of the license or at your option any later version",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl-2.0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution and is available at http www.eclipse.org legal epl-v10.html",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "distributed under the boost software license version 1.0",
    "this software is provided as-is without any express or implied warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
)
# Licence, and the ordered sentences (places in NOTICES, from 0) that show it.
NOTICE_RULES = (
    ("MIT", (0,)), ("MIT", (1,)), ("MIT", (2,)), ("MIT", (3, 4, 5)), ("MIT", (35,)),
    ("Apache-2.0", (6,)), ("Apache-2.0", (7, 8, 10)), ("Apache-2.0", (36,)),
    ("GPL-3.0", (12,)), ("GPL-3.0", (14, 16, 17)), ("GPL-3.0", (37,)), ("GPL-3.0", (38,)),
    ("GPL-2.0", (13,)), ("GPL-2.0", (15, 16, 17)),
    ("BSD-2-Clause", (18, 19, 20)), ("BSD-3-Clause", (18, 19, 20, 21)), ("BSD-3-Clause", (39,)),
    ("ISC", (22,)), ("MPL-2.0", (23, 24)), ("Unlicense", (25,)),
    ("CC-BY-NC-4.0", (26,)), ("CC-BY-4.0", (27,)), ("CC-BY-SA-4.0", (28,)), ("CC-BY-NC-SA-4.0", (29,)), ("CC-BY-ND-4.0", (30,)), ("CC-BY-NC-ND-4.0", (31,)),
    ("CC-BY-4.0", (32,)), ("CC-BY-SA-4.0", (33,)), ("CC-BY-NC-4.0", (34,)),
    ("Proprietary", (40,)),
    ("GPL-2.0", (41, 42)), ("LGPL-2.1", (43, 44)), ("LGPL-3.0", (45,)), ("AGPL-3.0", (46,)), ("EPL-2.0", (47,)), ("EPL-1.0", (48,)),
    ("CC0-1.0", (49,)), ("BSL-1.0", (50,)), ("Zlib", (51, 52)),
)
# How a statement begins, licences as statements call them, and identifiers of SPDX lines.
OPENINGS = ("", "this project is ", "this work is ", "this program is ", "this software is ", "this library is ")
SPOKEN = (
    ("MIT", "mit license"), ("Apache-2.0", "apache license version 2.0"), ("Apache-2.0", "apache license 2.0"), ("Apache-2.0", "apache 2.0 license"),
    ("GPL-3.0", "gnu general public license version 3"), ("GPL-3.0", "gnu general public license v3.0"), ("GPL-2.0", "gnu general public license version 2"), ("GPL-2.0", "gnu general public license v2.0"),
    ("LGPL-3.0", "gnu lesser general public license version 3"), ("LGPL-2.1", "gnu lesser general public license version 2.1"), ("AGPL-3.0", "gnu affero general public license version 3"),
    ("BSD-2-Clause", "bsd 2-clause license"), ("BSD-3-Clause", "bsd 3-clause license"), ("ISC", "isc license"), ("MPL-2.0", "mozilla public license 2.0"),
    ("EPL-2.0", "eclipse public license 2.0"), ("BSL-1.0", "boost software license version 1.0"), ("Zlib", "zlib license"),
)
SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-1.0", "EPL-2.0", "Unlicense", "BSL-1.0", "Zlib", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
)


def _statements() -> dict[str, str]:
    """Sentences that name their licence: every opening with every name, and the SPDX lines."""
    said = {f"{opening}licensed under the {name}": licence for licence, name in SPOKEN for opening in OPENINGS}
    return said | {f"spdx-license-identifier {i.lower()}": i.removesuffix("-only").removesuffix("-or-later") for i in SPDX}


_NAMED = {s: licence for s, licence in _statements().items() if s not in NOTICES}
SENTENCES = (*NOTICES, *_NAMED)
#: Licence and the places of its sentences in SENTENCES, from 0, in order.
RULES = (*NOTICE_RULES, *((licence, (len(NOTICES) + i,)) for i, licence in enumerate(_NAMED.values())))
SPDX_COLON = r"(?i)(spdx-license-identifier):[ \t]*"
#: A word that each known sentence holds; other sentences are not looked up.
ANCHORS = r"licen|permission|copyright|warrant|redistribut|mpl was not|public domain|rights reserved"
#: A rule is implied by a longer one: BSD-3-Clause holds the sentences of BSD-2-Clause.
IMPLIES = {"BSD-3-Clause": "BSD-2-Clause"}


def normalise(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), r"[^a-z0-9.+-]+", " "), r"[.+ -]+$", ""))


def identifiers(lines: Column) -> Column:
    """Known sentences' places, in text order, as ``|3|4|``; '' where there is none."""
    known = F.create_map(*[x for i, s in enumerate(SENTENCES) for x in (F.lit(s), F.lit(str(i)))])
    # the colon of an SPDX line ends no sentence
    cut = F.split(F.regexp_replace(lines, SPDX_COLON, "$1 "), r"[.!?;:]+(?:\s+|$)|\n+")
    held = F.filter(cut, lambda s: s.rlike(f"(?i){ANCHORS}"))
    found = F.filter(F.transform(held, lambda s: F.try_element_at(known, normalise(s))), lambda i: i.isNotNull())
    return F.when(F.size(found) > 0, F.concat(F.lit("|"), F.array_join(found, "|"), F.lit("|"))).otherwise("")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, by_line, by_paragraph, licenses): identifiers of both cuts, and the licences as a sorted, comma-joined string."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    may = text.rlike(f"(?i){ANCHORS}")
    wrapped = F.regexp_replace(text, r"([^\n])\n([^\n])", "$1 $2")
    ids = df.select(F.col(f"`{id_col}`"), F.when(may, identifiers(text)).otherwise("").alias("by_line"), F.when(may, identifiers(wrapped)).otherwise("").alias("by_paragraph"))
    hits: dict[str, Column] = {}
    for name, rule in RULES:
        pattern = "%" + "%".join(f"|{i}|" for i in rule) + "%"
        # neighbours share one bar: doubling the bars lets each identifier keep both of its own
        hit = F.replace("by_line", F.lit("|"), F.lit("||")).like(pattern) | F.replace("by_paragraph", F.lit("|"), F.lit("||")).like(pattern)
        hits[name] = hits[name] | hit if name in hits else hit
    for longer, shorter in IMPLIES.items():
        hits[shorter] = hits[shorter] & ~hits[longer]
    names = F.array_compact(F.array(*[F.when(hits[n], F.lit(n)) for n in sorted(hits)]))
    return ids.withColumn("licenses", F.array_join(names, ","))
