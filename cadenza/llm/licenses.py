"""License scans by sentence rules, in DataFrame functions only.

A text is split into sentences; each is normalised (ASCII letters to lower
case, everything but letters, digits, ``.+-`` to single blanks, outer dots and
blanks off) and looked up among known license sentences. What remains of a
document is the sequence of the identifiers found, in order. License rules are
ordered sequences of identifiers, the longer ones first; a rule holds where its
identifiers stand side by side in the document's sequence (other sentences
between them do not count), and a rule whose license an earlier one has named
adds nothing.

License texts are wrapped in some places and listed line by line in others. So
a text is read twice, line ends being blanks or ends of sentences, and the
reading that recognises more sentences counts (the first, if equal). Addresses
and empty lines end a sentence in both; an SPDX tag and what follows it on the
line are one sentence.

A text that has none of the words in ``ANCHORS`` is not split. Each known
sentence has one of them, and normalising never joins or changes words, so no
sentence is lost by that.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact

#: Normalised sentences of well-known licenses and what identifies them.
SENTENCES = {
    "licensed under the apache license version 2.0": "ApacheRef",
    "licensed under the apache license version 2.0 the license": "ApacheLicensed",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheWarranty",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied": "MitWarranty",
    "this work is licensed under the gnu general public license version 3": "GplRef3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GplFree3",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplHope",
    "see the gnu general public license for more details": "GplSee",
    "licensed under cc by-nc 4.0": "CcByNcRef4",
    "licensed under cc by 4.0": "CcByRef4",
    "licensed under cc by-sa 4.0": "CcBySaRef4",
    "this work is licensed under a creative commons attribution 4.0 international license": "CcByRef4",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdRedist",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdNames",
    "all rights reserved": "AllRights",
}

#: Ordered rules, the longer sequence first, and the license each names.
RULES = [
    (["ApacheLicensed", "ApacheUse", "ApacheCopy", "ApacheWarranty", "ApacheSee"], "Apache-2.0"),
    (["BsdRedist", "BsdSource", "BsdBinary", "BsdNames"], "BSD-3-Clause"),
    (["MitGrant", "MitNotice", "MitWarranty"], "MIT"),
    (["BsdRedist", "BsdSource", "BsdBinary"], "BSD-2-Clause"),
    (["GplFree3", "GplHope", "GplSee"], "GPL-3.0-or-later"),
    (["ApacheRef"], "Apache-2.0"),
    (["ApacheLicensed"], "Apache-2.0"),
    (["MitRef"], "MIT"),
    (["MitGrant"], "MIT"),
    (["GplRef3"], "GPL-3.0-only"),
    (["GplFree3"], "GPL-3.0-or-later"),
    (["CcByNcRef4"], "CC-BY-NC-4.0"),
    (["CcByRef4"], "CC-BY-4.0"),
    (["CcBySaRef4"], "CC-BY-SA-4.0"),
    (["AllRights"], "Proprietary"),
]

#: GNU licenses, what their identifiers begin with, and their versions; Creative Commons licenses likewise.
_GNU = [("general", "GPL", ("2", "3")), ("lesser general", "LGPL", ("2.1", "3")), ("affero general", "AGPL", ("3",))]
_CC = {"attribution-sharealike": "BY-SA", "attribution-noncommercial": "BY-NC", "attribution-noderivatives": "BY-ND", "attribution-noncommercial-sharealike": "BY-NC-SA", "attribution-noncommercial-noderivatives": "BY-NC-ND"}

#: Licenses that an SPDX tag may name.
SPDX = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib"]

#: Titles of whole license texts, and the licenses they name.
TITLES = {
    "apache license version 2.0 january 2004": "Apache-2.0",
    "gnu general public license version 2 june 1991": "GPL-2.0-only",
    "gnu general public license version 3 29 june 2007": "GPL-3.0-only",
    "gnu lesser general public license version 2.1 february 1999": "LGPL-2.1-only",
    "gnu lesser general public license version 3 29 june 2007": "LGPL-3.0-only",
    "gnu affero general public license version 3 19 november 2007": "AGPL-3.0-only",
    "mozilla public license version 2.0": "MPL-2.0",
    "eclipse public license v 2.0": "EPL-2.0",
    "boost software license version 1.0 august 17th 2003": "BSL-1.0",
    "cc0 1.0 universal": "CC0-1.0",
    "the mit license mit": "MIT",
    "mit license": "MIT",
    "the mit license": "MIT",
    "isc license": "ISC",
    "bsd 2-clause license": "BSD-2-Clause",
    "bsd 3-clause license": "BSD-3-Clause",
}

#: Further sentences, as the readings really cut unmodified texts.
WHOLE_SENTENCES = {
    **{title: f"{name}-Title" for title, name in TITLES.items()},
    **{f"spdx-license-identifier {name.lower()}": f"{name}-Tag" for name in SPDX},
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiability",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdWarranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "this source code form is subject to the terms of the mozilla public license v": "MplTerms",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "MplCopy",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "distributed under the boost software license version 1.0": "BoostRef",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third-parties to whom the software is furnished to do so all subject to the following": "BoostGrant",
    "this is free and unencumbered software released into the public domain": "UnlicenseDomain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means": "UnlicenseGrant",
    "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work": "Cc0Waiver",
    **{f"this {what} is free software": "GnuFree" for what in ("program", "library")},
    **{f"this {what} is distributed in the hope that it will be useful but without any warranty": "GnuHope" for what in ("program", "library")},
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GnuNoWarranty",
    **{f"see the gnu {name} public license for more details": f"{spdx.capitalize()}See" for name, spdx, _ in _GNU[1:]},
    **{f"you can redistribute it and or modify it under the terms of the gnu {name} public license as published by the free software foundation": f"{spdx.capitalize()}Terms" for name, spdx, _ in _GNU},
    **{f"you can redistribute it and or modify it under the terms of the gnu {name} public license as published by the free software foundation either version {v} of the license or at your option any later version": f"{spdx.capitalize()}Later{v}" for name, spdx, versions in _GNU for v in versions},
    **{f"you can redistribute it and or modify it under the terms of the gnu {name} public license version {v} as published by the free software foundation": f"{spdx.capitalize()}Only{v}" for name, spdx, versions in _GNU for v in versions},
    **{f"either version {v} of the license or at your option any later version": f"GnuLater{v}" for v in ("2", "2.1", "3")},
    **{f"version {v} of the license": f"GnuOnly{v}" for v in ("2", "2.1", "3")},
    **{f"this work is licensed under a creative commons {name} 4.0 international license": f"Cc{spdx.title().replace('-', '')}Work4" for name, spdx in _CC.items()},
}


def _gnu_rules() -> list[tuple[list[str], str]]:
    rules = []
    for _, spdx, versions in _GNU:
        kind = spdx.capitalize()
        for v in versions:
            number = v if "." in v else f"{v}.0"
            for way, name in (("Later", f"{spdx}-{number}-or-later"), ("Only", f"{spdx}-{number}-only")):
                rules += [([f"{kind}Terms", f"Gnu{way}{v}"], name), ([f"{kind}{way}{v}"], name)]
    return rules


#: The rules of these sentences. A notice's first clauses name its license, so that one whose later
#: sentences were altered is still found.
WHOLE_RULES = [
    *_gnu_rules(),
    (["IscGrant"], "ISC"),
    (["MplTerms", "MplCopy"], "MPL-2.0"),
    (["ZlibGrant"], "Zlib"),
    (["BoostRef"], "BSL-1.0"),
    (["BoostGrant"], "BSL-1.0"),
    (["UnlicenseDomain", "UnlicenseGrant"], "Unlicense"),
    (["UnlicenseDomain"], "Unlicense"),
    (["Cc0Waiver"], "CC0-1.0"),
    *[([f"Cc{spdx.title().replace('-', '')}Work4"], f"CC-{spdx}-4.0") for spdx in _CC.values()],
    *[([f"{name}-Title"], name) for name in dict.fromkeys(TITLES.values())],
    *[([f"{name}-Tag"], name) for name in SPDX],
]

#: A rule that contains another's whole sequence stands for it, and so does a notice that says more than a title.
COVERS = {"BSD-3-Clause": ["BSD-2-Clause"], **{f"{name}-or-later": [f"{name}-only"] for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}}

#: An SPDX tag, whose colon ends no sentence.
TAG = r"spdx-license-identifier[ \t]*:[ \t]*"
#: An address, up to white space.
_ADDRESS = r"https?://[^ \t\r\f\n]*"
#: What ends a sentence: end marks before white space or the text's end, and a line of blanks and comment signs only
#: (after a title or a name), each with an address that follows; an address after white space or an opening sign; and
#: a line that begins with an SPDX tag.
_ENDS = r"[.!?;:]+(?:[ \t\r\f\n]+|$)|\n[ \t\r\f#*/;-]*\n"
_ALONE = rf"|(?:^|[ \t\r\f\n(<\"']){_ADDRESS}"
ENDS = rf"(?:{_ENDS})(?:{_ADDRESS})?{_ALONE}"
#: The same and, in the reading by lines, a line's end.
LINE_ENDS = rf"(?:{_ENDS}|\n)(?:{_ADDRESS})?{_ALONE}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER = r"[^a-z0-9.+-]+"
OUTER = r"^[ .-]+|[ .-]+$"


def anchors(sentences: Iterable[str]) -> list[str]:
    """Few words of which every sentence has one: the one that most of the sentences still without one have, and so on."""
    left, out = {frozenset(w for w in s.split() if w.replace("-", "").isalpha()) for s in sentences}, []
    while left:
        seen = Counter(w for s in left for w in s)
        # Of equally good words the longer one is the rarer one in other texts.
        out.append(max(seen, key=lambda w: (seen[w] if len(w) > 6 else 0, len(w), w)))
        left = {s for s in left if out[-1] not in s}
    return sorted(w for w in out if not any(x in w for x in out if x != w))


ANCHORS = "|".join(anchors(SENTENCES | WHOLE_SENTENCES))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_sentences (known ones), sentence_ids, licenses.

    The last two are comma-joined, identifiers in the text's order and licenses
    in that of the rules. Null or empty text, or one without a known sentence:
    zero and empty strings. Repeated rows are each returned; empty table: empty
    result. The whole text of a GNU license also holds the notice it proposes,
    and is named by that ("or later").
    """
    d = exact(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER).alias("low"))
    sentences = SENTENCES | WHOLE_SENTENCES
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    # Only sentences as long as a known one may be known; the rest are not looked up.
    shortest = min(map(len, sentences))

    def ids(ends: str):
        normal = F.transform(F.split("told", ends), lambda s: F.regexp_replace(F.regexp_replace(s, OTHER, " "), OUTER, ""))
        return F.filter(F.transform(F.filter(normal, lambda s: F.length(s) >= shortest), lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull())

    none = F.expr("cast(array() as array<string>)")
    told = d.select("doc_id", "low", F.regexp_replace("low", TAG, "\nspdx-license-identifier ").alias("told"))
    anchored = functools.reduce(lambda a, b: a | b, [F.contains(F.col("low"), F.lit(w)) for w in ANCHORS.split("|")])
    read = told.select("doc_id", F.when(anchored, F.struct(ids(ENDS).alias("wrapped"), ids(LINE_ENDS).alias("lines"))).alias("r"))
    found = read.select("doc_id", F.when(F.col("r").isNull(), none).when(F.size("r.wrapped") >= F.size("r.lines"), F.col("r.wrapped")).otherwise(F.col("r.lines")).alias("ids"))
    line = F.concat(F.lit(","), F.concat_ws(",", "ids"), F.lit(","))
    rules = F.array(*[F.struct(F.lit("," + ",".join(seq) + ",").alias("sequence"), F.lit(name).alias("license")) for seq, name in RULES + WHOLE_RULES])
    held = F.array_distinct(F.transform(F.filter(rules, lambda r: F.contains(F.col("line"), r["sequence"])), lambda r: r["license"]))
    covers = F.array(*[F.struct(F.lit(name).alias("more"), F.array(*map(F.lit, less)).alias("less")) for name, less in COVERS.items()])
    # As a bound variable what holds is computed once, however often it is asked.
    held = F.element_at(F.transform(F.array(held), lambda h: F.filter(h, lambda x: ~F.exists(covers, lambda c: F.array_contains(h, c["more"]) & F.array_contains(c["less"], x)))), 1)
    held = F.when(F.size("ids") > 0, held).otherwise(none)
    named = found.withColumn("line", line)
    return named.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.concat_ws(",", "ids").alias("sentence_ids"), F.concat_ws(",", held).alias("licenses"))
