"""Licence recognition by sentence rules, with DataFrame expressions only.

A text is cut into sentences, each sentence is normalised and looked up in a dictionary of licence sentences, and the
sequence of their identifiers is matched against ordered rules: a rule's identifiers must follow each other in the text with
no other licence sentence between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence names after normalisation, by SPDX identifier (fixed values)
NAMES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"],
    "MIT": ["mit license", "mit"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license", "2 clause bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license", "3 clause bsd license"],
    "ISC": ["isc license"],
    "GPL-2.0": ["gnu general public license version 2", "gnu gpl version 2", "gpl v2", "gplv2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu gpl version 3", "gpl v3", "gplv3"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "lgpl v2 1", "lgplv2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl v3", "lgplv3"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl v3", "agplv3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mpl 2 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0"],
    "CC0-1.0": ["cc0 1 0 universal", "cc0 1 0", "cc0"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
    "Unlicense": ["unlicense"],
}
# How a text says that it is under a named licence, after normalisation (fixed values)
LEADS = [
    "licensed under", "released under", "distributed under", "available under", "published under", "this work is licensed under", "this work is released under",
    "this project is licensed under", "this software is licensed under", "this file is licensed under", "this program is licensed under", "this code is released under",
]
# Sentences of licence texts and headers, after normalisation, with their identifiers (fixed values)
SENTENCES = {
    "licensed under the apache license version 2 0 the license": "apache-head",
    "you may not use this file except in compliance with the license": "apache-use",
    "you may obtain a copy of the license at": "apache-copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-asis",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this program is free software": "free-head",
    "this library is free software": "free-head",
    "this file is free software": "free-head",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-only-grant",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-grant",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl-grant",
    "either version 2 of the license or at your option any later version": "v2-later",
    "either version 2 1 of the license or at your option any later version": "v21-later",
    "either version 3 of the license or at your option any later version": "v3-later",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-form",
    "this is free and unencumbered software released into the public domain": "unlicense-head",
}
# Ordered rules over identifiers, longer ones first (fixed values)
RULES = [
    ("Apache-2.0", ["apache-head", "apache-use", "apache-copy", "apache-asis", "apache-see"]),
    ("Apache-2.0", ["apache-head", "apache-use"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("GPL-2.0-or-later", ["free-head", "gpl-grant", "v2-later"]),
    ("GPL-3.0-or-later", ["free-head", "gpl-grant", "v3-later"]),
    ("GPL-2.0-only", ["free-head", "gpl2-only-grant"]),
    ("LGPL-2.1-or-later", ["free-head", "lgpl-grant", "v21-later"]),
    ("LGPL-3.0-or-later", ["free-head", "lgpl-grant", "v3-later"]),
    ("AGPL-3.0-or-later", ["free-head", "agpl-grant", "v3-later"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("Unlicense", ["unlicense-head"]),
]
#: Each dictionary sentence contains one of these, so a text without them has no licence sentence.
CUES = r"license|under|permission|copyright|redistribut|warranty|unencumbered|free software"
#: Identifiers with these endings are licences of their own (fixed values).
VERSIONED = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
ENDINGS = ("-only", "-or-later")


def _spdx() -> list[str]:
    return [*NAMES, *[name + ending for name in VERSIONED for ending in ENDINGS]]


def dictionary() -> dict[str, str]:
    """Normalised sentence -> identifier: the fixed sentences, every lead with every name, with and without "the", and SPDX lines."""
    out = dict(SENTENCES)
    for spdx, names in NAMES.items():
        for name in names:
            for lead in LEADS:
                for the in ("", "the "):
                    out.setdefault(f"{lead} {the}{name}", f"named:{spdx}")
    for spdx in _spdx():
        out.setdefault("spdx license identifier " + spdx.lower().replace("-", " ").replace(".", " "), f"named:{spdx}")
    # sentences that go on with a version after a comma instead of a cut
    for grant in ("gpl-grant", "lgpl-grant", "agpl-grant"):
        for version in ("v2-later", "v21-later", "v3-later"):
            first, then = (next(s for s, name in SENTENCES.items() if name == x) for x in (grant, version))
            out.setdefault(f"{first} {then}", f"{grant} {version}")
    return out


def rules() -> list[tuple[str, list[str]]]:
    return [*RULES, *[(spdx, [f"named:{spdx}"]) for spdx in _spdx()]]


def normalised(sentence: Column) -> Column:
    """Lower case; every run of other characters than a-z and 0-9 is one blank; trimmed."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


#: What looks like the end of a sentence and is none: the colon of an SPDX line, the dot of "v. 2" (patterns; same in check SQL).
JOINED = ((r"(?i)(spdx-license-identifier):[ \t]+", "$1 "), (r"\b([vV])\.\s+([0-9])", "$1 $2"))


def _sentences(text: Column) -> Column:
    """Cut after . ; : ? ! before white space, and at empty lines."""
    cut = F.regexp_replace(text, r"\r\n?", "\n")
    for pattern, new in JOINED:
        cut = F.regexp_replace(cut, pattern, new)
    return F.split(F.regexp_replace(F.regexp_replace(cut, r"([.;:!?])\s+", "$1\u0001"), r"\n\s*\n", "\u0001"), "\u0001", -1)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, licenses`` of every row: a projection, without a shuffle or a join.

    ``sentence_ids`` are the licence sentences in the order of the text, blank-separated, ``n_sentences`` their number, and
    ``licenses`` the licences whose rules match, sorted and comma-separated. A sentence may be wrapped over lines; where the whole is no
    licence sentence, each of its lines is looked up, so that one without a full stop before other text is found too. A null, empty or
    unlicensed text has no sentences and empty strings; repeated rows come out once each.
    """
    # one branch for each identifier over its own short list of sentences, read from left to right
    groups: dict[str, list[str]] = {}
    for sentence, name in dictionary().items():
        groups.setdefault(name, []).append(sentence)

    def identifier(s: Column) -> Column:
        chain = None
        for name, own in groups.items():
            chain = F.when(s.isin(own), name) if chain is None else chain.when(s.isin(own), name)
        return chain

    found = lambda sentences: F.transform(F.transform(sentences, normalised), identifier)
    cued = lambda sentences: F.filter(sentences, lambda s: F.lower(s).rlike(CUES))

    def with_lines(s: Column, name: Column) -> Column:
        lines = F.when(F.contains(s, F.lit("\n")), F.array_compact(found(cued(F.split(s, "\n", -1))))).otherwise(F.array().cast("array<string>"))
        return F.when(name.isNotNull(), F.array(name)).otherwise(lines)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    none = F.array().cast("array<string>")
    # only sentences with a cue are normalised and looked up
    rows = rows.withColumn("cued", F.when(F.lower("text").rlike(CUES), cued(_sentences(F.col("text")))).otherwise(none))
    rows = rows.select("doc_id", "cued", found(F.col("cued")).alias("names"))
    ids = F.flatten(F.zip_with("cued", "names", with_lines))
    line = F.array_join(ids, " ")
    rows = rows.select("doc_id", line.alias("sentence_ids"))
    line = F.concat(F.lit(" "), "sentence_ids", F.lit(" "))
    hits = []
    for spdx, order in rules():
        test = F.contains(line, F.lit(" " + " ".join(order) + " "))
        if spdx == "BSD-2-Clause":  # a longer rule with the same start goes first
            test = test & ~F.contains(line, F.lit(" bsd-grant bsd-source bsd-binary bsd-endorse "))
        hits.append(F.when(test, F.lit(spdx)))
    found_all = F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))
    n = F.when(F.col("sentence_ids") == "", 0).otherwise(F.size(F.split("sentence_ids", " ")))
    return rows.select("doc_id", n.cast("long").alias("n_sentences"), "sentence_ids", F.array_join(found_all, ",").alias("licenses"))
