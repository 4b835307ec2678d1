"""Operator 9, licence scans, in DataFrame functions only.

A text is cut into lines and after full stops and normalised (lower case,
letters, digits and dots of versions kept, all else one space). A known licence
sentence is a whole line or several lines that it is wrapped over, with no blank
line or full stop inside; at a place the longest counts. The
identifiers found, in the text's order, are matched against ordered rules: a
rule is a sequence of identifiers that must appear in a row; at a place the
first rule of the table that matches wins, and longer rules stand before the
shorter ones they contain.

Defined cases: null and empty texts, and texts without a known sentence, give
no licences (n_sentences 0, licences empty); a sentence is known only as a
whole, so a licence's name inside other prose is not reported; repeated
sentences count each time, and licences lists each one once in order of first
match; repeated rows are reported each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences, normalised, and their identifiers.
SENTENCES = {
    "this work is licensed under the gnu general public license version 3": "gpl3-work",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-terms",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "released under the mit license": "mit-name",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-grant",
    "the software is provided as is without warranty of any kind": "as-is",
    "licensed under cc by nc 4.0": "ccbync4-name",
    "licensed under cc by 4.0": "ccby4-name",
    "licensed under cc by sa 4.0": "ccbysa4-name",
    "licensed under the apache license version 2.0": "apache2-name",
    "licensed under the apache license version 2.0 the license": "apache2-name",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "all rights reserved": "reserved",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-terms",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl21-terms",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-terms",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license": "apache2-header",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-terms",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under the mit license": "mit-name",
    "this project is licensed under the mit license": "mit-name",
    "this software is released under the mit license": "mit-name",
    "distributed under the mit license": "mit-name",
    "spdx license identifier mit": "mit-name",
    "licensed under the bsd 2 clause license": "bsd2-name",
    "spdx license identifier bsd 2 clause": "bsd2-name",
    "licensed under the bsd 3 clause license": "bsd3-name",
    "spdx license identifier bsd 3 clause": "bsd3-name",
    "spdx license identifier apache 2.0": "apache2-name",
    "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache2-header",
    "licensed under the mozilla public license 2.0": "mpl2-name",
    "licensed under the mozilla public license version 2.0": "mpl2-name",
    "spdx license identifier mpl 2.0": "mpl2-name",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "mpl2-terms",
    "licensed under the gnu general public license version 2": "gpl2-name",
    "spdx license identifier gpl 2.0 only": "gpl2-name",
    "spdx license identifier gpl 2.0 or later": "gpl2-later",
    "licensed under the gnu general public license version 3": "gpl3-work",
    "spdx license identifier gpl 3.0 only": "gpl3-work",
    "spdx license identifier gpl 3.0 or later": "gpl3-terms",
    "licensed under the gnu lesser general public license version 2.1": "lgpl21-name",
    "spdx license identifier lgpl 2.1 only": "lgpl21-name",
    "spdx license identifier lgpl 2.1 or later": "lgpl21-terms",
    "licensed under the gnu lesser general public license version 3": "lgpl3-name",
    "spdx license identifier lgpl 3.0 only": "lgpl3-name",
    "spdx license identifier agpl 3.0 or later": "agpl3-terms",
    "licensed under the isc license": "isc-name",
    "spdx license identifier isc": "isc-name",
    "spdx license identifier unlicense": "unlicense",
    "spdx license identifier cc0 1.0": "cc0-name",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-name",
    "this work is licensed under a creative commons attribution 4.0 international license": "ccby4-name",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "ccbysa4-name",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "ccbync4-name",
}
# Ordered rules, sequences of sentence identifiers and the licence each means.
RULES = (
    (("reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("reserved", "bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("mit-name", "mit-grant", "mit-notice", "as-is"), "MIT"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("mit-grant", "mit-notice", "as-is"), "MIT"),
    (("gpl2-terms", "gpl-hope"), "GPL-2.0-or-later"),
    (("agpl3-terms", "gpl-hope"), "AGPL-3.0-or-later"),
    (("gpl3-terms", "gpl-hope"), "GPL-3.0-or-later"),
    (("apache2-name", "apache2-comply"), "Apache-2.0"),
    (("mit-grant", "as-is"), "MIT"),
    (("mit-name", "mit-grant"), "MIT"),
    (("gpl3-terms",), "GPL-3.0-or-later"),
    (("gpl3-work",), "GPL-3.0-only"),
    (("apache2-name",), "Apache-2.0"),
    (("mit-name",), "MIT"),
    (("mit-grant",), "MIT"),
    (("ccbync4-name",), "CC-BY-NC-4.0"),
    (("ccby4-name",), "CC-BY-4.0"),
    (("ccbysa4-name",), "CC-BY-SA-4.0"),
    (("bsd-grant",), "BSD"),
    (("reserved",), "proprietary"),
    (("gpl2-terms",), "GPL-2.0-or-later"),
    (("lgpl21-terms",), "LGPL-2.1-or-later"),
    (("agpl3-terms",), "AGPL-3.0-or-later"),
    (("apache2-header",), "Apache-2.0"),
    (("isc-grant",), "ISC"),
    (("mpl2-terms",), "MPL-2.0"),
    (("unlicense",), "Unlicense"),
    (("bsd2-name",), "BSD-2-Clause"),
    (("bsd3-name",), "BSD-3-Clause"),
    (("mpl2-name",), "MPL-2.0"),
    (("gpl2-name",), "GPL-2.0-only"),
    (("gpl2-later",), "GPL-2.0-or-later"),
    (("lgpl21-name",), "LGPL-2.1-only"),
    (("lgpl3-name",), "LGPL-3.0-only"),
    (("isc-name",), "ISC"),
    (("cc0-name",), "CC0-1.0"),
)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    # one line end where a sentence may go on, two where it can't
    lines = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?<=\.)\s+", "\n\n"), r"\r\n?", "\n")
    clean = F.regexp_replace(F.regexp_replace(lines, r"\.(?![0-9])|[^a-z0-9.\n]+", " "), " +", " ")
    clean = F.trim(F.regexp_replace(clean, " ?\n ?", "\n"))
    any_of = "|".join(s.replace(".", r"\.").replace(" ", "[ \n]") for s in sorted(SENTENCES, key=len, reverse=True))
    found = F.regexp_extract_all(clean, F.lit(f"(?<![^\n])(?:{any_of})(?![^\n])"), F.lit(0))
    return F.transform(found, lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))


def licences_of(ids: Column) -> Column:
    """Walk the identifiers: at each place the first rule that matches gives its licence and its length is passed over."""
    tail = lambda n: F.concat_ws(" ", F.slice(ids, n + 1, max(len(s) for s, _ in RULES)))
    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, i: Column) -> Column:
        here = F.concat(tail(i), F.lit(" "))
        name, length = F.lit(None).cast("string"), F.lit(1)
        for seq, licence in reversed(RULES):
            hit = here.startswith(" ".join(seq) + " ")
            name, length = F.when(hit, licence).otherwise(name), F.when(hit, len(seq)).otherwise(length)
        taken = acc["skip"] > 0
        return F.struct(
            F.when(taken, acc["skip"] - 1).otherwise(length - 1).alias("skip"),
            F.when(taken | name.isNull() | F.array_contains(acc["found"], F.coalesce(name, F.lit(""))), acc["found"]).otherwise(F.concat(acc["found"], F.array(name))).alias("found"),
        )

    places = F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.size(ids) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda acc: acc["found"])


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, n_sentences and licences of each row."""
    ids = docs.select("doc_id", sentence_ids(F.col("text")).alias("sentence_ids"))
    return ids.withColumns({"n_sentences": F.size("sentence_ids").cast("bigint"), "licences": licences_of(F.col("sentence_ids"))})
