"""Licence recognition by sentence rules, in DataFrame functions only.

Texts are normalised and known licence sentences looked up in them, also where these are wrapped
over lines, in comments, or have ; or : inside. A sentence may have a slot for a holder's name. The identifiers
found in a document, in order, are matched against ordered rules: a rule names a licence and the identifiers that
must occur one after the other, whatever stands between; those that it matches are used up. Nothing is shuffled.

One output row an input row, repeated rows and null ids, too. Null and empty texts have no licences; texts of any
length are read whole. Where two known sentences begin at one place, the longer counts. Other columns are left out,
so names can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import text_column

#: Known sentences, normalised, by identifier. A sentence is lower case, its punctuation gone.
SENTENCES = {
    "mit-release": "released under the mit license",
    "mit-license": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-paren": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache2-license": "licensed under the apache license version 2 0",
    "apache2-release": "released under the apache license version 2 0",
    "apache2-the-license": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-license": "licensed under the gnu general public license version 3",
    "gpl3-release": "released under the gnu general public license version 3",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "ccbync4-license": "licensed under cc by nc 4 0",
    "ccbync4-work": "this work is licensed under cc by nc 4 0",
    "ccby4-license": "licensed under cc by 4 0",
    "ccby4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4-license": "licensed under cc by sa 4 0",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "all-rights": "all rights reserved",
    "apache2-text": "apache license version 2 0 january 2004",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "gpl2-text": "gnu general public license version 2 june 1991",
    "gpl3-text": "gnu general public license version 3 29 june 2007",
    "agpl3-text": "gnu affero general public license version 3 19 november 2007",
    "lgpl21-text": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-text": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl2-text": "mozilla public license version 2 0",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2-copy-https": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-free": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "bsl-text": "boost software license version 1 0",
    "bsl-release": "distributed under the boost software license version 1 0",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "cc0-dedicated": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0-text": "cc0 1 0 universal",
    "wtfpl-text": "do what the fuck you want to public license",
}
#: SPDX identifiers of licences that a tag line may name.
TAGS = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense WTFPL Zlib".split()
#: The names of Creative Commons licences by the middle of their identifiers.
COMMONS = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}


def _plain(name: str) -> str:
    return re.sub("[^a-z0-9]+", " ", name.lower())


SENTENCES |= {f"spdx-{t}": f"spdx license identifier {_plain(t)}" for t in TAGS}
SENTENCES |= {f"cc-{k}-{v}": f"this work is licensed under a creative commons {name} {_plain(v)} {where} license" for k, name in COMMONS.items() for v, where in (("4.0", "international"), ("3.0", "unported")) if (k, v) != ("BY", "4.0")}
#: Rules in order: licence, and identifiers that must occur in this order. A rule's identifiers are used up by it.
RULES = (
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice")),
    ("MIT", ("mit-title-paren", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-release",)),
    ("MIT", ("mit-license",)),
    ("Apache-2.0", ("apache2-the-license", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-license",)),
    ("Apache-2.0", ("apache2-release",)),
    ("Apache-2.0", ("apache2-the-license",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-only", ("gpl3-license",)),
    ("GPL-3.0-only", ("gpl3-release",)),
    ("GPL-3.0-or-later", ("gpl-redistribute",)),
    ("GPL-2.0-or-later", ("gpl2-redistribute",)),
    ("CC-BY-NC-4.0", ("ccbync4-license",)),
    ("CC-BY-NC-4.0", ("ccbync4-work",)),
    ("CC-BY-4.0", ("ccby4-license",)),
    ("CC-BY-4.0", ("ccby4-work",)),
    ("CC-BY-SA-4.0", ("ccbysa4-license",)),
    ("Apache-2.0", ("apache2-text",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("GPL-3.0-only", ("gpl3-only",)),
    ("LGPL-3.0-only", ("lgpl3-text",)),
    ("LGPL-2.1-only", ("lgpl21-text",)),
    ("AGPL-3.0-only", ("agpl3-text",)),
    ("GPL-2.0-only", ("gpl2-text",)),
    ("GPL-3.0-only", ("gpl3-text",)),
    ("AGPL-3.0-or-later", ("agpl3-redistribute",)),
    ("LGPL-2.1-or-later", ("lgpl21-redistribute",)),
    ("LGPL-3.0-or-later", ("lgpl3-redistribute",)),
    ("LGPL-3.0-or-later", ("lgpl3-program",)),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy-https")),
    ("MPL-2.0", ("mpl2-text",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-warranty", "zlib-grant", "zlib-origin")),
    ("Unlicense", ("unlicense-domain", "unlicense-free")),
    ("BSL-1.0", ("bsl-text", "bsl-grant")),
    ("BSL-1.0", ("bsl-release",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("CC0-1.0", ("cc0-text",)),
    ("WTFPL", ("wtfpl-text",)),
    *((t, (f"spdx-{t}",)) for t in TAGS),
    *((f"CC-{k.removeprefix('cc-')}", (k,)) for k in SENTENCES if k.startswith("cc-")),
    ("LicenseRef-all-rights-reserved", ("all-rights",)),
)
#: What a slot takes in: one to eight words.
SLOT = r"(?:[^ \n\f]+[ \n]){0,7}[^ \n\f]+"
#: A piece ends at a line's end, or at . ! ? ; : before white space. A known sentence may span pieces: see marked().
SENTENCE_END = "(?<=[.!?;:])\\s+|\\n+"


def marked(text: Column) -> Column:
    """Normalised words with a space between them, a line feed where a sentence may end and a form feed where it does.

    Sentences end at . ! ? before white space and at blank lines; they may end at a line's end, at ; and :
    before white space and after a list's marker. Comment prefixes go. Each text begins and ends with a mark.
    """
    out = F.lower(F.translate(text, "\f\r", "  "))
    out = F.regexp_replace(out, "(?m)^[ \\t]*(?:dnl|@?rem)[ \\t]", " ")
    out = F.regexp_replace(out, "(?m)^([^\\p{L}\\p{N}\\n]*[0-9a-z]{1,3}\\))\\s", "$1\n")
    out = F.regexp_replace(out, "(?<=[.!?])\\s+|\\n[ \\t]*\\n", "\f")
    out = F.regexp_replace(out, "(?<=[;:])\\s+", "\n")
    out = F.regexp_replace(F.concat(F.lit("\f"), out, F.lit("\f")), "[^\\p{L}\\p{N}\\n\\f]+", " ")
    out = F.regexp_replace(out, "[ \\n]*\\f[ \\n\\f]*", "\f")
    return F.regexp_replace(out, " ?\\n[ \\n]*", "\n")


def known_sentences(text: Column, known: dict[str, str]) -> Column:
    """The known sentences in order, longest first where two begin at one place, whatever lines they are wrapped over; {} for what a slot took in."""
    words = [r"[ \n]".join(SLOT if w == "{}" else re.escape(w) for w in s.split(" ")) for s in sorted(known.values(), key=len, reverse=True)]
    # the pattern's end may take a slot's last word for a mark's neighbour, so both ends stand at marks
    found = F.transform(F.regexp_extract_all(marked(text), F.lit(rf"(?<=[\n\f])(?:{'|'.join(words)})(?=[\n\f])"), F.lit(0)), lambda s: F.translate(s, "\n", " "))
    for s in (s for s in known.values() if "{}" in s):
        before, after = s.split("{}")
        found = F.transform(found, lambda x: F.when(x.startswith(before) & x.endswith(after), F.lit(s)).otherwise(x))  # noqa: B023
    return found


def match_rules(identifiers: Column, rules: tuple = RULES) -> Column:
    """Sorted distinct licences of the rules that match, in the rules' order, each on what earlier ones left over."""
    rest = F.concat(F.lit(","), F.array_join(identifiers, ",,"), F.lit(","))
    hits = []
    for licence, ids in rules:
        pattern = "(.*)".join(f",{re.escape(name)}," for name in ids)
        hits.append(F.when(rest.rlike(pattern), F.lit(licence)))
        rest = F.regexp_replace(rest, pattern, "".join(f"${k}" for k in range(1, len(ids))))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))


def recognise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """doc id, sentence_ids (known sentences in order), licenses (sorted, each once), n_sentences (pieces by SENTENCE_END) of each row.

    The known sentences are a constant of this module, a few kB, and so are looked up without a shuffle.
    """
    by_text = {s: k for k, s in known.items()}
    lookup = F.create_map(*[F.lit(x) for pair in by_text.items() for x in pair])
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_column(docs, text_col).alias("_text"))
    counted = F.size(F.filter(F.split("_text", SENTENCE_END), lambda s: F.trim(s) != "")).cast("long")
    rows = rows.select(id_col, counted.alias("n_sentences"), F.transform(known_sentences(F.col("_text"), known), lambda s: F.element_at(lookup, s)).alias("sentence_ids"))
    none = F.array().cast("array<string>")
    licenses = F.when(F.size("sentence_ids") > 0, match_rules(F.col("sentence_ids"), rules)).otherwise(none)
    return rows.select(id_col, "n_sentences", "sentence_ids", licenses.alias("licenses"))
