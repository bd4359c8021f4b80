"""License recognition by sentences: known sentences become identifiers, ordered rules match identifier sequences.

A text is unwrapped (a line that goes on in lower case joins the one before), cut into sentences, and each sentence is
normalised (lower case, runs of other than letters and digits to one space). Known sentences map to identifiers; the
identifiers in order of appearance, others left out, are matched against each rule's sequence, which must appear without
gaps. All of it is built from SQL functions on one row, without a shuffle.

Defined results: a null or empty text has no identifiers and no licenses; a sentence that repeats is listed each time, a
license once, in order of the rules; rows are judged one by one, repeated rows alike; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Sentences of well-known public license texts and notices, with the identifiers given to them.
SENTENCES = {
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT."],
    "mit-title": ["MIT License.", "The MIT License (MIT).", "The MIT License."],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-keep": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "apache-notice": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', "SPDX-License-Identifier: Apache-2.0."],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-as-is": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only."],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-details": ["See the GNU General Public License for more details."],
    "cc-by-nc-notice": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-notice": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-notice": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-notice": ["Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: A license and an ordered sequence of identifiers that shows it. Later rules are the more general ones.
RULES = [
    ("MIT", ("mit-grant", "mit-keep", "as-is")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("MIT", ("mit-notice",)),
    ("Apache-2.0", ("apache-notice", "apache-comply", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0", ("gpl-free",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("Unlicense", ("unlicense",)),
]

_CUT = "\x1e"


def norm(sentence: str) -> str:
    """The form in which sentences are compared; the same as the SQL below makes."""
    import re

    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def known() -> list[tuple[str, str]]:
    """(normalised sentence, identifier). Known sentences are cut as texts are, and the longest piece stands for the whole."""
    import re

    found = []
    for key, forms in SENTENCES.items():
        for form in forms:
            pieces = [p for p in re.split(r"(?<=[.!?;])\s+", form) if norm(p)]
            found += [(max(map(norm, pieces), key=len), key)]
    return list(dict(found).items())


def sentences(text: Column) -> Column:
    """Normalised sentences in order."""
    unwrapped = F.regexp_replace(text, r"[ \t]*\r?\n[ \t]*([a-z(])", " $1")
    cut = F.regexp_replace(unwrapped, r"([.!?;])\s+", f"$1{_CUT}")
    cut = F.regexp_replace(F.lower(cut), r"[\r\n]+", _CUT)
    cut = F.regexp_replace(cut, f"[^a-z0-9{_CUT}]+", " ")
    return F.transform(F.split(cut, _CUT), lambda s: F.trim(s))


def recognise(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add sentence_ids array<string> and licenses array<string>; columns of these names are replaced."""
    table = known()
    held = F.filter(sentences(F.coalesce(F.col(text), F.lit(""))), lambda s: s.isin([s for s, _ in table]))
    to_id = F.create_map(*[F.lit(x) for pair in table for x in pair])
    out = docs.withColumn("sentence_ids", F.transform(held, lambda s: to_id[s]))
    line = F.concat(F.lit("|"), F.array_join("sentence_ids", "|"), F.lit("|"))
    hits = [F.when(line.contains("|" + "|".join(ids) + "|"), F.lit(name)) for name, ids in RULES]
    return out.withColumn("licenses", F.array_distinct(F.array_compact(F.array(*hits))))


def op2(spark, sf_dir):
    found = recognise(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_known"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    values = ", ".join(f"('{s}', '{k}')" for s, k in known())
    cases = " || ".join(f"CASE WHEN contains(line, '|{'|'.join(ids)}|') THEN '{name},' ELSE '' END" for name, ids in RULES)
    return f"""
WITH known(sentence, id) AS (VALUES {values}),
cut AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_replace(regexp_replace(lower(
      regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t]*\\r?\\n[ \\t]*([a-z(])', ' \\1', 'g'), '([.!?;])\\s+', '\\1' || chr(30), 'g')
    ), '[\\r\\n]+', chr(30), 'g'), '[^a-z0-9\\x1e]+', ' ', 'g') AS t
  FROM documents
), pieces AS (
  SELECT r, p.i, trim(p.s, ' ') AS sentence
  FROM cut, LATERAL (SELECT unnest(string_split(t, chr(30))) AS s, generate_subscripts(string_split(t, chr(30)), 1) AS i) p
), ids AS (
  SELECT r, list(id ORDER BY i) AS ids FROM pieces JOIN known USING (sentence) GROUP BY r
), lines AS (
  SELECT doc_id, coalesce(ids, []) AS ids, '|' || coalesce(array_to_string(ids, '|'), '') || '|' AS line FROM cut LEFT JOIN ids USING (r)
), found AS (
  SELECT *, string_split(rtrim({cases}, ','), ',') AS names FROM lines
)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  array_to_string(list_filter(names, lambda x, i: x <> '' AND list_position(names, x) = i), ',') AS licenses
FROM found
"""


SQL = _sql()
