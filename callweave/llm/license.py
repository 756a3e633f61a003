"""Licence recognition by sentences and ordered rules, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, normalised as sentence() does; the place in the list is the identifier. Fixed values.
SENTENCES = [
    "licensed under the apache license version 2 0",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "see the license for the specific language governing permissions and limitations under the license",
    "released under the mit license",
    "licensed under the mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "licensed under cc by nc 4 0",
    "licensed under cc by 4 0",
    "licensed under cc by sa 4 0",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "this work is licensed under the gnu general public license version 3",
    "this work is licensed under the gnu general public license version 2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "see the gnu general public license for more details",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "all rights reserved",
    "this is free and unencumbered software released into the public domain",
    "licensed under the apache license version 2 0 the license",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "see the gnu lesser general public license for more details",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "see the gnu affero general public license for more details",
    "this source code form is subject to the terms of the mozilla public license v",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "licensed under the eclipse public license version 2 0",
]
#: Licence -> ordered sentence identifiers that must follow each other among a text's known sentences. Fixed values.
RULES = {
    "Apache-2.0": [[0], [24], [1, 2, 3, 4]],
    "MIT": [[5], [6], [7, 8]],
    "CC-BY-NC-4.0": [[9]],
    "CC-BY-4.0": [[10], [12]],
    "CC-BY-SA-4.0": [[11]],
    "GPL-3.0": [[13], [15, 16, 17]],
    "GPL-2.0": [[14], [25, 16, 17], [37, 16, 17]],
    "LGPL-2.1": [[26, 28, 29], [26, 16, 29]],
    "LGPL-3.0": [[27, 28, 29]],
    "AGPL-3.0": [[30, 16, 31]],
    "MPL-2.0": [[32]],
    "ISC": [[33]],
    "0BSD": [[34]],
    "Zlib": [[35]],
    "BSL-1.0": [[36]],
    "EPL-2.0": [[38]],
    "BSD-3-Clause": [[18, 19, 20, 21]],
    "BSD-2-Clause": [[18, 19, 20]],
    "Proprietary": [[22]],
    "Unlicense": [[23]],
}
#: Every known sentence holds one of these words; others need no normalising. Fixed values.
ANCHORS = "licen|permission|copyright|rights reserved|free software|redistribut|public domain|warranty"


def sentence(s: Column) -> Column:
    """Lower-case ASCII letters and digits, all else one blank."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


#: Ends of sentences: a line's end, or . ! ? ; : before white space; and of paragraphs' sentences, which may run across
#: lines, ; and : but not across a blank line.
LINES, PARAGRAPHS = r"[\r\n]+|(?<=[.!?;:])[ \t]+", r"(?>\r\n|\r|\n)[ \t]*(?>\r\n|\r|\n)\s*|(?<=[.!?])\s+"


def sentence_ids(text: Column, ends: str = LINES) -> Column:
    """Identifiers of the known sentences of a whole text, in order."""
    known = F.create_map(*[x for i, s in enumerate(SENTENCES) for x in (F.lit(s), F.lit(i))])
    parts = F.filter(F.split(text, ends), lambda s: s.rlike(f"(?i){ANCHORS}"))
    found = F.filter(F.transform(parts, lambda s: F.try_element_at(known, sentence(s))), lambda i: i.isNotNull())
    return F.when(text.rlike(f"(?i){ANCHORS}"), found).otherwise(F.array().cast("array<int>"))


def _line(q: list[int]) -> str:
    return "," + ",".join(map(str, q)) + ","


def _longer(q: list[int]) -> list[str]:
    """The sequences of any rule that hold q and more, longest first: what they match isn't q's."""
    return [_line(p) for p in sorted((p for seqs in RULES.values() for p in seqs if len(p) > len(q) and _line(q) in _line(p)), key=len, reverse=True)]


def licenses(ids: Column) -> Column:
    """Sorted names of the licences one of whose sentence sequences occurs, unbroken, in ids, and not only as a part of a
    longer rule's."""
    line = F.concat(F.lit(","), F.array_join(ids.cast("array<string>"), ","), F.lit(","))
    left = lambda q: reduce(lambda x, p: F.replace(x, F.lit(p), F.lit(",")), _longer(q), line)
    hit = lambda seqs: reduce(or_, [left(q).contains(_line(q)) for q in seqs])
    return F.array_compact(F.array(*[F.when(hit(seqs), F.lit(name)) for name, seqs in sorted(RULES.items())]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, sentence_ids, licenses (arrays, empty if none), n_licenses. Rules are matched to the
    sentences of the lines as they stand, of the text with wrapped lines joined, and of its paragraphs; sentence_ids are
    the most of these, the earlier on a tie. The SQL knows the first two only. A row-wise plan with no shuffle; null and
    empty texts have none, repeated rows stay, other columns are left out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select("doc_id", sentence_ids(text).alias("a"), sentence_ids(F.regexp_replace(text, r"[\r\n]+", " ")).alias("b"), sentence_ids(text, PARAGRAPHS).alias("c"))
    names = F.array_union(F.array_union(licenses(F.col("a")), licenses(F.col("b"))), licenses(F.col("c")))
    most = F.when((F.size("c") > F.size("a")) & (F.size("c") > F.size("b")), F.col("c")).when(F.size("b") > F.size("a"), F.col("b")).otherwise(F.col("a"))
    out = each.select(
        "doc_id", most.alias("sentence_ids"),
        F.when(F.size("a") + F.size("b") + F.size("c") > 0, F.array_sort(names)).otherwise(F.array().cast("array<string>")).alias("licenses"),
    )
    return out.withColumn("n_licenses", F.size("licenses"))


def oracle() -> str:
    """DuckDB SQL for scan_licenses over documents, arrays joined with commas."""
    known = "MAP {" + ", ".join(f"'{s}': {i}" for i, s in enumerate(SENTENCES)) + "}"
    ids = lambda t: f"list_filter(list_transform(string_split({t}, chr(31)), lambda s: {known}[trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))]), lambda i: i IS NOT NULL)"
    hits = lambda line: "[" + ", ".join("CASE WHEN " + " OR ".join(f"contains({reduce(lambda x, p: f"replace({x}, '{p}', ',')", _longer(q), line)}, '{_line(q)}')" for q in seqs) + f" THEN '{name}' END" for name, seqs in sorted(RULES.items())) + "]"
    return f"""
    WITH raw AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    marked AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([.!?;:])[ \\t]+', '\\1' || chr(31), 'g'), '[\\r\\n]+', chr(31), 'g') AS t,
      regexp_replace(regexp_replace(t, '[\\r\\n]+', ' ', 'g'), '([.!?;:])[ \\t]+', '\\1' || chr(31), 'g') AS u FROM raw),
    ids AS (SELECT doc_id, {ids("t")} AS a, {ids("u")} AS b FROM marked),
    lines AS (SELECT doc_id, a, b, ',' || array_to_string(a, ',') || ',' AS la, ',' || array_to_string(b, ',') || ',' AS lb FROM ids),
    named AS (SELECT doc_id, CASE WHEN len(b) > len(a) THEN b ELSE a END AS ids, list_sort(list_distinct(list_filter(list_concat({hits("la")}, {hits("lb")}), lambda x: x IS NOT NULL))) AS names FROM lines)
    SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(names, ',') AS licenses, CAST(len(names) AS INTEGER) AS n_licenses FROM named"""
