"""License scans by sentence rules, with DataFrame functions only.

Sentences are cut after `.`, `!`, `?` and white space (not in `v. 2`) and at blank lines (not before an address).
A single line end, with comment marks around it, may begin or end a sentence but is white space inside one; so are
the clause joins after `2.0 (the "License")`, `conditions:` and `are met:`. A sentence is normalised (a-z0-9 words
joined by one space) and looked up among known licence sentences. The sequence of the found identifiers is matched
against the licence rules in order; what a rule matches is used up for the later ones.

The DuckDB twin cuts at every line end and so knows one-line notices only; on texts with these alone both are equal.

Defined cases: a null or empty text has no sentences; unknown sentences are skipped; a repeated sentence repeats
its identifier; rows with equal or null doc_id each get their own row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of well-known licence notices and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2_ref",
    "you may not use this file except in compliance with the license": "apache2_compliance",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2_url",
    "this work is licensed under the gnu general public license version 3": "gpl3_ref",
    "licensed under the gnu general public license version 3": "gpl3_ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_no_warranty",
    "released under the mit license": "mit_ref",
    "licensed under the mit license": "mit_ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "licensed under the bsd 3 clause license": "bsd3_ref",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21_grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3_grant",
    "licensed under cc by nc 4 0": "cc_by_nc_ref",
    "licensed under cc by 4 0": "cc_by_ref",
    "licensed under cc by sa 4 0": "cc_by_sa_ref",
    "this work is licensed under the creative commons attribution 4 0 international license": "cc_by_ref",
    "this work is dedicated to the public domain": "public_domain",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2_ref",
    "all rights reserved": "all_rights",
}

#: A word of each sentence above has one of these; a text without them is not cut at all.
HINTS = ("licen", "reserved", "permission", "permitted", "redistribut", "warranty", "domain")
#: The gate of the DuckDB twin, which misses `All Rights-Reserved`.
KEYWORDS = ("licen", "rights reserved", "permission", "permitted", "redistribut", "warranty", "public domain")

#: Licences and the identifier runs that name them, longest evidence first.
RULES = (
    ("Apache-2.0", "apache2_ref apache2_compliance apache2_url"),
    ("Apache-2.0", "apache2_ref"),
    ("GPL-3.0-or-later", "gpl3_grant gpl_no_warranty"),
    ("GPL-3.0-or-later", "gpl3_grant"),
    ("GPL-2.0-or-later", "gpl2_grant gpl_no_warranty"),
    ("GPL-2.0-or-later", "gpl2_grant"),
    ("GPL-3.0-only", "gpl3_ref"),
    ("LGPL-2.1-or-later", "lgpl21_grant gpl_no_warranty"),
    ("LGPL-2.1-or-later", "lgpl21_grant"),
    ("AGPL-3.0-or-later", "agpl3_grant gpl_no_warranty"),
    ("AGPL-3.0-or-later", "agpl3_grant"),
    ("ISC", "isc_grant"),
    ("MIT", "mit_grant mit_notice"),
    ("MIT", "mit_ref"),
    ("BSD-3-Clause", "bsd_grant bsd_source bsd_binary bsd_names"),
    ("BSD-2-Clause", "bsd_grant bsd_source bsd_binary"),
    ("BSD-3-Clause", "bsd3_ref"),
    ("CC-BY-NC-4.0", "cc_by_nc_ref"),
    ("CC-BY-SA-4.0", "cc_by_sa_ref"),
    ("CC-BY-4.0", "cc_by_ref"),
    ("MPL-2.0", "mpl2_ref"),
    ("Public-Domain", "public_domain"),
    ("Proprietary", "all_rights"),
)

#: What becomes of a lower-case text, step by step: H is a cut, S a place where a sentence may begin, end or go on.
_STEPS = (
    (r"\r\n?", "\n"),
    (r"(?:^|\n)[ \t]*(?:rem|dnl)(?![a-z0-9])", "\n"),
    (r"(?<![a-z0-9])v\.[^a-z0-9]+(?=[0-9])", "v "),
    (r"(?<![^a-z0-9])([^a-z0-9\n]*+)\n[^a-z0-9]*+(?=https?:)", "$1S"),
    (r"2\.0[^a-z0-9]*\(the[^a-z0-9]+license[^a-z0-9)]*\)[;,]?", "2.0S"),
    (r"(?<=conditions|are met):", "S"),
    (r"[.!?][ \t\n\f]+", "H"),
    (r"\n[^a-z0-9\nHS]*\n", "H"),
    (r"(?<=[\nHS])[^a-z0-9\nHS]*(?:[0-9]{1,2}|[ab])\)[ \t]+", ""),
    (r"\n", "S"),
    (r"[^a-z0-9HS]+", " "),
)
#: A known sentence from one such place to another.
_KNOWN = "(?:^|[HS]) ?(" + "|".join(k.replace(" ", "[ S]+") for k in SENTENCES) + ")(?= ?(?:[HS]|$))"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known licence sentences of a text, in order."""
    low = F.lower(text)
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    marked = low
    for pattern, mark in _STEPS:
        marked = F.regexp_replace(marked, F.lit(pattern), F.lit(mark))
    ids = F.transform(F.regexp_extract_all(marked, F.lit(_KNOWN), F.lit(1)), lambda s: F.try_element_at(known, F.regexp_replace(s, F.lit("[ S]+"), F.lit(" "))))
    hint = F.lit(False)
    for word in HINTS:
        hint = hint | F.contains(low, F.lit(word))
    return F.when(F.coalesce(hint, F.lit(False)), F.filter(ids, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_sentences, sentence_ids, licences (in rule order), n_unmatched identifiers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sentence_ids(F.col("text").cast("string")).alias("ids"))
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"), F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")).alias("left"))
    names = []
    for i, (name, run) in enumerate(RULES):
        run = "  ".join(run.split())
        rows = rows.withColumn(f"rule{i}", F.when(F.contains("left", F.lit(f" {run} ")), F.lit(name)))
        rows = rows.withColumn("left", F.replace("left", F.lit(f" {run} "), F.lit(" ")))
        names.append(f"rule{i}")
    unmatched = F.size(F.filter(F.split(F.trim("left"), " +"), lambda x: x != "")).cast("long")
    return rows.select("doc_id", "n_sentences", "sentence_ids", F.array_join(F.array_distinct(F.array_compact(F.array(*names))), ",").alias("licences"), unmatched.alias("n_unmatched"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    lookup = "CASE trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SENTENCES.items()) + " END"
    hint = " OR ".join(f"contains(lower(text), '{k}')" for k in KEYWORDS)
    steps = [
        f"s0 AS (SELECT doc_id, CASE WHEN {hint} THEN list_filter(list_transform(string_split(regexp_replace(lower(text), '([.!?])[ \\t\\r\\n\\f]+', '\\1' || chr(10), 'g'), chr(10)), lambda s: {lookup}), lambda x: x IS NOT NULL) ELSE [] END AS ids FROM documents)",
        "l0 AS (SELECT doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS remaining, CAST([] AS VARCHAR[]) AS found FROM s0)",
    ]
    for i, (name, run) in enumerate(RULES):
        run = "  ".join(run.split())
        steps.append(f"l{i + 1} AS (SELECT doc_id, ids, replace(remaining, ' {run} ', ' ') AS remaining, CASE WHEN contains(remaining, ' {run} ') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM l{i})")
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, coalesce(array_to_string(found, ','), '') AS licences, CAST(len(list_filter(string_split(remaining, ' '), lambda x: x <> '')) AS BIGINT) AS n_unmatched FROM l{len(RULES)}"
