"""Licence scan by sentence rules, with DataFrame functions only.

A text is cut into sentences, each normalised (lower case, runs of other
characters than ASCII letters and digits become one space) and mapped to the
identifier of a known licence sentence.  The sequence of identifiers is
matched against licence rules in order; a rule consumes what it matches, so
a long rule takes precedence over the shorter ones within it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Known licence sentences by identifier, in normalised form.
SENTENCES = {
    "mit_short": "released under the mit license",
    "mit_short2": "licensed under the mit license",
    "mit_title": "the mit license mit",
    "mit_title2": "mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_short": "licensed under the isc license",
    "apache_short": "licensed under the apache license version 2 0",
    "apache_the": "licensed under the apache license version 2 0 the license",
    "apache_comply": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "apache_basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3_short": "this work is licensed under the gnu general public license version 3",
    "gpl2_short": "this work is licensed under the gnu general public license version 2",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl_short": "this work is licensed under the gnu lesser general public license version 3",
    "agpl_short": "this work is licensed under the gnu affero general public license version 3",
    "mpl_short": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "bsd_short": "licensed under the bsd 3 clause license",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "cc_by_nc": "licensed under cc by nc 4 0",
    "cc_by": "licensed under cc by 4 0",
    "cc_by_sa": "licensed under cc by sa 4 0",
    "cc0": "licensed under cc0 1 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "rights": "all rights reserved",
    "spdx_mit": "spdx license identifier mit",
    "spdx_apache": "spdx license identifier apache 2 0",
    "spdx_gpl3": "spdx license identifier gpl 3 0 only",
}

# Licence rules, tried in this order.
RULES = (
    ("MIT", ("mit_title", "mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_title2", "mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("ISC", ("isc_grant", "as_is")),
    ("ISC", ("isc_grant",)),
    ("Apache-2.0", ("apache_the", "apache_comply", "apache_copy", "apache_basis")),
    ("Apache-2.0", ("apache_the", "apache_comply", "apache_copy")),
    ("GPL-3.0", ("gpl_free", "gpl_hope")),
    ("GPL-3.0", ("gpl_free",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source")),
    ("MIT", ("mit_short",)),
    ("MIT", ("mit_short2",)),
    ("ISC", ("isc_short",)),
    ("Apache-2.0", ("apache_short",)),
    ("Apache-2.0", ("apache_the",)),
    ("GPL-3.0", ("gpl3_short",)),
    ("GPL-2.0", ("gpl2_short",)),
    ("LGPL-3.0", ("lgpl_short",)),
    ("AGPL-3.0", ("agpl_short",)),
    ("MPL-2.0", ("mpl_short",)),
    ("BSD-3-Clause", ("bsd_short",)),
    ("CC-BY-NC-4.0", ("cc_by_nc",)),
    ("CC-BY-4.0", ("cc_by",)),
    ("CC-BY-SA-4.0", ("cc_by_sa",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("MIT", ("spdx_mit",)),
    ("Apache-2.0", ("spdx_apache",)),
    ("GPL-3.0", ("spdx_gpl3",)),
    ("MIT", ("mit_title",)),
    ("proprietary", ("rights",)),
)

#: Every known sentence holds one of these, so a text without them has no licence sentence.
CUES = ("licen", "permission", "warranty", "copyright", "redistribut", "public domain", "all rights", "spdx", "cc by", "cc0")


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order.

    A sentence begins and ends at a line's edge, a blank line or one of .!?;
    before white space, and may be wrapped over lines.  Of several that begin
    at one place the longest counts.
    """
    known = F.create_map(*[F.lit(x) for k, v in SENTENCES.items() for x in (v, k)])
    # | stands for the end of a sentence or a blank line, / for a line feed
    norm = F.concat(F.lit("|"), F.translate(F.lower(text), "|/", ",,"), F.lit("|"))
    for pattern, put in (("[.!?;][ \\t\\r\\n\\f]+", "|"), ("\\n(?:[ \\t\\r\\f]*\\n)+", "|"), ("\\n", "/"), ("[^a-z0-9|/]+", " "), (" ?([|/]) ?", "$1")):
        norm = F.regexp_replace(norm, pattern, put)
    longest_first = sorted(SENTENCES.values(), key=len, reverse=True)
    found = F.regexp_extract_all(norm, F.lit("(?<=[|/])(?:" + "|".join(longest_first).replace(" ", "[ /]") + ")(?=[|/])"), F.lit(0))
    return F.transform(found, lambda s: F.element_at(known, F.translate(s, "/", " ")))


def licences_of(ids: Column) -> Column:
    """Licences of the rules that match, in rule order, each once."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("<" + "><".join(seq) + ">").alias("seq")) for name, seq in RULES])
    start = F.struct(F.concat(F.lit("<"), F.array_join(ids, "><"), F.lit(">")).alias("left"), F.array().cast("array<string>").alias("found"))

    def step(acc, rule):
        return F.struct(
            F.replace(acc["left"], rule["seq"], F.lit("|")).alias("left"),
            F.when(F.contains(acc["left"], rule["seq"]), F.array_append(acc["found"], rule["name"])).otherwise(acc["found"]).alias("found"),
        )

    return F.array_distinct(F.aggregate(rules, start, step, lambda acc: acc["found"]))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: its licences and how many licence sentences it has.

    Null and empty texts have none.  No row moves: every step is a function
    of one row, and only texts with a cue are cut into sentences.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.lower(text)
    hint = F.lit(False)
    for cue in CUES:
        hint = hint | F.contains(low, F.lit(cue))
    ids = F.when(hint, sentence_ids(text)).otherwise(F.array().cast("array<string>"))
    found = docs.select("doc_id", ids.alias("ids"))
    return found.select(
        "doc_id",
        "ids",
        F.when(F.size("ids") > 0, licences_of(F.col("ids"))).otherwise(F.array().cast("array<string>")).alias("licences"),
    )


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyleaf.llm.common import documents

    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"))


def oracle() -> str:
    known = "MAP {" + ", ".join(f"'{v}': '{k}'" for k, v in SENTENCES.items()) + "}"
    steps = [
        f"""s AS (SELECT doc_id, row_number() OVER () AS row_no,
          list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?;])[ \\t\\r\\n\\f]+', '\\1' || chr(10), 'g'), chr(10)),
            lambda x: map_extract_value({known}, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')))), lambda x: x IS NOT NULL) AS ids
          FROM documents)""",
        "r0 AS (SELECT doc_id, ids, '<' || array_to_string(ids, '><') || '>' AS rest, CAST([] AS VARCHAR[]) AS found FROM s)",
    ]
    for k, (name, seq) in enumerate(RULES):
        word = "<" + "><".join(seq) + ">"
        steps.append(
            f"r{k + 1} AS (SELECT doc_id, ids, replace(rest, '{word}', '|') AS rest, "
            f"CASE WHEN contains(rest, '{word}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM r{k})"
        )
    return (
        "WITH " + ",\n".join(steps) + f" SELECT doc_id, array_to_string(found, ',') AS licences, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids FROM r{len(RULES)}"
    )
