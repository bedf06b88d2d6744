"""License scans: known sentences become identifiers, identifier sequences meet ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID

# Licence sentences, normalised (lower case, runs of other characters than
# letters and digits are one space), with their identifiers.
SENTENCES = {
    "released under the mit license": "MIT-NAME",
    "licensed under the mit license": "MIT-NAME",
    "this project is licensed under the mit license": "MIT-NAME",
    "spdx license identifier mit": "MIT-NAME",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT-GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT-NOTICE",
    "licensed under the apache license version 2 0": "APACHE-2-NAME",
    "licensed under the apache license version 2 0 the license": "APACHE-2-NAME",
    "spdx license identifier apache 2 0": "APACHE-2-NAME",
    "you may not use this file except in compliance with the license": "APACHE-2-COMPLY",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "APACHE-2-COPY",
    "this work is licensed under the gnu general public license version 3": "GPL-3-NAME",
    "licensed under the gnu general public license version 3": "GPL-3-NAME",
    "spdx license identifier gpl 3 0 only": "GPL-3-NAME",
    "spdx license identifier gpl 3 0 or later": "GPL-3-PLUS-NAME",
    "this work is licensed under the gnu general public license version 2": "GPL-2-NAME",
    "licensed under the gnu general public license version 2": "GPL-2-NAME",
    "spdx license identifier gpl 2 0 only": "GPL-2-NAME",
    "spdx license identifier gpl 2 0 or later": "GPL-2-PLUS-NAME",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL-3-PLUS-GRANT",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL-2-PLUS-GRANT",
    "you should have received a copy of the gnu general public license along with this program": "GPL-RECEIVED",
    "licensed under the gnu lesser general public license version 3": "LGPL-3-NAME",
    "licensed under the gnu affero general public license version 3": "AGPL-3-NAME",
    "licensed under cc by nc 4 0": "CC-BY-NC-4-NAME",
    "licensed under cc by 4 0": "CC-BY-4-NAME",
    "licensed under cc by sa 4 0": "CC-BY-SA-4-NAME",
    "this work is licensed under a creative commons attribution 4 0 international license": "CC-BY-4-NAME",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CC-BY-NC-4-NAME",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CC-BY-SA-4-NAME",
    "licensed under the mozilla public license version 2 0": "MPL-2-NAME",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL-2-TERMS",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD-GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD-SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD-BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD-ENDORSE",
    "released under the bsd 3 clause license": "BSD-3-NAME",
    "licensed under the bsd 3 clause license": "BSD-3-NAME",
    "licensed under the bsd 2 clause license": "BSD-2-NAME",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-GRANT",
    "this is free and unencumbered software released into the public domain": "UNLICENSE-GRANT",
    "this work has been released into the public domain": "PUBLIC-DOMAIN",
}

# Names that notices give licences, with the identifier of the name.
NAMES = {
    "mit license": "MIT-NAME",
    "apache license version 2 0": "APACHE-2-NAME",
    "apache license 2 0": "APACHE-2-NAME",
    "apache 2 0 license": "APACHE-2-NAME",
    "gnu general public license version 3": "GPL-3-NAME",
    "gnu general public license version 2": "GPL-2-NAME",
    "gnu general public license v3": "GPL-3-NAME",
    "gnu general public license v2": "GPL-2-NAME",
    "gnu gpl v3": "GPL-3-NAME",
    "gnu gpl v2": "GPL-2-NAME",
    "gplv3": "GPL-3-NAME",
    "gplv2": "GPL-2-NAME",
    "gnu lesser general public license version 3": "LGPL-3-NAME",
    "gnu lesser general public license version 2 1": "LGPL-2.1-NAME",
    "lgplv3": "LGPL-3-NAME",
    "gnu affero general public license version 3": "AGPL-3-NAME",
    "agplv3": "AGPL-3-NAME",
    "mozilla public license version 2 0": "MPL-2-NAME",
    "bsd 3 clause license": "BSD-3-NAME",
    "bsd 2 clause license": "BSD-2-NAME",
    "isc license": "ISC-NAME",
    "zlib license": "ZLIB-NAME",
    "unlicense": "UNLICENSE-NAME",
}
VERBS = ["licensed", "released", "available", "distributed", "published"]
SUBJECTS = ["", "this project is ", "this software is ", "this work is ", "this program is ", "this library is ", "this file is ", "the code is "]
# Identifiers of the public licence list, with those of their names here.
SPDX = {
    "MIT": "MIT-NAME",
    "Apache-2.0": "APACHE-2-NAME",
    "GPL-2.0-only": "GPL-2-NAME",
    "GPL-2.0-or-later": "GPL-2-PLUS-NAME",
    "GPL-3.0-only": "GPL-3-NAME",
    "GPL-3.0-or-later": "GPL-3-PLUS-NAME",
    "LGPL-2.1-only": "LGPL-2.1-NAME",
    "LGPL-2.1-or-later": "LGPL-2.1-PLUS-NAME",
    "LGPL-3.0-only": "LGPL-3-NAME",
    "LGPL-3.0-or-later": "LGPL-3-PLUS-NAME",
    "AGPL-3.0-only": "AGPL-3-NAME",
    "AGPL-3.0-or-later": "AGPL-3-PLUS-NAME",
    "BSD-2-Clause": "BSD-2-NAME",
    "BSD-3-Clause": "BSD-3-NAME",
    "MPL-2.0": "MPL-2-NAME",
    "ISC": "ISC-NAME",
    "Zlib": "ZLIB-NAME",
    "Unlicense": "UNLICENSE-NAME",
    "CC-BY-4.0": "CC-BY-4-NAME",
    "CC-BY-SA-4.0": "CC-BY-SA-4-NAME",
    "CC-BY-NC-4.0": "CC-BY-NC-4-NAME",
    "CC0-1.0": "CC0-1-NAME",
}
# The free software grants by licence and version, and other families' sentences.
GRANTS = {
    ("gnu lesser general public license", "2 1"): "LGPL-2.1-PLUS-GRANT",
    ("gnu lesser general public license", "3"): "LGPL-3-PLUS-GRANT",
    ("gnu affero general public license", "3"): "AGPL-3-PLUS-GRANT",
}
OTHERS = {
    "you should have received a copy of the gnu lesser general public license along with this library": "LGPL-RECEIVED",
    "you should have received a copy of the gnu affero general public license along with this program": "AGPL-RECEIVED",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZLIB-GRANT",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "CC0-1-WAIVER",
}
SPDX_HEAD = "spdx license identifier "


def _sentences() -> dict[str, str]:
    """All known sentences: those above, and what names, verbs, subjects and grants combine to."""
    out = dict(SENTENCES) | OTHERS
    for subject in SUBJECTS:
        for verb in VERBS:
            for name, sid in NAMES.items():
                out.setdefault(f"{subject}{verb} under the {name}", sid)
    for thing in ("program", "library", "software"):
        for (name, version), sid in GRANTS.items():
            out[
                f"this {thing} is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software "
                f"foundation either version {version} of the license or at your option any later version"
            ] = sid
    for article in ("a", "the"):
        for kind, sid in (("", "CC-BY-4-NAME"), (" noncommercial", "CC-BY-NC-4-NAME"), (" sharealike", "CC-BY-SA-4-NAME")):
            for end in (" license", ""):
                out.setdefault(f"this work is licensed under {article} creative commons attribution{kind} 4 0 international{end}", sid)
                out.setdefault(f"licensed under {article} creative commons attribution{kind} 4 0 international{end}", sid)
    for name, sid in SPDX.items():
        words = "".join(c if c.isalnum() else " " for c in name.lower()).replace(" or later", " orlater")
        out[SPDX_HEAD + words] = sid
    return out


# Licences and the identifiers that make them, the more specific first. What
# a rule has matched is used up.
RULES = [
    ("MIT", ["MIT-GRANT", "MIT-NOTICE"]),
    ("MIT", ["MIT-NAME"]),
    ("Apache-2.0", ["APACHE-2-NAME", "APACHE-2-COMPLY", "APACHE-2-COPY"]),
    ("Apache-2.0", ["APACHE-2-NAME"]),
    ("GPL-3.0-or-later", ["GPL-3-PLUS-GRANT", "GPL-RECEIVED"]),
    ("GPL-3.0-or-later", ["GPL-3-PLUS-GRANT"]),
    ("GPL-3.0-or-later", ["GPL-3-PLUS-NAME"]),
    ("GPL-3.0-only", ["GPL-3-NAME"]),
    ("GPL-2.0-or-later", ["GPL-2-PLUS-GRANT", "GPL-RECEIVED"]),
    ("GPL-2.0-or-later", ["GPL-2-PLUS-GRANT"]),
    ("GPL-2.0-or-later", ["GPL-2-PLUS-NAME"]),
    ("GPL-2.0-only", ["GPL-2-NAME"]),
    ("LGPL-2.1-or-later", ["LGPL-2.1-PLUS-GRANT", "LGPL-RECEIVED"]),
    ("LGPL-2.1-or-later", ["LGPL-2.1-PLUS-GRANT"]),
    ("LGPL-2.1-or-later", ["LGPL-2.1-PLUS-NAME"]),
    ("LGPL-2.1-only", ["LGPL-2.1-NAME"]),
    ("LGPL-3.0-or-later", ["LGPL-3-PLUS-GRANT"]),
    ("LGPL-3.0-or-later", ["LGPL-3-PLUS-NAME"]),
    ("LGPL-3.0-only", ["LGPL-3-NAME"]),
    ("AGPL-3.0-or-later", ["AGPL-3-PLUS-GRANT", "AGPL-RECEIVED"]),
    ("AGPL-3.0-or-later", ["AGPL-3-PLUS-GRANT"]),
    ("AGPL-3.0-or-later", ["AGPL-3-PLUS-NAME"]),
    ("AGPL-3.0-only", ["AGPL-3-NAME"]),
    ("CC0-1.0", ["CC0-1-WAIVER"]),
    ("CC0-1.0", ["CC0-1-NAME"]),
    ("Zlib", ["ZLIB-GRANT"]),
    ("Zlib", ["ZLIB-NAME"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC-4-NAME"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA-4-NAME"]),
    ("CC-BY-4.0", ["CC-BY-4-NAME"]),
    ("MPL-2.0", ["MPL-2-TERMS"]),
    ("MPL-2.0", ["MPL-2-NAME"]),
    ("BSD-3-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE"]),
    ("BSD-2-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY"]),
    ("BSD-3-Clause", ["BSD-3-NAME"]),
    ("BSD-2-Clause", ["BSD-2-NAME"]),
    ("ISC", ["ISC-GRANT"]),
    ("ISC", ["ISC-NAME"]),
    ("Unlicense", ["UNLICENSE-GRANT"]),
    ("Unlicense", ["UNLICENSE-NAME"]),
    ("public-domain", ["PUBLIC-DOMAIN"]),
]

#: Every known sentence has one of these words, so texts without them are not split.
TRIGGER = r"(?i)licen|gpl|waived|permission|copyright|redistrib|compliance|software|public[^a-z0-9]+domain"
#: Ends of sentences; a line's end is one too in the first reading.
SENTENCE_END = r"[.!?;]+[\x20\x09-\x0D]+"
#: Ends of paragraphs: lines without letters or digits, and list numbers that start a line.
PARAGRAPH_END = (
    r"(?:\n[^A-Za-z0-9\n]*)+\n|(?<![Vv]ersion)\n(?=[^A-Za-z0-9\n]*(?:[0-9]{1,2}|[A-Za-z])[.)][\x20\x09])"
)
#: Ends of sentences in paragraphs. Notices have ``;`` and ``:`` between sentences (Apache, MIT)
#: and inside them (GPL), so there is a reading with and one without them; 'v. 2' is no end.
NOTICE_ENDS = [rf"{PARAGRAPH_END}|(?<!\b[vV])[{marks}]+[\x20\x09-\x0D]+" for marks in (".!?;:", ".!?")]
#: Forms of the sentence on endorsement, which names the owner ('Inc.' may cut it).
ENDORSE = (
    r"^(?:neither the names? of .{1,200} |)nor the names of (?:its|their|the|any|other) contributors may be used to "
    r"|^the names? of .{1,200} may not be used to (?=endorse)"
)


def normalise(c: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]+", " ")))


def normalise_item(c: Column) -> Column:
    """A normalised sentence of a paragraph: without its list number, owners' names as in the table."""
    bare = F.regexp_replace(normalise(c), "^(?:[0-9]{1,2}|[a-z]) ", "")
    holder = "neither the name of the copyright holder nor the names of its contributors may be used to "
    return F.regexp_replace(bare, ENDORSE, holder)


def named_apart(s: Column) -> Column:
    """A normalised sentence as an array: an identifier line with several licences gives one sentence for each."""
    rest = F.replace(F.substr(s, F.lit(len(SPDX_HEAD) + 1)), F.lit(" or later"), F.lit(" orlater"))
    apart = F.transform(F.split(rest, " (?:or|and) "), lambda x: F.concat(F.lit(SPDX_HEAD), x))
    return F.when(F.startswith(s, F.lit(SPDX_HEAD)), apart).otherwise(F.array(s))


def match_rules(sequence: Column) -> Column:
    """The licences of a sequence ``' ID ID '`` of identifiers, as an array, in rule order."""
    found = []
    for name, ids in RULES:
        part = " " + "  ".join(ids) + " "
        found.append(F.when(F.contains(sequence, F.lit(part)), F.lit(name)))
        sequence = F.replace(sequence, F.lit(part), F.lit(" | "))
    return F.array_compact(F.array(*found))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_known, sentence_ids, licenses, n_licenses`` of every row.

    A text is read with line ends as sentence ends, unwrapped, with line ends as spaces, and
    twice by unwrapped paragraphs (see ``NOTICE_ENDS``). Sentences are normalised and looked up among the known ones (a fixed table, so it
    is broadcast). A reading's identifiers, in order, meet the rules in order; a rule
    matches neighbours among the known sentences. ``n_known`` and ``sentence_ids`` describe the
    first reading, ``licenses`` joins what any found, sorted.

    A line with an identifier of the public licence list may name several (``A OR B``).
    Texts are split whole; a very long one is as many sentences, none longer than itself.

    A null or empty text has no licence (``licenses`` is the empty string). Rows of one id are
    scanned apart; repeated rows get equal values. An empty table gives no rows. Other columns
    of ``docs`` are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))
    known = spark.createDataFrame(list(_sentences().items()), "known string, sid string")
    readings = F.array(
        F.struct(F.lit(0).alias("r"), F.split("text", SENTENCE_END + r"|\n").alias("parts")),
        F.struct(F.lit(1).alias("r"), F.split(F.translate("text", "\n", " "), SENTENCE_END).alias("parts")),
        *[F.struct(F.lit(r).alias("r"), F.split("text", end).alias("parts")) for r, end in enumerate(NOTICE_ENDS, 2)],
    )
    sentences = (
        rows.where(F.rlike("text", F.lit(TRIGGER)))
        .select("d", "th", F.explode(readings).alias("x"))
        .select("d", "th", "x.r", F.posexplode("x.parts").alias("pos", "s"))
        .where(F.rlike("s", F.lit(TRIGGER)))
        .select("d", "th", "r", "pos", F.when(F.col("r") < 2, normalise(F.col("s"))).otherwise(normalise_item(F.col("s"))).alias("s"))
        .select("d", "th", "r", "pos", F.explode(named_apart(F.col("s"))).alias("s"))
    )
    sequences = (
        sentences.join(F.broadcast(known), F.col("s") == F.col("known"))
        .groupBy("d", "th", "r")
        .agg(F.array_sort(F.collect_set(F.struct("pos", "sid"))).alias("ids"))
        .select("d", "th", "r", F.transform("ids", lambda x: x["sid"]).alias("ids"))
        .withColumn("found", match_rules(F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" "))))
    )
    per_row = sequences.groupBy(F.col("d").alias("s_d"), F.col("th").alias("s_th")).agg(
        F.max(F.when(F.col("r") == 0, F.col("ids"))).alias("ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"),
    )
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    found = F.coalesce("found", F.array().cast("array<string>"))
    return rows.select("d", "th").join(per_row, (F.col("d") == F.col("s_d")) & (F.col("th") == F.col("s_th")), "left").select(
        F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"),
        F.size(ids).cast("long").alias("n_known"),
        F.array_join(ids, ",").alias("sentence_ids"),
        F.array_join(found, ",").alias("licenses"),
        F.size(found).cast("long").alias("n_licenses"),
    )


def sql() -> str:
    """The same scan in SQL, with the fixed tables written out."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in _sentences().items())
    sequence, found = "seq", []
    for name, ids in RULES:
        part = " " + "  ".join(ids) + " "
        found.append(f"CASE WHEN contains({sequence}, '{part}') THEN '{name}' END")
        sequence = f"replace({sequence}, '{part}', ' | ')"
    return rf"""
WITH known(s, sid) AS (VALUES {known}),
t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT doc_id, 0 AS r, text FROM t UNION ALL SELECT doc_id, 1, replace(text, chr(10), ' ') FROM t),
l AS (SELECT doc_id, r, regexp_split_to_array(text, '{SENTENCE_END}|\n') AS parts FROM u),
p AS (SELECT doc_id, r, generate_subscripts(parts, 1) AS pos,
             unnest(parts) AS s FROM l),
n AS (SELECT doc_id, r, pos, trim(lower(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g'))) AS s FROM p),
e AS (SELECT doc_id, r, pos, unnest(CASE WHEN starts_with(s, '{SPDX_HEAD}')
             THEN list_transform(regexp_split_to_array(replace(substr(s, {len(SPDX_HEAD) + 1}), ' or later', ' orlater'), ' (?:or|and) '), lambda x: '{SPDX_HEAD}' || x)
             ELSE [s] END) AS s FROM n),
k AS (SELECT DISTINCT e.doc_id, e.r, e.pos, known.sid FROM e JOIN known ON e.s = known.s),
q AS (SELECT doc_id, r, list(sid ORDER BY pos, sid) AS ids FROM k GROUP BY doc_id, r),
m AS (SELECT doc_id, r, ids, ' ' || array_to_string(ids, '  ') || ' ' AS seq FROM q),
f AS (SELECT doc_id, r, ids, list_filter([{", ".join(found)}], lambda x: x IS NOT NULL) AS found FROM m),
g AS (SELECT doc_id, list_sort(list_distinct(flatten(list(found)))) AS found,
             max(CASE WHEN r = 0 THEN array_to_string(ids, ',') END) AS sentence_ids,
             max(CASE WHEN r = 0 THEN len(ids) END) AS n FROM f GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_known, coalesce(g.sentence_ids, '') AS sentence_ids,
       coalesce(array_to_string(g.found, ','), '') AS licenses, CAST(coalesce(len(g.found), 0) AS BIGINT) AS n_licenses
FROM t LEFT JOIN g ON t.doc_id = g.doc_id
"""
