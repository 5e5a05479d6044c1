"""Licence scans by sentence rules.

A text is cut into sentences: at stops before white space and at blank lines, so wrapped and commented lines go on. Each
sentence that holds a word of licensing is normalised (lower case, words and digits only) and mapped to identifiers of
known sentences and of the licences that a grant in it names ("licensed under either of A or B"; a denied grant names
none). The sequence of the text's identifiers is then matched against rules, each an ordered sequence of identifiers
between which a few others and a few unknown sentences may stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences (or what is peculiar in them) of well-known licences and notices, and their identifiers.
SENTENCES = {
    "you may not use this file except in compliance with the license": "APACHE-2-COMPLY",
    "you may obtain a copy of the license at": "APACHE-2-COPY",
    "apache license version 2 0 january 2004": "APACHE-2-TITLE",
    "the mit license mit": "MIT-NAME",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "MIT-GRANT",
    "the above copyright notice and this permission notice shall be included in all copies": "MIT-NOTICE",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies": "MIT-NOTICE",
    "the software is provided as is without warranty of any kind": "MIT-AS-IS",
    "this program is free software you can redistribute it": "GPL-GRANT",
    "this file is free software you can redistribute it": "GPL-GRANT",
    "this library is free software you can redistribute it": "LGPL-GRANT",
    "gnu general public license version 2 june 1991": "GPL-2-NAME",
    "gnu general public license version 3 29 june 2007": "GPL-3-NAME",
    "gnu lesser general public license version 2 1 february 1999": "LGPL-2-NAME",
    "gnu lesser general public license version 3 29 june 2007": "LGPL-3-NAME",
    "gnu affero general public license version 3 19 november 2007": "AGPL-3-NAME",
    "redistribution and use in source and binary forms with or without modification are permitted": "BSD-GRANT",
    "redistributions of source code must retain the above copyright notice": "BSD-SOURCE",
    "redistributions in binary form must reproduce the above copyright notice": "BSD-BINARY",
    "all advertising materials mentioning features or use of this software": "BSD-ADVERTISE",
    "may be used to endorse or promote products derived from this software without specific prior written permission": "BSD-ENDORSE",
    "all rights reserved": "RESERVED",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "MPL-2-NAME",
    "mozilla public license version 2 0 1 definitions": "MPL-2-NAME",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "ISC-GRANT",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted": "ISC-GRANT",
    "this is free and unencumbered software released into the public domain": "UNLICENSE",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation": "BSL-GRANT",
    "boost software license version 1 0 august 17th 2003": "BSL-NAME",
    "the accompanying program is provided under the terms of this eclipse public license": "EPL-GRANT",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZLIB-LIABLE",
    "the origin of this software must not be misrepresented": "ZLIB-ORIGIN",
    "altered source versions must be plainly marked as such": "ZLIB-ALTERED",
    "waived all copyright and related or neighboring rights": "CC0-WAIVER",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document": "WTFPL-COPY",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted": "POSTGRESQL-GRANT",
    "this license governs use of the accompanying software": "MS-GRANT",
}
# How grants name licences, normalised.
NAMES = {
    "APACHE-2-NAME": ["apache license version 2 0", "apache license v2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache software license version 2 0"],
    "MIT-NAME": ["mit license", "mit expat license", "mit"],
    "BSD-2-NAME": ["bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd", "freebsd license"],
    "BSD-3-NAME": ["bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd", "modified bsd", "revised bsd"],
    "BSD-ZERO-NAME": ["0bsd", "zero clause bsd", "bsd zero clause"],
    "GPL-2-NAME": ["gnu general public license version 2", "gnu general public license v2", "gnu general public license as published by the free software foundation version 2", "gnu general public license as published by the free software foundation either version 2", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gpl v2", "gplv2", "gpl 2 0"],
    "GPL-3-NAME": ["gnu general public license version 3", "gnu general public license v3", "gnu general public license as published by the free software foundation version 3", "gnu general public license as published by the free software foundation either version 3", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gpl v3", "gplv3", "gpl 3 0"],
    "LGPL-2-NAME": ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lesser general public license as published by the free software foundation version 2 1", "gnu lesser general public license as published by the free software foundation either version 2 1", "gnu lgpl version 2 1", "lgpl v2 1", "lgplv2 1", "lgpl 2 1"],
    "LGPL-3-NAME": ["gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lesser general public license as published by the free software foundation version 3", "gnu lesser general public license as published by the free software foundation either version 3", "gnu lgpl version 3", "lgpl v3", "lgplv3", "lgpl 3 0"],
    "AGPL-3-NAME": ["gnu affero general public license version 3", "gnu affero general public license v3", "gnu affero general public license as published by the free software foundation version 3", "gnu affero general public license as published by the free software foundation either version 3", "gnu agpl version 3", "agpl v3", "agplv3", "agpl 3 0"],
    "MPL-2-NAME": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license v2 0", "mozilla public license 2 0", "mpl 2 0"],
    "MPL-1-NAME": ["mozilla public license version 1 1", "mozilla public license 1 1", "mpl 1 1"],
    "EPL-1-NAME": ["eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license v 1 0", "eclipse public license 1 0", "epl 1 0"],
    "EPL-2-NAME": ["eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license v 2 0", "eclipse public license 2 0", "epl 2 0"],
    "BSL-NAME": ["boost software license version 1 0", "boost software license 1 0", "boost software license", "bsl 1 0"],
    "ZLIB-NAME": ["zlib license", "zlib libpng license", "zlib"],
    "CC0-NAME": ["creative commons zero", "cc0 1 0 universal", "cc0 1 0", "cc0"],
    "CC-BY-4-NAME": ["creative commons attribution 4 0 international", "creative commons attribution 4 0", "cc by 4 0"],
    "CC-BY-SA-4-NAME": ["creative commons attribution sharealike 4 0 international", "creative commons attribution share alike 4 0 international", "cc by sa 4 0"],
    "CC-BY-NC-4-NAME": ["creative commons attribution noncommercial 4 0 international", "creative commons attribution non commercial 4 0 international", "cc by nc 4 0"],
    "CC-BY-ND-4-NAME": ["creative commons attribution noderivatives 4 0 international", "cc by nd 4 0"],
    "CC-BY-NC-SA-4-NAME": ["creative commons attribution noncommercial sharealike 4 0 international", "cc by nc sa 4 0"],
    "ISC-NAME": ["isc license", "isc"],
    "UNLICENSE": ["unlicense"],
    "ARTISTIC-2-NAME": ["artistic license 2 0", "artistic license version 2 0", "artistic 2 0"],
    "WTFPL-NAME": ["wtfpl"],
    "POSTGRESQL-NAME": ["postgresql license", "postgresql"],
    "OFL-NAME": ["sil open font license version 1 1", "sil open font license 1 1", "ofl 1 1"],
    "CDDL-1-NAME": ["common development and distribution license version 1 0", "common development and distribution license", "cddl 1 0"],
    "EUPL-NAME": ["european union public license version 1 2", "eupl version 1 2", "eupl 1 2"],
    "BUSL-NAME": ["business source license 1 1", "busl 1 1"],
    "MS-PL-NAME": ["microsoft public license", "ms pl"],
}
# Words that open a grant, and those that may stand before and between the names in it.
LEADS = ["licensed under", "released under", "distributed under", "available under", "published under", "provided under", "offered under", "covered by", "governed by", "subject to", "under the terms of", "under the terms and conditions of", "spdx license identifier", "license is"]
FILL = ["the", "a", "an", "and", "or", "at", "your", "option", "of", "either", "both", "terms", "conditions", "license", "licenses", "version", "only", "later", "dual"]
DENIALS = ["not", "never", "no longer", "isn t", "wasn t", "neither", "nor"]
# Parts of words of which every sentence and lead above has one.
CUES = ["licen", "permi", "redistrib", "copyright", "reserved", "unencumbered", "warrant", "under", "covered", "governed", "subject", "endorse", "identifier", "advertising", "liable", "misrepresented", "plainly marked", "mpl"]
# Rules as ordered sequences of identifiers.
RULES = {
    "Apache-2.0": ["APACHE-2-NAME"],
    "Apache-2.0-header": ["APACHE-2-NAME", "APACHE-2-COMPLY", "APACHE-2-COPY"],
    "Apache-2.0-text": ["APACHE-2-TITLE"],
    "MIT": ["MIT-NAME"],
    "MIT-text": ["MIT-GRANT", "MIT-NOTICE", "MIT-AS-IS"],
    "GPL-2.0": ["GPL-2-NAME"],
    "GPL-3.0": ["GPL-3-NAME"],
    "GPL-grant": ["GPL-GRANT"],
    "LGPL-grant": ["LGPL-GRANT"],
    "LGPL-2.1": ["LGPL-2-NAME"],
    "LGPL-3.0": ["LGPL-3-NAME"],
    "AGPL-3.0": ["AGPL-3-NAME"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4-NAME"],
    "CC-BY-NC-SA-4.0": ["CC-BY-NC-SA-4-NAME"],
    "CC-BY-ND-4.0": ["CC-BY-ND-4-NAME"],
    "CC-BY-SA-4.0": ["CC-BY-SA-4-NAME"],
    "CC-BY-4.0": ["CC-BY-4-NAME"],
    "CC0-1.0": ["CC0-NAME"],
    "CC0-1.0-waiver": ["CC0-WAIVER"],
    "BSD": ["BSD-GRANT"],
    "BSD-reserved": ["RESERVED", "BSD-GRANT"],
    "BSD-2-Clause": ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY"],
    "BSD-3-Clause": ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE"],
    "BSD-4-Clause": ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ADVERTISE", "BSD-ENDORSE"],
    "BSD-2-Clause-name": ["BSD-2-NAME"],
    "BSD-3-Clause-name": ["BSD-3-NAME"],
    "0BSD": ["BSD-ZERO-NAME"],
    "all-rights-reserved": ["RESERVED"],
    "MPL-1.1": ["MPL-1-NAME"],
    "MPL-2.0": ["MPL-2-NAME"],
    "EPL-1.0": ["EPL-1-NAME"],
    "EPL-2.0": ["EPL-2-NAME"],
    "EPL-text": ["EPL-GRANT"],
    "BSL-1.0": ["BSL-NAME"],
    "BSL-1.0-text": ["BSL-GRANT"],
    "Zlib": ["ZLIB-NAME"],
    "Zlib-text": ["ZLIB-LIABLE", "ZLIB-ORIGIN", "ZLIB-ALTERED"],
    "ISC": ["ISC-GRANT"],
    "ISC-name": ["ISC-NAME"],
    "Unlicense": ["UNLICENSE"],
    "Artistic-2.0": ["ARTISTIC-2-NAME"],
    "WTFPL": ["WTFPL-NAME"],
    "WTFPL-text": ["WTFPL-COPY"],
    "PostgreSQL": ["POSTGRESQL-NAME"],
    "PostgreSQL-text": ["POSTGRESQL-GRANT"],
    "OFL-1.1": ["OFL-NAME"],
    "CDDL-1.0": ["CDDL-1-NAME"],
    "EUPL-1.2": ["EUPL-NAME"],
    "BUSL-1.1": ["BUSL-NAME"],
    "MS-PL": ["MS-PL-NAME"],
    "MS-text": ["MS-GRANT"],
    "choice-of-licenses": ["CHOICE"],
}
#: Identifiers, and unknown sentences on end, that may stand between two identifiers of a rule.
OTHERS, UNKNOWN = 4, 8

# Patterns that Java's and DuckDB's regular expressions read alike.
_VERSION = r"\bv\. ?([0-9])"
_STOP = r"[.!?][\"')\]]*[ \t\r\n]+|\n[ \t\r#*/>;%-]*\n"
_WORDS = "[^a-z0-9]+"


def _any(texts) -> str:
    """Any of the texts, longer ones first."""
    return "(?:" + "|".join(sorted(texts, key=lambda t: (-len(t), t))) + ")"


def _patterns() -> dict[str, str]:
    """What is looked for in a normalised sentence: grants with the names they hold, or known sentences."""
    name = _any(n for forms in NAMES.values() for n in forms)
    grant = f"(?:{_any(DENIALS)} (?:[a-z0-9]+ ){{0,3}})?{_any(LEADS)} (?:{_any(FILL)} ){{0,8}}{name}(?: (?:{_any(FILL)} ){{0,8}}{name})*"
    return {
        "cue": "|".join(CUES),
        "found": rf"\b(?:{grant}|{_any(SENTENCES)})\b",
        "names": rf"\b{name}\b",
        "denied": f"^(?:{_any(DENIALS)}) ",
        "still": "^not only ",
        "choice": r"\bor\b",
        "far": f";{{{UNKNOWN + 2},}}",
    }


def _rule(ids: list[str]) -> str:
    """The pattern of a rule in a sequence of identifiers: "," within a sentence, ";" between near, "|" between far ones."""
    between = f"(?:[,;][^,;|]+){{0,{OTHERS}}}[,;]"
    return f"(?:^|[,;|]){between.join(ids)}(?:$|[,;|])"


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_sentences, sentence_ids and licenses (comma-joined, the latter sorted).

    sentence_ids are the identifiers in the order of the text; CHOICE stands before the names of a grant that offers
    several. A rule matches where its identifiers stand in their order with at most OTHERS others and UNKNOWN unknown
    sentences between two of them. Null texts have no sentences; texts without a licence give empty strings; further
    columns are ignored.
    """
    p = {k: F.lit(v) for k, v in _patterns().items()}
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    named = F.create_map(*[F.lit(x) for i, forms in NAMES.items() for form in forms for x in (form, i)])
    none = F.array().cast("array<string>")

    def names(found: Column) -> Column:
        ids = F.transform(F.regexp_extract_all(found, p["names"], F.lit(0)), lambda n: F.try_element_at(named, n))
        several = F.regexp_like(found, p["choice"]) & (F.size(ids) > 1)
        return F.when(several, F.concat(F.array(F.lit("CHOICE")), ids)).otherwise(ids)

    def ids_of(sentence: Column) -> Column:
        words = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(sentence, "licen[cs]es?:", "license is "), _WORDS, " ")), "licence", "license")
        denied = lambda m: F.regexp_like(m, p["denied"]) & ~F.regexp_like(m, p["still"])
        each = lambda m: F.when(denied(m), none).when(F.map_contains_key(known, m), F.array(F.try_element_at(known, m))).otherwise(names(m))
        return F.array_join(F.flatten(F.transform(F.regexp_extract_all(words, p["found"], F.lit(0)), each)), ",")

    text = F.regexp_replace(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), _VERSION, "v$1")
    own = docs.select("doc_id", F.filter(F.split(text, _STOP), lambda s: F.regexp_like(s, F.lit("[a-z0-9]"))).alias("s"))
    ids = F.array_join(F.transform("s", lambda s: F.when(F.regexp_like(s, p["cue"]), ids_of(s)).otherwise(F.lit(""))), ";")
    line = F.regexp_replace(F.regexp_replace(F.regexp_replace(ids, p["far"], F.lit("|")), ";+", ";"), r"^[;|]|[;|]$", "")
    own = own.select("doc_id", F.size("s").cast("long").alias("n_sentences"), line.alias("line"))
    hits = [F.when(F.regexp_like("line", F.lit(_rule(rule))), F.lit(name)) for name, rule in sorted(RULES.items())]
    return own.select("doc_id", "n_sentences", F.regexp_replace("line", "[;|]", ",").alias("sentence_ids"), F.when(F.col("line") == "", F.lit("")).otherwise(F.concat_ws(",", *hits)).alias("licenses"))


def oracle() -> str:
    """The same scan in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    p = {k: q(v) for k, v in _patterns().items()}
    forms = [(form, i) for i, own in NAMES.items() for form in own]
    at = lambda pairs, x: f"[{', '.join(q(v) for _, v in pairs)}][list_position([{', '.join(q(k) for k, _ in pairs)}], {x})]"
    hits = ", ".join(f"CASE WHEN regexp_matches(line, {q(_rule(ids))}) THEN {q(name)} END" for name, ids in sorted(RULES.items()))
    return f"""
WITH s AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), {q(_VERSION)}, 'v\\1', 'g'), {q(_STOP)}),
    lambda x: regexp_matches(x, '[a-z0-9]')) AS s FROM documents),
w AS (
  SELECT r, i, regexp_extract_all(replace(trim(regexp_replace(regexp_replace(x, 'licen[cs]es?:', 'license is ', 'g'), {q(_WORDS)}, ' ', 'g')), 'licence', 'license'), {p["found"]}) AS found
  FROM (SELECT r, unnest(s) AS x, unnest(range(len(s))) AS i FROM s) WHERE regexp_matches(x, {p["cue"]})),
m AS (SELECT r, i, unnest(found) AS m, unnest(range(len(found))) AS j FROM w),
e AS (
  SELECT r, i, j, m, {at(list(SENTENCES.items()), "m")} AS known, list_transform(regexp_extract_all(m, {p["names"]}), lambda n: {at(forms, "n")}) AS named
  FROM m WHERE NOT (regexp_matches(m, {p["denied"]}) AND NOT regexp_matches(m, {p["still"]}))),
f AS (
  SELECT r, i, string_agg(coalesce(known, CASE WHEN regexp_matches(m, {p["choice"]}) AND len(named) > 1 THEN 'CHOICE,' ELSE '' END || array_to_string(named, ',')), ',' ORDER BY j) AS ids
  FROM e GROUP BY r, i),
g AS (SELECT r, i, ids, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS step FROM f),
h AS (SELECT r, string_agg(CASE WHEN step IS NULL THEN '' WHEN step > {UNKNOWN + 1} THEN '|' ELSE ';' END || ids, '' ORDER BY i) AS line FROM g GROUP BY r),
l AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, coalesce(line, '') AS line FROM s LEFT JOIN h USING (r))
SELECT doc_id, n_sentences, regexp_replace(line, '[;|]', ',', 'g') AS sentence_ids, concat_ws(',', {hits}) AS licenses FROM l"""
