"""Licence recognition by sentence rules.

A text is cut into sentences at blank lines and at full stops, question and exclamation marks that white space
follows; a sentence in lower case, with anything but letters, digits and inner full stops as one blank, is its
normal form.  A single line end (with the signs of a comment before the next line) and a semicolon are places where
a sentence may end or go on: a known sentence is found on one line, wrapped over several and after a semicolon.
Known normal sentences have identifiers; a text's known identifiers, in order, form its sequence; of known
sentences that begin at one place the longest is taken.
Licence rules are sequences of identifiers, tried in order (longer texts before notices): a rule that stands in
the sequence names its licence, and the identifiers it covers are used up.

Only DataFrame functions run here.  Every known sentence contains one of a few key words, so a text with none of
them has an empty sequence and its sentences need no normalising.

Edge cases: null and empty texts and texts without a known sentence give an empty sequence and no licence; known
sentences that no rule uses leave the licence empty; a rule counts once however often it stands; repeated rows
give a row each; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Sentences of public licence texts and notices, in normal form, by identifier.
SENTENCES = {
    "mit.title": "mit license", "mit.notice": "released under the mit license", "mit.notice2": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache.notice": "licensed under the apache license version 2.0", "apache.header": "licensed under the apache license version 2.0 the license",
    "apache.comply": "you may not use this file except in compliance with the license", "apache.copy": "you may obtain a copy of the license at",
    "apache.unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache.see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3.notice": "this work is licensed under the gnu general public license version 3", "gpl2.notice": "this work is licensed under the gnu general public license version 2",
    "gpl.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.see": "see the gnu general public license for more details", "agpl3.notice": "licensed under the gnu affero general public license version 3",
    "lgpl3.notice": "licensed under the gnu lesser general public license version 3", "bsd.notice": "released under the bsd license",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2.notice": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "ccby.notice": "licensed under cc by 4.0", "ccbysa.notice": "licensed under cc by sa 4.0", "ccbync.notice": "licensed under cc by nc 4.0", "cc0.notice": "licensed under cc0 1.0",
    "unlicense.public": "this is free and unencumbered software released into the public domain", "reserved": "all rights reserved under copyright",
}
#: Ordered rules (licence, sequence of identifiers).
RULES = [
    ("MIT", ["mit.title", "mit.grant", "mit.keep", "mit.warranty"]), ("MIT", ["mit.grant", "mit.keep", "mit.warranty"]), ("MIT", ["mit.grant", "mit.keep"]),
    ("Apache-2.0", ["apache.header", "apache.comply", "apache.copy", "apache.unless", "apache.see"]), ("Apache-2.0", ["apache.header", "apache.comply"]),
    ("GPL-3.0-or-later", ["gpl.free", "gpl.hope", "gpl.see"]), ("GPL-3.0-or-later", ["gpl.free"]), ("BSD-2-Clause", ["bsd.grant", "bsd.source"]), ("ISC", ["isc.grant"]),
    ("MIT", ["mit.notice"]), ("MIT", ["mit.notice2"]), ("MIT", ["mit.title"]), ("Apache-2.0", ["apache.notice"]), ("Apache-2.0", ["apache.header"]),
    ("GPL-3.0-only", ["gpl3.notice"]), ("GPL-2.0-only", ["gpl2.notice"]), ("AGPL-3.0-only", ["agpl3.notice"]), ("LGPL-3.0-only", ["lgpl3.notice"]), ("BSD-3-Clause", ["bsd.notice"]),
    ("MPL-2.0", ["mpl2.notice"]), ("CC-BY-4.0", ["ccby.notice"]), ("CC-BY-SA-4.0", ["ccbysa.notice"]), ("CC-BY-NC-4.0", ["ccbync.notice"]), ("CC0-1.0", ["cc0.notice"]), ("Unlicense", ["unlicense.public"]),
]
#: Each known sentence contains one of these.
KEY_WORDS = ("license", "permission", "permitted", "copyright", "software", "warranty")

#: Signs of the marked form: a sentence ends; a sentence may end or go on.
END, MAYBE = "|", ";"
OTHER = r"[^\p{L}\p{N}.|;]+"


def marked(text: Column) -> Column:
    """The normal form of a text with END and MAYBE between its sentences and lines."""
    out = F.regexp_replace(F.lower(text), r"\|", " ")
    # A line without a letter or digit is blank, whatever signs of a comment it has.
    # Possessive: such a group is matched in a loop, a greedy one by a call a line.
    out = F.regexp_replace(out, r"\n(?:[^\p{L}\p{N}\n;]*+\n)++", END)
    out = F.regexp_replace(out, r"[.!?]+\s+", END)
    out = F.regexp_replace(F.regexp_replace(out, r"\n", MAYBE), OTHER, " ")
    out = F.regexp_replace(out, r"[ .;]*\|[ ;|]*", END)
    return F.regexp_replace(F.regexp_replace(out, r"[ .]*;[ ;]*", MAYBE), r"^[ ;|]+|[ .;|]+$", "")


def _pattern(sentence: str) -> str:
    """A known sentence in the marked form; a full stop before a blank in it is cut there like any other."""
    ws = sentence.split(" ")
    return "".join(w if k == len(ws) - 1 else w.rstrip(".") + (r"\|" if w.endswith(".") else "[ ;]") for k, w in enumerate(ws)).replace(".", r"\.")


def known_sentences(text: Column) -> Column:
    """The normal form of each known sentence of a text, in order."""
    forms = "|".join(_pattern(s) for s in sorted(SENTENCES.values(), key=len, reverse=True))
    hits = F.regexp_extract_all(marked(text), F.lit(f"(?<![^|;])(?:{forms})(?![^|;])"), 0)
    return F.transform(hits, lambda s: F.regexp_replace(F.replace(s, F.lit(MAYBE), F.lit(" ")), r"\|", ". "))


def recognised(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (joined by commas), licenses (in rule order, joined by commas), n_known; a row a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    some = low.contains(KEY_WORDS[0])
    for word in KEY_WORDS[1:]:
        some = some | low.contains(word)
    known = F.create_map(*(F.lit(x) for i, s in SENTENCES.items() for x in (s, i)))
    ids = F.transform(known_sentences(text), lambda s: F.element_at(known, s))
    seq = docs.select("doc_id", F.when(some, ids).otherwise(F.array().cast("array<string>")).alias("ids"))
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit("," + ",".join(r) + ",").alias("key")) for n, r in RULES))

    def step(acc: Column, rule: Column) -> Column:
        here = acc["seq"].contains(rule["key"])
        return F.struct(
            F.when(here, F.replace(acc["seq"], rule["key"], F.lit(",,"))).otherwise(acc["seq"]).alias("seq"),
            F.when(here, F.array_union(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"),
        )

    start = F.struct(F.concat(F.lit(","), F.array_join(F.transform("ids", lambda x: F.concat(x, F.lit(","))), "")).alias("seq"), F.array().cast("array<string>").alias("found"))
    found = F.when(F.size("ids") > 0, F.aggregate(rules, start, step, lambda acc: acc["found"]))
    return seq.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.coalesce(F.array_join(found, ","), F.lit("")).alias("licenses"), F.size("ids").cast("long").alias("n_known"))


def oracle() -> str:
    """The same over DuckDB: lines are joined to the sentences that they begin, and followed line by line."""
    forms = ", ".join(f"('{i}', '{text.replace('. ', '|')} ')" for i, text in SENTENCES.items())
    steps, prev = [], "q"
    for n, (_, ids) in enumerate(RULES):
        key = "," + ",".join(ids) + ","
        steps.append(f"r{n} AS (SELECT *, contains(s{n}, '{key}') AS f{n}, CASE WHEN contains(s{n}, '{key}') THEN replace(s{n}, '{key}', ',,') ELSE s{n} END AS s{n + 1} FROM {prev})")
        prev = f"r{n}"
    # A licence stands at the place of its first rule that matched.
    hits = ", ".join(f"CASE WHEN f{i} THEN '{RULES[i][0]}' END" for i in range(len(RULES)))
    return f"""
WITH RECURSIVE f(sid, f) AS (VALUES {forms}),
d AS (SELECT doc_id, row_number() OVER () AS rid, lower(coalesce(text, '')) AS t FROM documents),
a1 AS (SELECT rid, regexp_replace(replace(t, '|', ' '), '\\n(?:[^\\p{{L}}\\p{{N}}\\n;]*\\n)+', '|', 'g') AS t FROM d),
a2 AS (SELECT rid, regexp_replace(replace(regexp_replace(t, '[.!?]+[\\t\\n\\x0B\\f\\r ]+', '|', 'g'), chr(10), ';'), '[^\\p{{L}}\\p{{N}}.|;]+', ' ', 'g') AS t FROM a1),
a3 AS (SELECT rid, regexp_replace(regexp_replace(regexp_replace(t, '[ .;]*\\|[ ;|]*', '|', 'g'), '[ .]*;[ ;]*', ';', 'g'), '^[ ;|]+|[ .;|]+$', '', 'g') AS t FROM a2),
a4 AS (SELECT rid, regexp_extract_all(t, '[^|;]+[|;]?') AS parts FROM a3),
a5 AS (SELECT rid, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM a4),
l AS (SELECT rid, k, rtrim(part, '|;') || ' ' AS ends, rtrim(part, '|;') || CASE WHEN suffix(part, '|') THEN '|' ELSE ' ' END AS goes FROM a5),
e(rid, i, j, sid, rest) AS (
  SELECT rid, k, k, sid, CASE WHEN f = ends THEN '' ELSE substr(f, length(goes) + 1) END FROM l JOIN f ON f = ends OR starts_with(f, goes)
  UNION ALL SELECT e.rid, e.i, l.k, e.sid, CASE WHEN e.rest = l.ends THEN '' ELSE substr(e.rest, length(l.goes) + 1) END FROM e JOIN l ON l.rid = e.rid AND l.k = e.j + 1 WHERE e.rest <> '' AND (e.rest = l.ends OR starts_with(e.rest, l.goes))),
m AS (SELECT rid, i, arg_max(j, length(f)) AS j, arg_max(sid, length(f)) AS sid FROM e JOIN f USING (sid) WHERE rest = '' GROUP BY rid, i),
g(rid, i, j, sid) AS (
  SELECT rid, min(i), arg_min(j, i), arg_min(sid, i) FROM m GROUP BY rid
  UNION ALL SELECT g.rid, n.i, n.j, n.sid FROM g, LATERAL (SELECT min(m.i) AS i, arg_min(m.j, m.i) AS j, arg_min(m.sid, m.i) AS sid FROM m WHERE m.rid = g.rid AND m.i > g.j) n WHERE n.i IS NOT NULL),
k AS (SELECT rid, list(sid ORDER BY i) AS ids FROM g GROUP BY rid),
q AS (SELECT doc_id, coalesce(ids, []::VARCHAR[]) AS ids, ',' || array_to_string(list_transform(coalesce(ids, []::VARCHAR[]), lambda x: x || ','), '') AS s0 FROM d LEFT JOIN k USING (rid)),
{", ".join(steps)},
z AS (SELECT doc_id, ids, list_filter([{hits}], lambda x: x IS NOT NULL) AS l FROM {prev})
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS licenses, len(ids)::BIGINT AS n_known FROM z
"""
