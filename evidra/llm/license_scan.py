"""Licence scans by sentence rules, in DataFrame functions only.

Texts are cut into sentences (at blank lines and after . ! ? ; : before white space or the end), sentences are
normalised (lower case, runs of other characters than a-z and 0-9 as one space) and looked up in a fixed map
from known licence sentences to their ids. A line end may be the end of a sentence or only a wrap: a known sentence
is found where it begins and ends at line ends or cuts and has any line ends between its words. Lines of signs
only, such as an empty comment line, are blank; signs at the beginning of a line, such as comment marks, don't
matter. ``PUBLISHED`` has published sentences that go on where a known one ends, or are cut elsewhere. The ids found, in
order of the text, are matched against ordered rules: a rule holds where its ids follow one another among the
ids found, and a rule of more ids consumes those it matches before shorter ones are tried. Sentences that aren't known don't
break a sequence, as notices are often interrupted by names. A text that holds no rule but speaks of a licence has an unknown one.

Everything is a projection of one row, so nothing is shuffled. A text without any of the words that every
known sentence holds one of is not cut. Of known sentences that begin at one place the shortest is found, so a line that
is one is never taken as the beginning of a longer one; what is found doesn't overlap.

Defined cases: a null or empty text has no sentence and no licence; repeated rows are scanned one by one; rules
that hold are listed once each, in the order of their names, so ties need no other rule; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of common licence notices, and the licences they make in order.
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "licensed under the apache license version 2 0 the license",
    3: "you may not use this file except in compliance with the license",
    4: "you may obtain a copy of the license at",
    5: "released under the mit license",
    6: "licensed under the mit license",
    7: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    8: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    9: "the software is provided as is without warranty of any kind",
    10: "this work is licensed under the gnu general public license version 3",
    11: "this program is free software",
    12: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    13: "either version 3 of the license or at your option any later version",
    14: "either version 2 of the license or at your option any later version",
    15: "licensed under cc by nc 4 0",
    16: "licensed under cc by 4 0",
    17: "licensed under cc by sa 4 0",
    18: "this work is licensed under a creative commons attribution 4 0 international license",
    19: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    20: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    21: "all rights reserved",
    22: "this source code form is subject to the terms of the mozilla public license v 2 0",
    23: "licensed under cc by nc sa 4 0",
    24: "licensed under the gnu general public license version 2",
    25: "this work is dedicated to the public domain",
    26: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    27: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    28: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    29: "either version 2 1 of the license or at your option any later version",
    30: "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    31: "this library is free software",
    32: "gnu general public license version 3 29 june 2007",
    33: "gnu general public license version 2 june 1991",
    34: "gnu lesser general public license version 3 29 june 2007",
    35: "gnu lesser general public license version 2 1 february 1999",
    36: "gnu affero general public license version 3 19 november 2007",
    37: "apache license version 2 0 january 2004",
    38: "mozilla public license version 2 0",
    39: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
}
_GRANT = "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
_LATER = "of the license or at your option any later version"
#: Sentences as published and as they are cut, | for a cut within, and the ids they stand for.
PUBLISHED = {
    SENTENCES[7] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": [7],
    SENTENCES[9] + " express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": [9],
    f"{_GRANT} either version 3 {_LATER}": [12, 13],
    f"{_GRANT} either version 2 {_LATER}": [12, 14],
    "this source code form is subject to the terms of the mozilla public license v | 2 0": [22],
    f"{SENTENCES[28]} either version 3 {_LATER}": [28, 13],
    f"{SENTENCES[28]} either version 2 1 {_LATER}": [28, 29],
    f"{SENTENCES[30]} either version 3 {_LATER}": [30, 13],
    # A star stands for the name of a holder, of at most NAME words.
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": [20],
}
NAME = 12
RULES = {
    "apache-2.0": [[1], [2], [3, 4], [2, 3], [2, 3, 4], [37]],
    "mit": [[5], [6], [7, 8], [7, 9], [7, 8, 9]],
    "gpl-3.0": [[10], [11, 12, 13], [32]],
    "gpl-2.0": [[24], [11, 12, 14], [33]],
    "lgpl-3.0": [[11, 28, 13], [31, 28, 13], [34]],
    "lgpl-2.1": [[31, 28, 29], [11, 28, 29], [35]],
    "agpl-3.0": [[11, 30, 13], [36]],
    "cc-by-4.0": [[16], [18]],
    "cc-by-sa-4.0": [[17]],
    "cc-by-nc-4.0": [[15]],
    "cc-by-nc-sa-4.0": [[23]],
    "bsd-2-clause": [[19], [19, 26], [19, 26, 27]],
    "bsd-3-clause": [[19, 20], [19, 26, 20], [19, 26, 27, 20]],
    "isc": [[39]],
    "mpl-2.0": [[22], [38]],
    "proprietary": [[21]],
    "public-domain": [[25]],
}
#: What a sentence says that speaks of a licence; a text with one, but without a known licence, has an unknown one.
LIKE = "licensed under|under the terms of|permission is hereby granted"
UNKNOWN = "unknown"
#: Every known sentence holds one of these.
WORDS = ["licen", "permission", "permitted", "copyright", "software", "rights reserved", "public domain", "redistribut", "public", "as is"]
CUT = r"[.!?;:]+(\s|$)"
_CUT = "\x01"


def _folded(text: Column) -> Column:
    """A text in lower case with _CUT for cuts and blank lines, and runs of signs as one space but for line ends."""
    cut = F.regexp_replace(F.translate(F.lower(text), _CUT, " "), CUT, _CUT)
    blank = F.regexp_replace(cut, f"\n[^a-z0-9{_CUT}]*\n", _CUT)
    return F.regexp_replace(blank, f"[^a-z0-9\n{_CUT}]+", " ")


def _pattern(known: list[str]) -> str:
    """What matches known sentences in a folded text, wrapped or not."""
    word = {"|": f"[ \n]*{_CUT}[ \n]*", "*": f"[a-z0-9]+(?:[ \n]+[a-z0-9]+){{0,{NAME - 1}}}?"}
    one = ["".join(word.get(w, w) + ("[ \n]+" if after and "|" not in (w, after) else "") for w, after in zip(ws, [*ws[1:], ""])) for ws in map(str.split, sorted(known, key=len))]
    return f"(?<=^ ?|[\n{_CUT}] ?)(?:{'|'.join(one)})(?= ?(?:[\n{_CUT}]|$))"


def sentence_ids(text: Column, known: dict[int, str] = SENTENCES, published: dict[str, list[int]] = PUBLISHED) -> Column:
    """The ids of the known sentences of a text, in order."""
    every = {s: [i] for i, s in known.items()}
    for s, ids in published.items():
        every.setdefault(s, ids)
    plain = {" ".join(s.replace("|", " ").split()): ids for s, ids in every.items()}
    starred = [s.split(" * ") for s in plain if "*" in s]
    ids = F.create_map(*chain.from_iterable((F.lit(s), F.array(*map(F.lit, i))) for s, i in plain.items()))
    low = F.lower(text)
    told = F.lit(False)
    for w in _words(known):
        told = told | F.contains(low, F.lit(w))
    found = F.regexp_extract_all(_folded(text), F.lit(_pattern(list(every))), F.lit(0))

    def told_as(one: Column) -> Column:
        """A sentence as it is found, with its name as the star it matched."""
        one = F.regexp_replace(one, f"[ \n{_CUT}]+", " ")
        for before, after in starred:
            one = F.when(ids[one].isNull(), F.regexp_replace(one, f"^{before} .* {after}$", f"{before} * {after}")).otherwise(one)
        return one

    found = F.flatten(F.transform(found, lambda s: ids[told_as(s)]))
    return F.when(told, found).otherwise(F.array().cast("array<int>"))


def _words(known: dict[int, str]) -> list[str]:
    """Words of WORDS that the known sentences need; a sentence with none of them adds its longest word."""
    need = {next((w for w in WORDS if " " not in w and w in s), max(s.split(), key=len)) for s in known.values()}
    return sorted(need)


def _ways(rules: dict[str, list[list[int]]]) -> list[tuple[str, str]]:
    """Each way of a rule as it is held, with the rule's name: those of more sentences first, then by name."""
    every = [(way, name) for name, ways in rules.items() for way in ways]
    return [("".join(f",{i}," for i in way), name) for way, name in sorted(every, key=lambda w: (-len(w[0]), w[1], w[0]))]


def licenses(ids: Column, rules: dict[str, list[list[int]]] = RULES) -> Column:
    """The names of the rules that hold for a sequence of ids, by name, comma-joined.

    Ways of more sentences come first and consume what they match, so that the sentences of a longer notice aren't a shorter one, too.
    """
    held = F.concat(F.lit(","), F.array_join(ids.cast("array<string>"), ",,"), F.lit(","))
    begin = F.struct(held.alias("held"), F.array().cast("array<string>").alias("names"))
    ways = F.array(*(F.struct(F.lit(way).alias("way"), F.lit(name).alias("name")) for way, name in _ways(rules)))

    def match(acc: Column, w: Column) -> Column:
        there = F.contains(acc["held"], w["way"])
        return F.struct(F.replace(acc["held"], w["way"], F.lit("#")).alias("held"), F.when(there, F.array_union(acc["names"], F.array(w["name"]))).otherwise(acc["names"]).alias("names"))

    return F.when(F.size(ids) > 0, F.aggregate(ways, begin, match, lambda acc: F.array_join(F.array_sort(acc["names"]), ","))).otherwise("")


def speaks_of_one(text: Column, known: dict[int, str] = SENTENCES, published: dict[str, list[int]] = PUBLISHED) -> Column:
    """Whether a text speaks of a licence outside of its known sentences."""
    low = F.lower(text)
    rest = F.regexp_replace(_folded(text), _pattern([*known.values(), *published]), "")
    return F.when(F.contains(low, F.lit("licensed")) | F.contains(low, F.lit("under")) & F.contains(low, F.lit("terms")) | F.contains(low, F.lit("hereby")), F.regexp_like(F.regexp_replace(rest, "[ \n]+", " "), F.lit(LIKE))).otherwise(False)


def scan(docs: DataFrame) -> DataFrame:
    """Per document: ids of known sentences in order, their count, and the licences of the rules that hold, or UNKNOWN."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), sentence_ids(text).alias("ids")).withColumn("names", licenses(F.col("ids")))
    found = F.when((F.col("names") == "") & speaks_of_one(F.col("text")), F.lit(UNKNOWN)).otherwise(F.col("names"))
    return own.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("sentence_ids"), found.alias("licenses"))


def _oracle() -> str:
    known = ", ".join(f"({i}, '{s}')" for i, s in SENTENCES.items())
    held, flags = "',' || replace(coalesce(ids, ''), ',', ',,') || ','", []
    steps = []
    for k, (way, name) in enumerate(_ways(RULES)):
        steps.append(f"h{k} AS (SELECT *, CASE WHEN contains(held{k}, '{way}') THEN '{name}' END AS f{k}, replace(held{k}, '{way}', '#') AS held{k + 1} FROM {f'h{k - 1}' if k else 'told'})")
        flags.append(f"f{k}")
    return f"""
WITH known(id, sentence) AS (VALUES {known}),
cut AS (
  SELECT doc_id, string_split(regexp_replace(lower(coalesce(text, '')), '[.!?;:]+(\\s|$)', chr(10), 'g'), chr(10)) AS lines FROM documents
), each_one AS (
  SELECT doc_id, pos, trim(regexp_replace(lines[pos], '[^a-z0-9]+', ' ', 'g')) AS sentence
  FROM cut, unnest(range(1, len(lines) + 1)) AS u(pos)
), found AS (
  SELECT doc_id, string_agg(id::VARCHAR, ',' ORDER BY pos) AS ids, count(*) AS n FROM each_one JOIN known USING (sentence) GROUP BY doc_id
), like_one AS (
  SELECT DISTINCT doc_id FROM each_one WHERE regexp_matches(sentence, '{LIKE}') AND sentence NOT IN (SELECT sentence FROM known)
), told AS (
  SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, {held} AS held0, l.doc_id IS NOT NULL AS speaks
  FROM documents LEFT JOIN found USING (doc_id) LEFT JOIN like_one l ON l.doc_id = documents.doc_id
), {", ".join(steps)}, named AS (
  SELECT *, array_to_string(list_sort(list_distinct(list_filter([{", ".join(flags)}], lambda x: x IS NOT NULL))), ',') AS names FROM h{len(steps) - 1}
)
SELECT doc_id, n_sentences, sentence_ids, CASE WHEN names = '' AND speaks THEN '{UNKNOWN}' ELSE names END AS licenses FROM named
"""


ORACLE_SQL = _oracle()
