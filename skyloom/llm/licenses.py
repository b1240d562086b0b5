"""Licence scan by a positional index of rare words, in DataFrame functions only.

A template is a passage of a licence with its mandatory key phrases. The index posts each template
under its words of highest inverse document frequency (IDF over the templates), with their positions.
In a text, the places of those words less the posted positions say where a template would have to
start. A template is looked up by its three rarest words: the starts on which two of them agree are
kept, so that one of the three may be missing or changed. Around such a start (up to SLACK words of
shift for passages, none for phrases) the other posted words are counted and every key phrase is
verified word by word; the template's label is given where all its key phrases stand.

The starts of two words are intersected as sets of cells, and what is read around a start is bounded,
so the work is linear in the text even if it repeats a licence word at every place.

score is the best share of posted words and key phrases that stand at any start of any template.

Defined results: null or empty text has 0 words, no places and score 0; repeated rows give repeated
rows; a null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANCHORS, POSTED, SLACK = 3, 6, 8

# Fixed values: (label, phrase). The first three are the base phrases.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
EXTRA = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "mozilla public license version 2"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("unlicense", "free and unencumbered software released into the public domain"),
]
# Fixed values: (label, passage, key phrases), the words of public licence notices.
NOTICES = [
    (
        "mit",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        ["deal in the software without restriction", "use copy modify merge publish distribute sublicense and or sell copies"],
    ),
    (
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
        ["except in compliance with the license", "unless required by applicable law or agreed to in writing"],
    ),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ["must retain the above copyright notice", "must reproduce the above copyright notice"],
    ),
    (
        "bsd-3",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ["to endorse or promote products derived from this software"],
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ["gnu general public license as published by the free software foundation", "at your option any later version"],
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ["subject to the terms of the mozilla public license v 2 0"],
    ),
    (
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented",
        ["including commercial applications and to alter it and redistribute it freely"],
    ),
    (
        "bsl-1",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        ["use reproduce display distribute execute and transmit the software"],
    ),
    (
        "cc0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        ["waived all copyright and related or neighboring rights"],
    ),
    (
        "unlicense",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ["free to copy modify publish use compile sell or distribute this software"],
    ),
]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    """A passage with the words it is posted under, and its key phrases with their places, rarest words first."""

    label: str
    posted: list[tuple[str, int]]
    keys: list[tuple[list[str], int]]
    slack: int

    @property
    def anchors(self) -> list[tuple[str, int]]:
        return self.posted[:ANCHORS]

    @property
    def width(self) -> int:
        return max(self.slack, 1)

    def reach(self, place: int) -> tuple[int, int]:
        """The first and last place, counted from the first word of a cell of starts, where a word of the template may stand."""
        return (place - self.slack, place + 2 * self.slack) if self.slack else (place, place)


def _place(words: list[str], part: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(part)] == part)


def templates_of(base, extra, notices, slack: int = SLACK) -> list[Template]:
    """The index: each template under its POSTED words of highest IDF (ties: words that it has once, longer, earlier ones)."""
    raw = [(label, p.split(), [p.split()], 0) for label, p in (*base, *extra)] + [(label, p.split(), [k.split() for k in keys], slack) for label, p, keys in notices]
    df = Counter(w for _, words, _, _ in raw for w in set(words))
    out = []
    for label, words, keys, room in raw:
        order = sorted(dict.fromkeys(words), key=lambda w: (words.count(w) > 1, -math.log(len(raw) / df[w]), -len(w), words.index(w)))
        out.append(Template(label, [(w, words.index(w)) for w in order[:POSTED]], [(k, _place(words, k)) for k in keys], room))
    return out


def word_string(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z, with one space between.

    lower() also maps the Kelvin sign to k, so that sign is made another letter first.
    """
    t = F.lower(F.translate(F.coalesce(text, F.lit("")), "K", "ā"))
    return F.trim(F.regexp_replace(t, SEPARATORS, " "))


def _cells(word: str, position: int, width: int) -> Column:
    """The cells of the starts that a word of the text names."""
    return F.transform(F.filter("at", lambda x: x["w"] == word), lambda x: F.floor((x["i"] - position) / width).cast("int"))


def _candidates(t: Template) -> Column:
    """The cells of starts on which two of the template's rarest words agree."""
    cells = [_cells(w, p, t.width) for w, p in t.anchors]
    if len(cells) == 1:
        return F.array_distinct(cells[0])
    near = (lambda c: F.flatten(F.transform(c, lambda x: F.array(x - 1, x, x + 1)))) if t.slack else (lambda c: c)
    return reduce(F.array_union, [F.array_intersect(a, near(b)) for a, b in combinations(cells, 2)])


def _places(t: Template) -> Column:
    """(start, share, whole) of each candidate: what stands of the posted words and key phrases, and whether all key phrases do."""

    def stands(cell: Column, place: int, test) -> Column:
        lo, hi = t.reach(place)
        first = cell * t.width
        some = F.filter(F.sequence(first + lo, first + hi), lambda q: (q >= 0) & test(q)) if lo < hi else F.filter(F.array(first + lo), lambda q: (q >= 0) & test(q))
        return F.when(F.size(some) > 0, 1).otherwise(0)

    def verified(cell: Column) -> Column:
        words = [stands(cell, p, lambda q, w=w: F.coalesce(F.get("words", q) == w, F.lit(False))) for w, p in t.posted]
        keys = [stands(cell, p, lambda q, k=k: F.slice("words", F.greatest(q, F.lit(0)) + 1, len(k)) == F.array(*[F.lit(w) for w in k])) for k, p in t.keys]
        found, every = sum(words[1:], words[0]), sum(keys[1:], keys[0])
        return F.struct((cell * t.width).cast("long").alias("start"), ((found + every) / float(len(words) + len(keys))).alias("share"), (every == len(keys)).alias("whole"))

    return F.transform(_candidates(t), verified)


def scan_licenses(docs: DataFrame, base=BASE, extra=EXTRA, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row."""
    index = templates_of(base, extra, notices)
    rare = sorted({w for t in index for w, _ in t.anchors})
    d = docs.select("doc_id", word_string(F.col("text")).alias("s"))
    seen = F.col("s").rlike(r"(?:^| )(?:" + "|".join(rare) + r")(?: |$)")
    d = d.select(
        "doc_id",
        F.when(F.col("s") == "", 0).otherwise(F.length("s") - F.length(F.replace("s", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.when(seen, F.split("s", " ", -1)).otherwise(F.array().cast("array<string>")).alias("words"),
    )
    # One array of places for each rare word: the positional postings of the text.
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(rare), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull())
    d = d.select("*", at.alias("at"))
    places = [f"p{k}" for k in range(len(index))]
    d = d.select("doc_id", "n_words", *[_places(t).alias(name) for name, t in zip(places, index, strict=True)])
    whole = lambda k: F.filter(F.col(places[k]), lambda x: x["whole"])
    n = len(base)
    starts = F.transform(F.concat(*[whole(k) for k in range(n)]), lambda x: x["start"])
    label = lambda ks: F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(whole(k)) > 0, F.lit(index[k].label)) for k in ks]), lambda x: x.isNotNull()))), ",")
    shares = F.transform(F.concat(*[F.col(p) for p in places]), lambda x: x["share"])
    d = d.select("doc_id", "n_words", starts.alias("starts"), label(range(n)).alias("base_labels"), label(range(len(index))).alias("labels"), F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"))
    return d.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"), "base_labels", "labels", "score",
    )


def oracle_sql(base=BASE, extra=EXTRA, notices=NOTICES) -> str:
    """DuckDB SQL for the same rows."""
    index = templates_of(base, extra, notices)
    rare = sorted({w for t in index for w, _ in t.anchors})
    sql_list = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    candidates, verified = [], []
    for k, t in enumerate(index):
        cells = [f"list_transform(list_filter(rare, lambda i: w[i + 1] = '{w}'), lambda i: floor((i - {p}) / {t.width})::bigint)" for w, p in t.anchors]
        near = lambda c, t=t: f"flatten(list_transform({c}, lambda x: [x - 1, x, x + 1]))" if t.slack else c
        both = [f"list_filter({a}, lambda x: list_contains({near(b)}, x))" for a, b in combinations(cells, 2)] or cells
        candidates.append(f"list_distinct({' || '.join(both)}) as c{k}")

        def stands(place: int, test: str, t=t) -> str:
            lo, hi = t.reach(place)
            return f"(case when len(list_filter(range(c * {t.width} + {lo}, c * {t.width} + {hi} + 1), lambda q: q >= 0 and {test})) > 0 then 1 else 0 end)"

        words = " + ".join(stands(p, f"coalesce(w[q + 1] = '{x}', false)") for x, p in t.posted)
        keys = " + ".join(stands(p, f"w[q + 1 : q + {len(x)}] = {sql_list(x)}") for x, p in t.keys)
        verified.append(f"list_transform(c{k}, lambda c: {{'start': c * {t.width}, 'share': ({words} + {keys}) / {len(t.posted) + len(t.keys)}.0::double, 'whole': {keys} = {len(t.keys)}}}) as p{k}")
    whole = lambda k: f"list_filter(p{k}, lambda x: x.whole)"
    labels = lambda ks: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"case when len({whole(k)}) > 0 then '{index[k].label}' end" for k in ks) + "], lambda x: x is not null))), ',')"
    n = len(base)
    all_p = " || ".join(f"p{k}" for k in range(len(index)))
    base_p = " || ".join(whole(k) for k in range(n))
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with words as (
  select doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{low}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
  from documents
), posted as (
  select doc_id, w, list_filter(range(0, len(w)), lambda i: w[i + 1] in ({", ".join(f"'{x}'" for x in rare)})) as rare from words
), cells as (
  select doc_id, w, {", ".join(candidates)} from posted
), places as (
  select doc_id, w, {", ".join(verified)} from cells
), found as (
  select doc_id, len(w)::bigint as n_words, list_transform({base_p}, lambda x: x.start) as starts,
    {labels(range(n))} as base_labels, {labels(range(len(index)))} as labels,
    coalesce(list_max(list_transform({all_p}, lambda x: x.share)), 0.0)::double as score
  from places
)
select doc_id, n_words, len(starts)::bigint as n_base, list_min(starts)::bigint as first_word,
  list_max(starts)::bigint as last_word, base_labels, labels, score from found"""
