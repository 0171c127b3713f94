"""License scans with a positional rare-token index, in SQL functions alone.

Templates are licence texts with mandatory key phrases, or phrases alone. Files are split into words
once; their words that any template has are kept with their places. Document frequencies of these
words are counted over the whole table. The index posts the two words of highest IDF of each phrase
as word -> (phrase, offset). Each file looks up those of its licence words that are posted; a phrase
can start where both postings agree by relative position, and does where all its words stand. A text
is found where all its key phrases stand at their places in it and enough of its other words do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

NAME = "op4_license_scan"


@dataclass(frozen=True)
class Template:
    """A label that stands where `key` stands; with `text`, only where `must` and enough of text's words surround it.

    `key` and `must` are phrases of at least two words, of the text if there is one.
    """

    label: str
    key: str
    text: str = ""
    must: tuple[str, ...] = ()
    base: bool = False


TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("agpl", "gnu affero general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mpl", "mozilla public license"),
    Template("bsd", "bsd license"),
    Template("isc", "isc license"),
    Template("epl", "eclipse public license"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "cc0 1 0"),
    Template("proprietary", "all rights reserved"),
    Template("gpl-2.0", "gnu general public license", "licensed under the gnu general public license version 2", ("version 2",)),
    Template("gpl-3.0", "gnu general public license", "licensed under the gnu general public license version 3", ("version 3",)),
    Template("apache-2.0", "apache license", "licensed under the apache license version 2 0", ("version 2 0",)),
    Template(
        "apache-2.0", "except in compliance with the license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at", ("apache license",),
    ),
    Template(
        "gpl-2.0", "under the terms of the gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
        "by the free software foundation either version 2 of the license or at your option any later version", ("version 2 of the license",),
    ),
    Template(
        "gpl-3.0", "under the terms of the gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
        "by the free software foundation either version 3 of the license or at your option any later version", ("version 3 of the license",),
    ),
    Template(
        "mpl-2.0", "mozilla public license v 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
        "file you can obtain one at", ("source code form",),
    ),
    Template(
        "mit-text", "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions", ("to deal in the software without restriction",),
    ),
    Template(
        "bsl-1.0", "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
        ("person or organization",),
    ),
    Template(
        "isc-text", "permission to use copy modify and or distribute this software",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies", ("with or without fee",),
    ),
    Template(
        "bsd-2-clause", "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
        "are met", ("following conditions are met",),
    ),
    Template(
        "bsd-3-clause", "used to endorse or promote products derived from this software",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission", ("prior written permission",),
    ),
    Template(
        "zlib", "in no event will the authors be held liable",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
        "arising from the use of this software", ("express or implied warranty",),
    ),
    Template(
        "unlicense", "free and unencumbered software released into the public domain",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software", ("anyone is free",),
    ),
    Template(
        "cc-by-4.0", "creative commons attribution 4 0 international",
        "this work is licensed under a creative commons attribution 4 0 international license", ("licensed under",),
    ),
)

#: Share of a text's words that must stand at their places.
COVERAGE = 0.75
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def phrases_of(templates: tuple[Template, ...]) -> list[str]:
    return sorted({p for t in templates for p in (t.key, *t.must)})


def _offset(text: list[str], phrase: list[str]) -> int:
    """Where a phrase stands in a text first."""
    return next(i for i in range(len(text)) if text[i : i + len(phrase)] == phrase)


def _strings(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, with A-Z lowered.

    Lowering other letters too changes neither the runs nor any match, except for the Kelvin sign,
    whose lower case is an ASCII letter; it is replaced before.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e5")))
    return F.regexp_extract_all(plain, F.lit(_WORD), F.lit(0))


def licence_words(df: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n_words, hits) per row: hits are (p, w), places and words, of the words in the vocabulary."""
    tokens = df.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    listed = ", ".join(f"'{v}'" for v in vocabulary)
    places = f"if(size(w) = 0, cast(array() as array<int>), filter(sequence(0, size(w) - 1), i -> get(w, i) in ({listed})))"
    return tokens.select("doc_id", F.size("w").cast("long").alias("n_words"), F.expr(f"transform({places}, i -> struct(i as p, get(w, i) as w))").alias("hits"))


def frequencies(files: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each vocabulary word stands; the result is as small as the vocabulary."""
    found = files.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("word"))
    counts = {r.word: r.n for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {v: counts.get(v, 0) for v in vocabulary}


def postings(phrases: list[str], frequency: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """word -> (phrase, offset, rank): of each phrase the word of highest IDF (rank 0) and the next (rank 1)."""
    out: dict[str, list[tuple[int, int, int]]] = {}
    for n, phrase in enumerate(phrases):
        parts = phrase.split()
        for rank, at in enumerate(sorted(range(len(parts)), key=lambda i: (frequency[parts[i]], i))[:2]):
            out.setdefault(parts[at], []).append((n, at, rank))
    return out


def phrase_places(files: DataFrame, phrases: list[str], index: dict[str, list[tuple[int, int, int]]]) -> DataFrame:
    """files with found: (t, i, s) for each place of a phrase: its number, first hit and first word.

    All words of a phrase are hits, so that its words are neighbours among the hits too, and a place
    is looked up and verified by number of hit, in constant time a word.
    """
    rare = ", ".join(f"'{w}'" for w in sorted(index))
    posted = "map(" + ", ".join(
        f"'{w}', array({', '.join(f'struct({t} as t, {o} as o, {r} as r)' for t, o, r in posts)})" for w, posts in sorted(index.items())
    ) + ")"
    texts = "array(" + ", ".join(_strings(p.split()) for p in phrases) + ")"
    asked = files.withColumn("at", F.expr(f"if(size(hits) = 0, cast(array() as array<int>), filter(sequence(0, size(hits) - 1), k -> get(hits, k).w in ({rare})))"))
    starts = asked.withColumn("starts", F.expr(
        f"flatten(transform(at, k -> transform(element_at({posted}, get(hits, k).w), e -> struct(e.t as t, k - e.o as i, e.r as r))))"
    ))
    # Phrase and start as one number, of which sets are hashed; no start lies more than a phrase before the first hit.
    shift = max(len(p.split()) for p in phrases)
    agreed = "array_intersect({0}, {1})".format(*(f"transform(filter(starts, x -> x.r = {r}), x -> x.t * {1 << 32} + x.i + {shift})" for r in (0, 1)))
    agreed = f"transform({agreed}, c -> struct(cast(c div {1 << 32} as int) as t, cast(c % {1 << 32} as int) - {shift} as i))"
    word = "get(hits, c.i + j).w = get(get(texts, c.t), j) and get(hits, c.i + j).p = get(hits, c.i).p + j".replace("texts", texts)
    checked = starts.withColumn("agreed", F.expr(f"if(size(starts) = 0, cast(array() as array<struct<t:int,i:int>>), {agreed})"))
    found = f"filter(agreed, c -> forall(sequence(0, size(get({texts}, c.t)) - 1), j -> coalesce({word}, false)))"
    return checked.withColumn("found", F.expr(f"transform({found}, c -> struct(c.t as t, c.i as i, get(hits, c.i).p as s))")).drop("at", "starts", "agreed")


def template_tests(templates: tuple[Template, ...], phrases: list[str]) -> list[str]:
    """One SQL condition over (hits, found) per template."""
    number = {p: n for n, p in enumerate(phrases)}
    tests = []
    for t in templates:
        keys = f"filter(found, x -> x.t = {number[t.key]})"
        if not t.text:
            tests.append(f"exists(found, x -> x.t = {number[t.key]})")
            continue
        text, off = t.text.split(), _offset(t.text.split(), t.key.split())
        starts = [f"transform(filter(found, x -> x.t = {number[p]}), x -> x.s - {_offset(text, p.split())})" for p in (t.key, *t.must)]
        both = starts[0]
        for more in starts[1:]:
            both = f"array_intersect({both}, {more})"
        window = f"slice(hits, greatest(x.i - {off}, 0) + 1, {off + len(text)})"
        right = f"h -> h.p >= x.s - {off} and h.p < x.s - {off} + {len(text)} and get({_strings(text)}, h.p - x.s + {off}) = h.w"
        enough = f"exists({keys}, x -> array_contains(starts, x.s - {off}) and size(filter({window}, {right})) >= {COVERAGE} * {len(text)})"
        tests.append(f"coalesce(get(transform(array({both}), starts -> {enough}), 0), false)")  # starts are found once
    return tests


def license_scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, empty labels, score 0 and null places. score is m / (m + 4)
    with m the words of the distinct matched phrases and texts. Rows are independent but for the
    counts of words, so repeated rows and null ids give results of their own; an empty table gives
    no rows, and other columns are ignored.
    """
    phrases = phrases_of(templates)
    vocabulary = sorted({w for t in templates for p in (t.key, *t.must, t.text) for w in p.split()})
    files = written(licence_words(df, vocabulary), "license-words")
    placed = phrase_places(files, phrases, postings(phrases, frequencies(files, vocabulary)))
    base = [t for t in templates if t.base]
    listed = ", ".join(str(phrases.index(t.key)) for t in base)
    tests = template_tests(templates, phrases)
    none = "cast(array() as array<struct<label:string,base:boolean,n:int>>)"
    hits = ", ".join(
        f"if({test}, struct('{t.label}' as label, {str(t.base).lower()} as base, {len((t.text or t.key).split())} as n), null)" for t, test in zip(templates, tests, strict=True)
    )
    step = placed.select(
        "doc_id", "n_words", F.expr(f"transform(filter(found, x -> x.t in ({listed})), x -> x.s)").alias("b"),
        F.expr(f"if(size(found) = 0, {none}, array_compact(array({hits})))").alias("m"),
    )
    total = F.aggregate("m", F.lit(0), lambda a, x: a + x["n"])
    return step.select(
        "doc_id", "n_words", F.size("b").cast("long").alias("n_base"), F.array_min("b").cast("long").alias("first_word"), F.array_max("b").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("m", lambda x: x["base"]), lambda x: x["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda x: x["label"]))), ",").alias("labels"),
        (total / (total + F.lit(4.0))).alias("score"),
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL of license_scan, which tries every word of a text as a start."""
    phrases = phrases_of(templates)
    column = {p: f"p{n}" for n, p in enumerate(phrases)}

    def at(j: int, word: str) -> str:
        return f"coalesce(list_extract(w, i + {j + 1}) = '{word}', false)"

    lists = ", ".join(f"list_filter(range(len(w)), lambda i: {' and '.join(at(j, x) for j, x in enumerate(p.split()))}) AS {column[p]}" for p in phrases)
    tests = []
    for t in templates:
        if not t.text:
            tests.append(f"len({column[t.key]}) > 0")
            continue
        text = t.text.split()
        off = _offset(text, t.key.split())
        must = " and ".join(f"list_contains({column[p]}, i - {off} + {_offset(text, p.split())})" for p in t.must)
        share = f"len(list_filter(range(0, {len(text)}), lambda j: i - {off} + j >= 0 and coalesce(list_extract(w, i - {off} + j + 1) = list_extract([{', '.join(repr(x) for x in text)}], j + 1), false)))"
        tests.append(f"len(list_filter({column[t.key]}, lambda i: {must or 'true'} and {share} >= {COVERAGE} * {len(text)})) > 0")

    def labels(which):
        return f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(which)}], lambda x: x IS NOT NULL))), ',')"

    named = [f"CASE WHEN {test} THEN '{t.label}' END" for t, test in zip(templates, tests, strict=True)]
    weight = " + ".join(f"CASE WHEN {test} THEN {len((t.text or t.key).split())} ELSE 0 END" for t, test in zip(templates, tests, strict=True))
    base = " || ".join(column[t.key] for t in templates if t.base)
    return rf"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (SELECT doc_id, w, {lists} FROM t
), r AS (
  SELECT doc_id, len(w) AS n_words, {base} AS b, {labels([n for n, t in zip(named, templates) if t.base])} AS base_labels,
         {labels(named)} AS labels, {weight} AS m FROM p
)
SELECT doc_id, n_words, len(b) AS n_base, list_min(b) AS first_word, list_max(b) AS last_word, base_labels, labels, m / (m + 4.0) AS score FROM r
"""


ORACLE_SQL = oracle()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
