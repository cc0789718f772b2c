"""License scan with DataFrame functions only: a positional index of rare template words.

A template's rarest words (highest inverse document frequency over the templates) are looked up in a file's
words. Each hit at position p of a word that stands at offset o in the template votes for the start p - o; a
start with enough of the template's rare words, at which the mandatory phrase stands too, is a match.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.common import read

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separators of words before letters are lower-cased: everything in ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# fixed values: phrases of the contract and their labels
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# fixed values: public notice texts (label, text, mandatory phrase)
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction", "hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met", "source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted", "with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrase: tuple[str, ...]
    rare: tuple[tuple[str, int, float], ...]
    """(word, offset, weight) of its rarest distinct words."""

    @property
    def phrase_at(self) -> int:
        n = len(self.phrase)
        return next(k for k in range(len(self.words)) if self.words[k : k + n] == self.phrase)


def index(templates=TEMPLATES, rare: int = 6) -> list[Template]:
    """The templates with the positions of their `rare` highest-IDF words; ties by place in the text."""
    split = [(label, tuple(text.split()), tuple(phrase.split())) for label, text, phrase in templates]
    df = Counter(w for _, words, _ in split for w in set(words))
    out = []
    for label, words, phrase in split:
        idf = {w: math.log(1 + len(split) / df[w]) for w in words}
        first = sorted(set(words), key=lambda w: (-idf[w], words.index(w)))[:rare]
        out.append(Template(label, words, phrase, tuple((w, words.index(w), idf[w]) for w in first)))
    return out


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates=TEMPLATES, base=BASE, rare: int = 6,
         enough: float = 0.6) -> DataFrame:
    """Columns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row per row.

    Words are runs of digits, lower-cased letters and characters beyond ASCII. n_base counts every place where a
    base phrase stands, also where places overlap. labels adds those of templates with a start at which rare words
    of at least `enough` of the weight and the mandatory phrase stand; score is the best share of weight among
    the templates whose phrase was verified, 1 for a base phrase, else 0. Null texts are empty.

    Everything happens inside a row, and in time proportional to its words: a vote is kept only if the phrase
    stands where it says, and a kept start looks at each rare word's place once.
    """
    found = index(templates, rare)
    phrases = [tuple(p.split()) for p, _ in base]
    vocabulary = sorted({w for t in found for w, _, _ in t.rare} | {p[-1] for p in phrases})
    plain = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    look = F.lit(False)
    for phrase in dict.fromkeys([*phrases, *(t.phrase for t in found)]):
        here = F.lit(True)
        for w in sorted(set(phrase), key=lambda w: (-len(w), w)):
            here = here & F.contains(plain, F.lit(w))
        look = look | here

    split = F.split(F.concat(F.lit(" "), F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(" ")), SEPARATORS)
    one = docs.select(F.col(key).cast("long").alias("doc_id"), split.alias("_split"), look.alias("_look"))
    lowered = F.transform(F.slice("_split", 2, F.greatest(F.size("_split") - 2, F.lit(0))), lambda w: F.translate(w, UPPER, UPPER.lower()))
    one = one.select("doc_id", (F.size("_split") - 2).cast("long").alias("n_words"), F.when(F.col("_look"), lowered).alias("_words"))
    places = F.filter(
        F.transform(F.col("_words"), lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("w"), i.alias("p")))),
        lambda x: x.isNotNull(),
    )
    one = one.select("doc_id", "n_words", "_words", F.coalesce(places, F.array().cast("array<struct<w:string,p:int>>")).alias("_hits"))
    words, hits = F.col("_words"), F.col("_hits")

    def stands(start: Column, phrase: Column, size: Column | int) -> Column:
        return (start >= 0) & (F.slice(words, F.greatest(start, F.lit(0)) + 1, size) == phrase)

    def strings(values) -> Column:
        return F.array(*map(F.lit, values))

    def base_starts(phrase: tuple[str, ...]) -> Column:
        starts = F.transform(F.filter(hits, lambda h: h["w"] == phrase[-1]), lambda h: h["p"] - (len(phrase) - 1))
        return F.filter(starts, lambda s: stands(s, strings(phrase), len(phrase)))

    postings = {w: [(k, o) for k, t in enumerate(found) for x, o, _ in t.rare if x == w] for w in vocabulary}
    post = F.from_json(F.lit(json.dumps({w: [{"t": t, "o": o} for t, o in v] for w, v in postings.items()})), "map<string,array<struct<t:int,o:int>>>")
    told = F.from_json(
        F.lit(json.dumps([
            {"phrase": t.phrase, "at": t.phrase_at, "label": t.label, "total": sum(v for _, _, v in t.rare),
             "rare": [{"w": w, "o": o, "v": v} for w, o, v in t.rare]} for t in found
        ])),
        "array<struct<phrase:array<string>,at:int,label:string,total:double,rare:array<struct<w:string,o:int,v:double>>>>",
    )
    votes = F.flatten(F.transform(hits, lambda h: F.transform(
        post[h["w"]], lambda x: F.struct(x["t"].alias("t"), (h["p"] - x["o"]).alias("s"))
    )))

    def phrase_stands(v: Column) -> Column:
        t = F.get(told, v["t"])
        return stands(v["s"] + t["at"], t["phrase"], F.size(t["phrase"]))

    def weighed(v: Column) -> Column:
        t = F.get(told, v["t"])
        total = F.aggregate(t["rare"], F.lit(0.0), lambda acc, r: acc + F.when(
            (v["s"] + r["o"] >= 0) & (F.get(words, v["s"] + r["o"]) == r["w"]), r["v"]).otherwise(0.0))
        return F.struct(t["label"].alias("label"), (total / t["total"]).alias("share"))

    one = one.select(
        "doc_id", "n_words", *(base_starts(p).alias(f"_b{k}") for k, p in enumerate(phrases)),
        F.when(F.size(hits) > 0, F.array_distinct(F.filter(votes, phrase_stands))).alias("_kept"), "_words",
    )
    one = one.select("*", F.coalesce(F.transform("_kept", weighed), F.array().cast("array<struct<label:string,share:double>>")).alias("_found"))
    starts = F.flatten(F.array(*(F.col(f"_b{k}") for k in range(len(base)))))

    def listed(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    own = F.filter(F.array(*(F.when(F.size(f"_b{k}") > 0, label) for k, (_, label) in enumerate(base))), lambda x: x.isNotNull())
    added = F.transform(F.filter("_found", lambda x: x["share"] >= enough), lambda x: x["label"])
    return one.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        listed(own).alias("base_labels"), listed(F.concat(own, added)).alias("labels"),
        F.when(F.size(starts) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("_found", lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )


def _duck() -> str:
    """The same for the base columns and, by plain phrase search over the words, for labels and score."""
    found = index()
    words = (
        "string_split_regex(regexp_replace(regexp_replace(' ' || translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        "'abcdefghijklmnopqrstuvwxyz') || ' ', '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '^ | $', '', 'g'), ' ')"
    )

    def stands(start: str, phrase) -> str:
        return "(" + f"{start} >= 0 AND " + " AND ".join(f"coalesce(w[{start} + {k + 1}] = '{x}', false)" for k, x in enumerate(phrase)) + ")"

    spots = ", ".join(
        f"list_filter(range(len(w)), lambda s: {stands('s', p.split())}) AS b{k}" for k, (p, _) in enumerate(BASE)
    )
    parts = []
    for k, t in enumerate(found):
        total = sum(v for _, _, v in t.rare)
        weight = " + ".join(f"CASE WHEN {stands(f's + {o}', (w,))} THEN {v!r}::DOUBLE ELSE 0.0::DOUBLE END" for w, o, v in t.rare)
        starts = f"list_filter(range(-{t.phrase_at}, len(w)), lambda s: {stands(f's + {t.phrase_at}', t.phrase)})"
        parts.append(f"coalesce(list_max(list_transform({starts}, lambda s: (0.0::DOUBLE + {weight}) / {total!r}::DOUBLE)), 0.0) AS t{k}")
    own = [f"CASE WHEN len(b{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(BASE)]
    added = [f"CASE WHEN t{k} >= 0.6 THEN '{t.label}' END" for k, t in enumerate(found)]
    allb = " || ".join(f"b{k}" for k in range(len(BASE)))

    def listed(xs) -> str:
        return f"coalesce(array_to_string(list_sort(list_distinct([{', '.join(xs)}])), ','), '')"

    best = f"greatest({', '.join(f't{k}' for k in range(len(found)))})"
    return f"""
WITH a AS (SELECT doc_id, {words} AS v FROM documents),
b AS (SELECT doc_id, CASE WHEN v = [''] THEN [] ELSE v END AS w FROM a),
c AS (SELECT doc_id, len(w) AS n_words, {spots}, {', '.join(parts)} FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, len({allb})::BIGINT AS n_base, list_min({allb})::BIGINT AS first_word,
  list_max({allb})::BIGINT AS last_word, {listed(own)} AS base_labels, {listed(own + added)} AS labels,
  CASE WHEN len({allb}) > 0 THEN 1.0::DOUBLE ELSE {best} END AS score
FROM c"""


SQL = _duck()


def query(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
