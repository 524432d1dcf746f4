"""License scans: phrases word by word, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words are runs of digits, a-z (after lowering A-Z) and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
#: The method's templates, as (label, words that a block must have, text of the notice).
TEMPLATES = (
    ("mit", "mit license", "released under the MIT license"),
    ("mit", "granted charge software", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("mit", "granted charge software", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "apache 2", "licensed under the Apache License, Version 2.0"),
    ("apache-2", "apache 2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied."""),
    ("bsd", "redistribution binary", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "redistributions binary", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
        of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("cc-by", "attribution", "licensed under the Creative Commons Attribution license"),
    ("cc-by-nc", "cc nc", "licensed under CC BY-NC 4.0"),
    ("gpl-3", "gnu 3", "this work is licensed under the GNU General Public License version 3"),
    ("gpl", "gnu", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation"""),
    ("gpl", "gnu warranty", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
)
#: Share of a template's distinct words that a block must hold, and words of a block for each word of the template.
CONTAINMENT, SPAN = 0.8, 1.25


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def parsed(templates=TEMPLATES, threshold: float = CONTAINMENT) -> list[dict]:
    """label, must and tokens (distinct words, sorted), need (how many of them) and length of a block, per template."""
    out = []
    for label, must, text in templates:
        w = words_of(text)
        tokens = sorted(set(w))
        out.append({"label": label, "must": must.split(), "tokens": tokens, "need": -int(-len(tokens) * threshold // 1), "length": -int(-len(w) * SPAN // 1)})
    return out


def _let(value: Column, f) -> Column:
    """``f(value)``, with the value worked out once: transform over an array of one binds it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def token_order(docs: DataFrame, text: Column, templates=TEMPLATES) -> list[str]:
    """The templates' words from the rarest to the most frequent over all documents (documents with the word; ties by the word)."""
    vocabulary = sorted({w for t in parsed(templates) for w in t["tokens"]})
    counted = docs.select(F.explode(F.array_intersect(_strings(vocabulary), F.split(text, GAP))).alias("w")).groupBy("w").count().collect()  # a row per template word at most
    n = {r["w"]: r["count"] for r in counted}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def similar(words: Column, order: list[str], templates=TEMPLATES, threshold: float = CONTAINMENT) -> Column:
    """Array of (label, score) for the blocks of ``words`` and the templates that reach ``threshold``.

    A block is any run of as many words as the template has and a quarter more, wherever lines break. The templates are a constant
    inverted index, so the join needs no shuffle: a word among a template's |T| - need + 1 rarest by the global order points to it
    (prefix filter). The words around it, as far as a block reaches, must have enough words of the templates (length filter) and
    enough of them from this one on in the global order (positional filter). What passes is verified by the whole overlap
    of every block around the word that begins with a word of the template: other blocks hold no more of it."""
    rank = {w: i for i, w in enumerate(order)}
    index, pointers = [], {}
    for k, t in enumerate(parsed(templates, threshold)):
        tokens = sorted(t["tokens"], key=rank.__getitem__)
        index.append(F.struct(
            F.lit(t["label"]).alias("label"), _strings(t["must"]).alias("must"), _strings(tokens).alias("tokens"), F.lit(t["need"]).alias("need"), F.lit(t["length"]).alias("length")))
        for i, w in enumerate(tokens[: len(tokens) - t["need"] + 1]):
            pointers.setdefault(w, []).append(F.struct(F.lit(k + 1).alias("t"), F.lit(len(tokens) - i).alias("left")))
    found_by = F.create_map(*[x for w, p in pointers.items() for x in (F.lit(w), F.array(*p))])
    vocabulary = _strings(order)

    def match(at, pointer):
        def against(t):
            first = F.greatest(at - t["length"] + 1, F.lit(0))
            has_all = lambda b: F.size(F.array_except(t["must"], b)) == 0
            starts = F.filter(F.sequence(first, at), lambda s: F.array_contains(t["tokens"], F.get(words, s)))
            overlap = lambda b: F.when(has_all(b), F.size(F.array_intersect(t["tokens"], b)))
            best = F.array_max(F.transform(starts, lambda s: _let(F.slice(words, s + 1, t["length"]), overlap)))
            around = F.array_intersect(vocabulary, F.slice(words, first + 1, at - first + t["length"]))
            enough = lambda s: (F.size(s) >= t["need"]) & (F.least(pointer["left"], F.size(s) - F.array_position(s, F.get(words, at)) + 1) >= t["need"]) & has_all(s)
            passed = F.when(_let(around, enough), best)
            return _let(passed, lambda n: F.when(n >= t["need"], F.struct(t["label"].alias("label"), (n / F.size(t["tokens"])).alias("score"))))

        return _let(F.element_at(F.array(*index), pointer["t"]), against)

    anchors = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(*pointers))
    matches = F.flatten(F.transform(anchors, lambda i: F.filter(F.transform(F.element_at(found_by, F.get(words, i)), lambda p: match(i, p)), lambda m: m.isNotNull())))
    return F.when(F.size(words) > 0, matches)


def places(words: Column, phrase: str) -> Column:
    """Starts (from 0) of the places where a phrase's words stand one after the other."""
    p = phrase.split()

    def here(i):
        hit = F.get(words, i) == p[0]
        for k, w in enumerate(p[1:], 1):
            hit = hit & (F.coalesce(F.get(words, i + k), F.lit("")) == w)
        return hit

    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), here)


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = CONTAINMENT) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per document.

    A null text is an empty one: no words, places null, labels empty, score 0. Score: the highest containment of a
    template in a block, if it reaches the threshold; 1 where a base phrase stands; else 0. Rows are
    treated one by one, so repeats, ties and other columns don't matter; one pass over the corpus counts the words."""
    t = docs.select("doc_id", common.lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    order = token_order(t, F.col("t"), templates)
    # a phrase can only be where the text has its words with gaps between; only such texts are searched word by word
    maybe = F.lit(False)
    for p in phrases.values():
        maybe = maybe | F.col("t").rlike(GAP.join(p.split()))
    none = F.array().cast("array<string>")

    def measured(w):
        per_phrase = F.array(*[F.struct(F.lit(k).alias("label"), places(w, p).alias("at")) for k, p in phrases.items()])
        base = F.when(maybe, F.filter(per_phrase, lambda b: F.size(b["at"]) > 0))
        return F.struct(F.size(w).cast("long").alias("n_words"), base.alias("base"), similar(w, order, templates, threshold).alias("found"))

    m = t.select("doc_id", _let(F.filter(F.split("t", GAP), lambda w: w != ""), measured).alias("m")).select(
        "doc_id", "m.n_words", F.coalesce("m.base.label", none).alias("bl"), F.flatten("m.base.at").alias("at"), F.coalesce("m.found.label", none).alias("ml"), F.array_max("m.found.score").alias("best"))
    return m.select(
        "doc_id", "n_words", F.when(F.col("at").isNull(), 0).otherwise(F.size("at")).cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("bl"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("bl", "ml")), ",").alias("labels"),
        F.when(F.size("bl") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
