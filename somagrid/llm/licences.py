"""Licence scan: Dice coefficient over word bigrams against templates, in DataFrame functions only.

A unit (each line, and the whole text) is normalised to lower-case words.  The
Dice coefficient of two bigram sets of sizes a and b is at most
2 min(a, b) / (a + b), so a template only meets units whose size lies within
t / (2 - t) of its own; most units meet none.  The result has one row per
document with its best template, ties to the smaller name.

Notices that are wrapped over lines or stand inside longer text are found as
spans: windows over the words of the whole text, against the templates and the
headers and whole texts of ``NOTICES``.  A window has at most (2 - t) / t times
the template's length.  Only windows that begin and end with a run of the
template's bigrams are scored, as a further bigram of the template never lowers
the coefficient.  ``n_units`` counts the matching lines and whole text, and each
licence that only spans hold once.

Null, empty and wordless texts, and units of one word, match nothing.
Repeated rows each give a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from somagrid.llm.notices import NOTICES

DICE = 0.8
#: Short notices of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def normal_words(text: str) -> list[str]:
    """Normalised words of a template, by the rule of :func:`_words`."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _words(unit: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " ")), " ")


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))))


def match(docs: DataFrame, templates: dict[str, str] = TEMPLATES, dice: float = DICE, id_col: str = "doc_id", text_col: str = "text",
          notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """(doc_id, licence, dice, n_units): best template of each document, its coefficient and how many units match any."""
    grams = {k: sorted({f"{a} {b}" for a, b in zip(w, w[1:])}) for k, w in ((k, normal_words(t)) for k, t in templates.items())}
    ratio = dice / (2 - dice)
    least, most = min(map(len, grams.values())) * ratio, max(map(len, grams.values())) / ratio
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a unit of n distinct bigrams has n + 1 words and so 2 n + 1 characters at least; repeats only make it longer
    short = int(2 * least)
    hint = "(?i)" + "|".join(sorted({w for t in templates.values() for w in hint_words(normal_words(t), ratio)}))
    lines = F.filter(F.split(text, "\n"), lambda x: (F.length(x) >= short) & x.rlike(hint))
    units = F.when(text.rlike(hint), F.array_distinct(F.concat(lines, F.array(text))))
    best = F.transform(units, lambda u: _best(u, grams, ratio, dice, least, most))
    hits = F.filter(best, lambda x: x.isNotNull())
    spans = _spans(text, [(k, t) for k in sorted({*templates, *notices}) for t in ([templates[k]] if k in templates else []) + notices.get(k, [])], ratio, dice)
    none = F.array().cast("array<struct<dice:double,licence:string>>")
    top = F.array_min(F.transform(F.concat("_h", "_s"), lambda x: F.struct((-x["dice"]).alias("d"), x["licence"].alias("licence"))))
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(hits, none).alias("_h"), F.coalesce(spans, none).alias("_s"))  # used more than once below, so computed once here
    return found.select("doc_id", top.alias("_t"), (F.size("_h") + F.size(F.array_except("_s.licence", "_h.licence"))).cast("long").alias("n_units")).select(
        "doc_id", F.col("_t.licence").alias("licence"), (-F.col("_t.d")).alias("dice"), "n_units")


def hint_words(words: list[str], ratio: float) -> set[str]:
    """Words of which every unit within the limit of a template holds one.

    Such a unit shares at least ``ratio`` of the template's bigrams, so it cannot miss all bigrams
    that touch the words, once these touch more than the rest; long words are taken first."""
    grams = {(a, b) for a, b in zip(words, words[1:])}
    enough = len(grams) - math.ceil(ratio * len(grams) - 1e-9) + 1
    picked: set[str] = set()
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(a in picked or b in picked for a, b in grams) >= enough:
            break
        picked.add(w)
    return picked


def _once(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, notices: list[tuple[str, str]], ratio: float, dice: float) -> Column:
    """Array of (dice, licence): the best window of each notice that has one within the limit; NULL without a hint word."""
    worded = [(k, normal_words(t)) for k, t in notices]
    hints = sorted({w for _, words in worded for w in hint_words(words, ratio)})
    every = sorted({f"{a} {b}" for _, w in worded for a, b in zip(w, w[1:])})

    def window(grams: Column, at: Column, words: list[str]) -> Column:
        """Highest coefficient; ``at`` holds the places of the notice's bigrams in ``grams``."""
        own = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
        need, span = math.ceil(ratio * len(own) - 1e-9), math.ceil((len(words) - 1) / ratio)
        literal = F.split(F.lit("|".join(own)), r"\|")
        place = lambda i: F.get(at, i)
        # a run longer than a whole window may hold one anywhere
        first = lambda k: (k == 0) | (place(k) - place(k - 1) > 1) | ((k >= span) & (place(k) - place(k - span) == span))
        starts = F.filter(F.sequence(F.lit(0), F.size(at) - need), lambda k: (place(k + (need - 1)) - place(k) < span) & first(k))
        last = lambda k, j: (j == F.size(at) - 1) | (place(j + 1) - place(j) > 1) | (place(j + 1) - place(k) >= span)
        ends = lambda k: F.filter(F.sequence(k + (need - 1), F.least(F.size(at), k + span) - 1), lambda j: (place(j) - place(k) < span) & last(k, j))
        value = lambda k, j: _once(F.array_distinct(F.slice(grams, place(k) + 1, place(j) - place(k) + 1)),
                                   lambda g: 2.0 * F.size(F.array_intersect(g, literal)) / (F.size(g) + len(own)))
        best = F.array_max(F.transform(starts, lambda k: F.array_max(F.transform(ends(k), lambda j: value(k, j)))))
        return F.when(F.size(at) >= need, best)

    def notice(grams: Column, at: Column, name: str, words: list[str]) -> Column:
        own = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
        found = _once(F.filter(at, lambda i: F.get(grams, i).isin(own)), lambda p: window(grams, p, words))
        return _once(found, lambda v: F.when(v >= dice, F.struct(v.alias("dice"), F.lit(name).alias("licence"))))

    def all_notices(grams: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: F.get(grams, i).isin(every))
        return _once(places, lambda at: F.filter(F.array(*[notice(grams, at, k, w) for k, w in worded]), lambda x: x.isNotNull()))

    pairs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    return _once(_words(text), lambda w: F.when((F.size(w) >= 2) & F.exists(w, lambda x: x.isin(hints)), _once(pairs(w), all_notices)))


def _best(unit: Column, grams: dict, ratio: float, dice: float, least: float, most: float) -> Column:
    def against(g: Column) -> Column:
        options = []
        for name, own in grams.items():
            value = 2.0 * F.size(F.array_intersect(g, F.array(*map(F.lit, own)))) / (F.size(g) + len(own))
            near = (F.size(g) >= len(own) * ratio) & (F.size(g) <= len(own) / ratio)
            options.append(F.when(near & (value >= dice), F.struct((-value).alias("d"), F.lit(name).alias("licence"))))
        low = F.array_min(F.filter(F.array(*options), lambda x: x.isNotNull()))
        return F.when(low.isNotNull(), F.struct((-low["d"]).alias("dice"), low["licence"].alias("licence")))

    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    sized = lambda g: F.when((F.size(g) >= least) & (F.size(g) <= most), against(g))
    return once(_words(unit), lambda w: F.when(F.size(w) >= max(2, least), once(_bigrams(w), sized)))
