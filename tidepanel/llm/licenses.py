"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Templates of similar length form a class with its own window. A window is twice the longest template of its class and
windows start half a window apart, so any text of a template's length lies whole in one. Every band is one MinHash value;
their number follows from the least similarity that a match can have to its window, so that a match is retrieved with
``PROBABILITY`` at least. Texts that have none of the words which every match must have are not cut into windows.
Column expressions only; no shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import frames
from tidepanel.llm.quality import _column

SHINGLE, CONTAINMENT, PROBABILITY = 5, 0.75, 0.999
_SEPARATORS = "[^\\p{L}\\p{N}]+"

# Notices as their publishers word them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "public-domain": "This work has been released into the public domain.",
}


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z]+", text.lower()) if w]


def shingles_of(words: list[str]) -> list[str]:
    """Distinct shingles; the whole sequence if it is shorter than one."""
    return sorted({" ".join(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))})


def required_words(words: list[str]) -> set[str]:
    """Words of which every text with enough of the template's shingles has one: without them too few shingles are left."""
    shingles = shingles_of(words)
    chosen: set[str] = set()
    while True:
        left = [s.split(" ") for s in shingles if not chosen & set(s.split(" "))]
        if len(left) < math.ceil(CONTAINMENT * len(shingles)):
            return chosen
        counts = Counter(w for s in left for w in set(s))
        chosen.add(max(counts, key=lambda w: (len(w) > 5, counts[w], len(w), w)))


def classes(templates: dict[str, str]) -> dict[int, dict[str, list[str]]]:
    """Longest length of a class -> its templates' words: lengths up to 8, 16, 32 and so on."""
    out: dict[int, dict[str, list[str]]] = {}
    for name, text in sorted(templates.items()):
        if words := words_of(text):
            out.setdefault(max(8, 1 << (len(words) - 1).bit_length()), {})[name] = words
    return out


def bands(longest: int, members: dict[str, list[str]], size: int) -> int:
    """Bands of a class, from the least Jaccard similarity between a match and the window of shingles that has it."""
    window = 2 * longest - size + 1
    needed = [math.ceil(CONTAINMENT * len(shingles_of(w))) for w in members.values()]
    least = min(n / (window + math.floor(n / CONTAINMENT) - n) for n in needed)
    return math.ceil(math.log(1 - PROBABILITY) / math.log(1 - least))


def _minima(hashes: Column, n: int) -> Column:
    """One value per band: the least of the hashes, each hashed again with the band, so that all are equally likely."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))


def _shingle_hashes(words: Column, size: int) -> Column:
    """The hash of each run of ``size`` words."""
    rest = range(1, size)
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - size + 1, F.lit(0))),
                       lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in rest]))


def _windows(hashes: Column, width: int, step: int, n_bands: int) -> Column:
    """Overlapping windows of ``width`` shingles, one every ``step``, with their bands.

    A window reads its shingles by position: a slice would copy the whole text's array once per window.
    """
    starts = F.when(F.size(hashes) > 0, F.sequence(F.lit(1), F.size(hashes), F.lit(step))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda s: F.transform(F.sequence(s, F.least(s + width - 1, F.size(hashes))), lambda i: F.get(hashes, i - 1)))
    return F.transform(cut,
                       lambda x: F.struct(x.alias("shingles"), _minima(x, n_bands).alias("bands")))


def _found(windows: Column, name: str, words: list[str], n_bands: int) -> Column:
    """The template's name if a window shares a band with it and enough of its shingles."""
    grams = [s.split(" ") for s in shingles_of(words)]
    own = F.array(*[F.xxhash64(*[F.lit(w) for w in g]) for g in grams])
    signature, least = _minima(own, n_bands), math.ceil(CONTAINMENT * len(grams))
    return F.when(F.exists(windows, lambda x: F.arrays_overlap(x["bands"], signature) & (F.size(F.array_intersect(x["shingles"], own)) >= least)), F.lit(name))


def scan(df: DataFrame, keep: list[str], templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Adds ``licenses``, the sorted names of the templates found, to ``keep``.

    A template is found where a window has at least three quarters of its five-word shingles (of a shorter template: its
    whole sequence). Null and empty texts have none; equal templates are all listed.
    """
    kinds = classes(templates)
    needed = sorted(set().union(*[required_words(w) for members in kinds.values() for w in members.values()])) if kinds else []
    lower = F.lower("text")
    # ASCII words, so that a plain search for them finds every text in which they occur.
    likely = F.coalesce(lower.rlike("|".join(needed)), F.lit(False)) if needed else F.lit(False)
    df = df.select(*keep, F.when(likely, lower).alias("_text"))
    df = _column(df, "_words", F.when(F.col("_text").isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.split("_text", _SEPARATORS, -1), lambda w: w != "")))
    words = F.col("_words")
    found = []
    for longest, members in sorted(kinds.items()):
        sized: dict[int, list[str]] = {}
        for name, w in members.items():
            sized.setdefault(min(SHINGLE, len(w)), []).append(name)
        for size, names in sorted(sized.items()):
            b = bands(longest, {name: members[name] for name in names}, size)
            hashes, windows = f"_h{longest}_{size}", f"_w{longest}_{size}"
            df = _column(df, hashes, _shingle_hashes(words, size))
            df = _column(df, windows, _windows(F.col(hashes), 2 * longest - size + 1, longest, b))
            found.append(F.array(*[_found(F.col(windows), name, members[name], b) for name in names]))
    names = F.array_sort(F.filter(F.concat(*found), lambda n: n.isNotNull())) if found else F.array().cast("array<string>")
    return df.select(*keep, names.alias("licenses"))
