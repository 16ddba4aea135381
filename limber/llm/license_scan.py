"""License scans: an exact set-similarity join of text blocks with templates.

A block is a run of at most ``stretch`` (1.5) times as many words as the template
has; with a stretch of None every run is a block, however long. A block contains
a template when it holds ``containment`` (0.8) or more of the template's distinct
words, in any order. The scan finds every place where such a block exists:

* the words of all templates are put in one order, rarest in the corpus first
  (one aggregation of at most as many rows as the templates have words);
* prefix filter: a block can only contain a template of t words, c of which it
  must hold, if it has one of the template's t - c + 1 rarest words; an index
  from these words to the templates gives a text's candidates;
* length filter: a text with fewer than c words is passed over;
* positional filter: a template whose rarest word in the text stands at place p
  of its order can have at most t - p words there, which must be c at least;
* what is left is counted exactly by a sliding window.

Independently, the places where a known phrase stands are counted (base).
Templates and word order are the only broadcast; their size is fixed.

Edge cases: null text counts as empty and has no words; an empty table gives an
empty result; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limber.llm.license_texts import WHOLE

CONTAINMENT = 0.8
STRETCH = 1.5

#: Phrases and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

#: Short grants and well-known passages of public licenses, and whole texts and notices, by label.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    *WHOLE,
]

#: Bytes to bytes: A-Z to lower case, every other ASCII byte that is no letter or digit to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def license_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and everything beyond ASCII, in lower case (A-Z only), as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def _word_counts(df: DataFrame, text_col: str, wanted: frozenset[bytes]) -> dict[bytes, int]:
    """How often each wanted word occurs in all texts; as many rows as there are wanted words come to the driver."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                total.update(filter(wanted.__contains__, license_words(text)))
        yield pd.DataFrame({"word": list(total), "n": list(total.values())}, columns=["word", "n"])

    thin = df.select(F.col(text_col).cast("string").alias("text"))
    counts = thin.mapInPandas(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in counts}


class Templates:
    """The templates with their words in the corpus order, and what the filters need: from a prefix word to the templates that have it there."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], containment: float, stretch: float | None = STRETCH) -> None:
        self.entries: list[tuple[str, dict[bytes, int], int, float]] = []
        self.by_prefix: dict[bytes, list[int]] = {}
        for number, (label, text) in enumerate(templates):
            ws = license_words(text)
            order = sorted(set(ws), key=lambda w: (counts.get(w, 0), w))
            need = math.ceil(containment * len(order) - 1e-9)
            room = math.inf if stretch is None else math.ceil(stretch * len(ws))
            self.entries.append((label, {w: p for p, w in enumerate(order)}, need, room))
            for w in order[: len(order) - need + 1]:
                self.by_prefix.setdefault(w, []).append(number)
        self.words = frozenset(w for _, place, _, _ in self.entries for w in place)

    def blocks(self, ws: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, containment) of the blocks found: for each stretch of overlapping qualifying blocks, its best."""
        if self.by_prefix.keys().isdisjoint(ws):
            return []
        at: dict[bytes, list[int]] = {}
        for i, w in enumerate(ws):
            if w in self.words:
                at.setdefault(w, []).append(i)
        rarest: dict[int, int] = {}  # of each candidate, the place of its rarest word that the text has
        for w in at:
            for number in self.by_prefix.get(w, ()):
                p = self.entries[number][1][w]
                rarest[number] = min(p, rarest.get(number, p))
        found = []
        for number in sorted(rarest):
            label, place, need, room = self.entries[number]
            if len(ws) < need or len(place) - rarest[number] < need:
                continue
            hits = sorted((i, w) for w in place for i in at.get(w, ()))
            found += [(label, a, b, share) for a, b, share in _runs(hits, len(place), need, room)]
        return found


def _runs(hits: list[tuple[int, bytes]], size: int, need: int, room: float) -> list[tuple[int, int, float]]:
    """Two pointers over the positions of template words; windows of ``room`` words with ``need`` distinct ones."""
    inside: Counter[bytes] = Counter()
    found: list[tuple[int, int, float]] = []
    lo = 0
    for i, w in hits:
        inside[w] += 1
        while i - hits[lo][0] >= room or inside[hits[lo][1]] > 1:
            gone = hits[lo][1]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
            lo += 1
        if len(inside) >= need:
            block = (hits[lo][0], i + 1, len(inside) / size)
            if found and block[0] < found[-1][1]:
                found[-1] = max(found[-1], block, key=lambda b: (b[2], b[0] - b[1]))
            else:
                found.append(block)
    return found


def phrase_places(ws: list[bytes]) -> list[tuple[int, str]]:
    """Start word and label of every place of a phrase, in order."""
    found = []
    for phrase, label in PHRASES.items():
        last, n = phrase[-1].encode(), len(phrase)
        head = [w.encode() for w in phrase[:-1]]
        at = -1
        try:
            while True:
                at = ws.index(last, at + 1)
                if at >= n - 1 and ws[at - n + 1 : at] == head:
                    found.append((at - n + 1, label))
        except ValueError:
            pass
    return sorted(found)


def scan_licenses(df: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, stretch: float | None = STRETCH) -> DataFrame:
    """One row per input row: the id, n_words, places (of phrases) and blocks (of templates)."""
    templates = TEMPLATES if templates is None else templates
    wanted = frozenset(w for _, t in templates for w in license_words(t))
    known = df.sparkSession.sparkContext.broadcast(Templates(templates, _word_counts(df, text_col, wanted), containment, stretch))
    id_type = df.schema[id_col].dataType.simpleString()
    thin = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))  # pandas would round large ids beside nulls

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = known.value
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ws = license_words(text)
                places = [{"word": i, "label": x} for i, x in phrase_places(ws)]
                blocks = [{"label": x, "from": a, "to": b, "containment": c} for x, a, b, c in search.blocks(ws)]
                rows.append((len(ws), places, blocks))
            out = pd.DataFrame(rows, columns=["n_words", "places", "blocks"])
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    schema = "id string, n_words long, places array<struct<word:long,label:string>>, blocks array<struct<label:string,`from`:long,`to`:long,containment:double>>"
    return thin.mapInPandas(scanned, schema).select(F.col("id").cast(id_type).alias(id_col), "n_words", "places", "blocks")


def license_report(df: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, stretch: float | None = STRETCH) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is 1 where a phrase stands, else the highest containment found, else 0.
    """
    s = scan_licenses(df, templates, id_col, text_col, containment, stretch)
    base = F.transform("places", lambda p: p["label"])
    both = F.concat(base, F.transform("blocks", lambda b: b["label"]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.transform("places", lambda p: p["word"])
    return s.select(
        id_col, "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(both).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))).alias("score"),
    )
