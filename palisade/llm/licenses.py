"""License scans with a positional index of the rarest template words.

A template is a license notice: its words, a label and the key phrases that it must not lack. Words are runs of ASCII
letters and digits and of all characters beyond ASCII, A-Z lower-cased. A template of m words is found in a text when
some offset d has at least ``least`` * m of its words in place (word q stands within ``slack`` words of d + q) and every
key phrase stands in the stretch so aligned. Its score is the share of words in place, of the best such offset.

1. One pass counts in how many documents each template word occurs (all documents; the vocabulary is that of the templates).
2. A template that may lack at most m - need words must keep one of any m - need + 1. So only its m - need + 1 words with
   the highest inverse document frequency are posted, as word -> (template, place); that loses no match.
3. A text looks up its words in these postings. Each hit gives a relative position; offsets within ``slack`` of one are
   candidates. Key phrases are looked for, then the places of all words of the template are intersected at each candidate.

Base phrases are looked for as such, everywhere, and reported at every place with score 1. NULL and empty texts have no
words and nothing found; repeated rows are judged alike; ties between offsets go to the smallest; an empty table gives an
empty table; columns other than the two named ones are left out. Index and templates are small and fixed, so the closure
that carries them to the tasks does not grow with the data.
"""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palisade.llm.common import query, table

# Phrases of the base with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Label, words of the notice, key phrases.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
     "you may obtain a copy of the license at", ("apache license", "except in compliance with the license")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("with or without fee",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
     "conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
     "published by the free software foundation", ("free software", "gnu general public license")),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", ("affero general public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", ("dedicated the work to the public domain",)),
    ("cc0", "licensed under cc0 1 0 universal", ("cc0 1 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ("cc by nc sa",)),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", ("cc by nc nd",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means", ("no part of this",)),
)
LEAST = 0.8  # share of a template's words that must be in place
SLACK = 4  # words by which a word may be off its place

KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
SPACED = bytes(c if c in KEPT else 32 for c in range(256))


def license_words(text: str | None) -> list[bytes]:
    """Words of a text; lower() of bytes changes A-Z only."""
    return (text or "").encode().lower().translate(SPACED).split()


class Template:
    def __init__(self, label: str, notice: str, phrases, least: float):
        self.label, self.words = label, license_words(notice)
        self.phrases = [license_words(p) for p in phrases]
        self.need = math.ceil(round(least * len(self.words), 9))


class RareIndex:
    """Templates posted under their rarest words: as many as a match cannot lack all of."""

    def __init__(self, templates, frequency: dict, slack: int):
        self.templates, self.slack = templates, slack
        self.postings = defaultdict(list)
        self.vocabulary = {w for t in templates for w in t.words}
        for k, t in enumerate(templates):
            rarest = sorted(range(len(t.words)), key=lambda q: (frequency.get(t.words[q], 0), t.words[q], q))
            for q in rarest[:len(t.words) - t.need + 1]:
                self.postings[t.words[q]].append((k, q))

    def found(self, words: list[bytes], known: set):
        """(template, offset, words in place) of the best alignment of each template that is in the text."""
        rare = self.postings.keys() & known
        if not rare:
            return []
        places = defaultdict(list)
        for at, word in enumerate(words):
            if word in self.vocabulary:
                places[word].append(at)
        places = {w: np.array(p, np.int64) for w, p in places.items()}
        offsets = defaultdict(list)
        for word in rare:
            for k, q in self.postings[word]:
                offsets[k].append(places[word] - q)
        best = [(k, self.aligned(self.templates[k], words, places, np.concatenate(offsets[k]))) for k in sorted(offsets)]
        return [(k, *hit) for k, hit in best if hit]

    def aligned(self, template, words, places, offsets):
        """(offset, words in place) of the best offset near a hit of a rare word, or None."""
        starts = [phrase_starts(words, places, p) for p in template.phrases]
        if any(not len(s) for s in starts):
            return None
        around = np.arange(-self.slack, self.slack + 1)
        near = np.unique((offsets[:, None] + around).ravel())
        length = len(template.words)
        for phrase, at in zip(template.phrases, starts):
            near = near[between(at, near - self.slack, near + length - len(phrase) + self.slack)]
        count = np.zeros(len(near), np.int64)
        for q, word in enumerate(template.words):
            if word in places:
                count += between(places[word], near + q - self.slack, near + q + self.slack)
        if not len(near) or count.max() < template.need:
            return None
        top = int(count.argmax())
        return int(near[top]), int(count[top])


def between(sorted_places, low, high):
    """Whether some place lies in [low, high], for each pair of bounds."""
    return np.searchsorted(sorted_places, high, "right") > np.searchsorted(sorted_places, low, "left")


def phrase_starts(words, places, phrase):
    """Places where all words of a phrase stand one after the other."""
    at = places.get(phrase[0], np.empty(0, np.int64))
    for k, word in enumerate(phrase[1:], 1):
        at = at[np.isin(at + k, places[word])] if len(at) and word in places else at[:0]
    return at


def base_places(words: list[bytes], known: set, phrases) -> list[tuple]:
    """(label, start, length) of the base phrases, at every place."""
    out = []
    for phrase, label in phrases:
        if known.issuperset(phrase):
            at = {w: np.array([i for i, x in enumerate(words) if x == w], np.int64) for w in set(phrase)}
            out += [(label, int(i), len(phrase)) for i in phrase_starts(words, at, phrase)]
    return out


def document_frequency(rows: DataFrame, vocabulary: set) -> dict:
    """Number of documents with each word of the vocabulary; tasks count first, so few rows are shuffled."""

    def count(batches):
        total = defaultdict(int)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word in vocabulary.intersection(license_words(text)):
                    total[word] += 1
        yield pa.record_batch([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = rows.select("t").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}


def scanned(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, base=BASE, least: float = LEAST, slack: int = SLACK,
) -> DataFrame:
    """doc_id, n_words and ``found``: array of (label, start, length, score, base) in words, by start."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    made = [Template(*t, least) for t in templates]
    index = RareIndex(made, document_frequency(rows, {w for t in made for w in t.words}), slack)
    phrases = [(license_words(p), label) for p, label in base]
    kind = pa.list_(pa.struct([
        ("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))

    def scan(batches):
        for batch in batches:
            n_words, all_found = [], []
            for value in batch.column(1).to_pylist():
                words = license_words(value)
                known = set(words)
                hits = [(label, at, n, 1.0, True) for label, at, n in base_places(words, known, phrases)]
                for k, offset, count in index.found(words, known):
                    size = len(made[k].words)
                    hits.append((made[k].label, max(offset, 0), size, count / size, False))
                n_words.append(len(words))
                all_found.append([dict(zip(("label", "start", "length", "score", "base"), h)) for h in sorted(hits, key=lambda h: (h[1], h[0], h[4]))])
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(all_found, kind)], names=["doc_id", "n_words", "found"])

    doc_kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        scan, f"doc_id {doc_kind}, n_words long, found array<struct<label: string, start: long, length: long, score: double, base: boolean>>")


def _sql_words(notice: str) -> str:
    return "[" + ", ".join(f"'{w.decode()}'" for w in license_words(notice)) + "]"


def _sql_templates() -> str:
    rows = [
        f"({k}, '{label}', {_sql_words(notice)}, [{', '.join(_sql_words(p) for p in phrases)}])"
        for k, (label, notice, phrases) in enumerate(TEMPLATES)]
    return ", ".join(rows)


WORDS_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE = f"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS_SQL}') AS w
  FROM documents),
spaced AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM texts),
base(phrase, label) AS (VALUES {", ".join(f"({_sql_words(p)}, '{label}')" for p, label in BASE)}),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(phrase)] = phrase)) AS pos
  FROM spaced JOIN base ON contains(s, ' ' || array_to_string(phrase, ' ') || ' ')),
templates(k, label, words, keys) AS (VALUES {_sql_templates()}),
wanted AS (
  SELECT doc_id, w, k, label, words, keys, len(words) AS m FROM spaced JOIN templates
    ON len(list_filter(keys, lambda p: NOT contains(s, ' ' || array_to_string(p, ' ') || ' '))) = 0),
here AS (SELECT doc_id, k, m, words, unnest(range(len(w))) AS p, unnest(w) AS word FROM wanted),
parts AS (SELECT k, unnest(range(len(words))) AS q, unnest(words) AS word FROM templates),
offsets AS (
  SELECT h.doc_id, h.k, h.m, q, unnest(range(p - q - {SLACK}, p - q + {SLACK} + 1)) AS d FROM here h JOIN parts t ON h.k = t.k AND h.word = t.word),
counted AS (
  SELECT doc_id, k, m, d, count(DISTINCT q) AS c FROM offsets GROUP BY doc_id, k, m, d HAVING count(DISTINCT q) >= ceil(round({LEAST} * m, 9))),
key_places AS (
  SELECT doc_id, k, x, len(phrase) AS size, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(phrase)] = phrase)) AS pos
  FROM (SELECT doc_id, k, w, unnest(range(len(keys))) AS x, unnest(keys) AS phrase FROM wanted)),
verified AS (
  SELECT c.doc_id, c.k, c.d, c.c, c.m FROM counted c JOIN key_places p
    ON c.doc_id = p.doc_id AND c.k = p.k AND p.pos BETWEEN c.d - {SLACK} AND c.d + c.m - p.size + {SLACK}
  GROUP BY c.doc_id, c.k, c.d, c.c, c.m HAVING count(DISTINCT x) = (SELECT len(keys) FROM templates t WHERE t.k = c.k)),
scores AS (
  SELECT doc_id, label, max(CAST(c AS DOUBLE) / m) AS score FROM verified JOIN templates USING (k) GROUP BY doc_id, label
  UNION ALL SELECT doc_id, label, 1.0 FROM places GROUP BY doc_id, label),
method AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM scores GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(f.n, 0) AS BIGINT) AS n_base, CAST(f.a AS BIGINT) AS first_word,
  CAST(f.b AS BIGINT) AS last_word, coalesce(f.labels, '') AS base_labels, coalesce(m.labels, '') AS labels, round(coalesce(m.score, 0.0), 6) AS score
FROM texts t LEFT JOIN found f USING (doc_id) LEFT JOIN method m USING (doc_id)
"""


@query("op11_license_scan", ORACLE)
def op11(spark, sf_dir):
    """Licenses named in every document: places of the base phrases, all labels, the best score."""
    done = scanned(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda h: h["base"])
    starts = F.transform(base, lambda h: h["start"])
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda h: h["score"])), F.lit(0.0))
    return done.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.round(best, 6).alias("score"))
