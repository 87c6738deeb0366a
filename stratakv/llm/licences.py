"""Licence detection with a positional index of rare tokens.

Templates are licence notices and paragraphs of licences.  Inverse document
frequencies of their words are counted over all documents.  A template matches
where it can be laid over a file so that the words found, each within ``SLACK``
places of its own, have ``LEAST`` of the template's weight; its label also needs
each of its key phrases, word for word, inside the stretch.

A file takes up only the templates of whose weight it has enough words anywhere.
For each it looks up the rarest of those words: as few as leave it certain that
any match has ``VOTES`` of them (fewer, where no choice can make that certain).
Each posting of such a word tells a place at which the template would begin, and
places at which so many words agree are followed up, all of them.  So no match
is lost, and labels and scores are those of a search that tries every place.
The score is that of the best match, 0 without one and 1 with a base phrase.

Besides, the base looks for fixed phrases in every text.

Words are runs of letters and digits, ASCII letters folded; a null or empty text
has none; long texts are searched whole, in stretches of bounded memory; where several templates of a label
match, the best score counts; repeated rows are searched each; an empty table
gives no rows; other columns pass through, and those named as results are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import ALNUM, slices, words
from ._store import table

VOTES = 3
SLACK = 3
LEAST = 0.75
EPS = 1e-9

#: Places to begin that are searched at once, and that are laid over a file at once.
STRETCH = 1 << 17
ALIGNED = 4096

#: Fixed values of the base: label and phrase.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Label, text, key phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("you may not use this file except in compliance with the license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("under the terms of the gnu general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ("eclipse public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission is hereby granted free of charge", "this permission notice shall be included")),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software", ("origin of this software must not be misrepresented",)),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("governing permissions and limitations under the license",)),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("gnu general public license for more details",)),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details", ("gnu lesser general public license for more details",)),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("anyone is free to copy modify publish use compile sell or distribute",)),
    ("proprietary", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means", ("no part of this publication may be reproduced",)),
)


def _hashes(text: str) -> np.ndarray:
    return words(pa.array([text]), ALNUM).hashes


def _runs(hashes: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the phrase's words stand in a row."""
    n = len(hashes) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(hashes[:n] == phrase[0])
    for j in range(1, len(phrase)):
        at = at[hashes[at + j] == phrase[j]]
    return at


@dataclass
class Template:
    label: str
    words: np.ndarray  # the lexicon's number of each word
    weights: np.ndarray  # of each word
    falling: np.ndarray  # distinct words, the rarest first
    mass: np.ndarray  # their weights, all their places together
    keys: list[np.ndarray]  # key phrases, as numbers


def _agreed(begins: np.ndarray, word: np.ndarray, low: int, high: int, slack: int, need: int) -> np.ndarray:
    """Places from ``low`` to before ``high`` near which (within the slack) ``need`` distinct words let the template begin."""
    votes = np.zeros(high - low, np.int16)
    for w in np.unique(word):
        mine = begins[word == w]
        edge = np.zeros(high - low + 1, np.int32)
        np.add.at(edge, np.clip(mine - slack, low, high) - low, 1)
        np.add.at(edge, np.clip(mine + slack + 1, low, high) - low, -1)
        votes += np.cumsum(edge[:-1]) > 0
    return low + np.flatnonzero(votes >= need)


@dataclass
class Index:
    known: np.ndarray  # sorted hashes of the templates' words
    templates: list[Template]
    mass: np.ndarray  # (template, word): weight of all places of the word
    votes: int = VOTES
    slack: int = SLACK
    least: float = LEAST

    @staticmethod
    def build(templates, weight: dict[int, float], votes: int = VOTES, slack: int = SLACK, least: float = LEAST) -> Index:
        known = lexicon(templates)
        number = {int(h): i for i, h in enumerate(known)}
        made, mass = [], np.zeros((len(templates), len(known)))
        for t, (label, text, keys) in enumerate(templates):
            own = np.array([number[h] for h in _hashes(text).tolist()], np.int64)
            if not len(own):
                raise ValueError(f"template {t} ({label}) has no words")
            weights = np.array([weight[h] for h in _hashes(text).tolist()])
            if not weights.any():
                weights = np.ones(len(own))
            np.add.at(mass[t], own, weights)
            each = dict(zip(own.tolist(), weights.tolist(), strict=True))
            falling = np.array(sorted(each, key=lambda i: (-each[i], i)), np.int64)
            phrases = [np.array([number[h] for h in _hashes(k).tolist()], np.int64) for k in keys]
            made.append(Template(label, own, weights, falling, mass[t, falling], phrases))
        return Index(known, made, mass, votes, slack, least)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The lexicon's number of each word, -1 for others."""
        k = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[k] == hashes, k, -1)

    def within_reach(self, rows: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
        """(row, template): whether the row has words enough, wherever they stand."""
        has = np.zeros((n, len(self.known)), np.float32)
        at = np.flatnonzero(numbers >= 0)
        has[rows[at], numbers[at]] = 1
        return has @ self.mass.T.astype(np.float32) >= self.least * self.mass.sum(axis=1) * (1 - 1e-5)

    def rarest(self, template: Template, has: np.ndarray) -> tuple[np.ndarray, int]:
        """The file's rarest words of the template, as few as will do, and how many of them any alignment that scores enough must have."""
        mine = has[template.falling]
        chosen, mass = template.falling[mine], template.mass[mine]
        lost = mass.sum() - self.least * template.mass.sum()  # what an alignment may lack of the words that the file has
        for need in range(min(self.votes, len(chosen)), 1, -1):
            for n in range(need, len(chosen) + 1):
                if np.sort(mass[:n])[: n - need + 1].sum() > lost + EPS:
                    return chosen[:n], need
        n = int(np.searchsorted(np.cumsum(mass), lost + EPS, "right")) + 1
        return chosen[:n], 1

    def look_up(self, own: np.ndarray, reached: np.ndarray) -> tuple[set[str], float]:
        """Labels of a file's words, given as numbers, and the best score of the alignments that score enough; ``reached``: templates to look for."""
        labels, best = set(), 0.0
        places = np.flatnonzero(own >= 0)
        has = np.zeros(len(self.known), bool)
        has[own[places]] = True
        for t in reached.tolist():
            template, slack = self.templates[t], self.slack
            size = len(template.words)
            chosen, need = self.rarest(template, has)
            posted = np.flatnonzero(np.isin(template.words, chosen))
            of = [posted[template.words[posted] == w] for w in chosen]
            at = places[np.isin(own[places], chosen)]
            if not len(at):
                continue
            phrases = None
            for low in range(int(at[0]) - size - slack, int(at[-1]) + slack + 1, STRETCH):
                high = min(low + STRETCH, int(at[-1]) + slack + 1)
                near = at[np.searchsorted(at, low - slack) : np.searchsorted(at, high + size + slack)]
                begins = [(near[own[near] == w][:, None] - js).ravel() for w, js in zip(chosen.tolist(), of, strict=True)]
                word = np.repeat(np.arange(len(chosen)), [len(b) for b in begins])
                starts = _agreed(np.concatenate(begins), word, low, high, slack, need)
                for some in np.array_split(starts, len(starts) // ALIGNED + 1):
                    scores = self._scores(own, template, some)
                    good = scores >= self.least - EPS
                    if not good.any():
                        continue
                    best = max(best, float(scores.max()))
                    if template.label not in labels:
                        phrases = phrases or [(_runs(own, k), len(k)) for k in template.keys]
                        if _holds(phrases, some[good], size, slack).any():
                            labels.add(template.label)
        return labels, min(best, 1.0)

    def _scores(self, own: np.ndarray, template: Template, starts: np.ndarray) -> np.ndarray:
        """The share of the template's weight that stands within the slack of its place, for each place to begin."""
        found = np.zeros((len(starts), len(template.words)), bool)
        places = starts[:, None] + np.arange(len(template.words))
        for shift in range(-self.slack, self.slack + 1):
            p = places + shift
            inside = (p >= 0) & (p < len(own))
            found |= inside & (own[np.where(inside, p, 0)] == template.words)
        return found @ template.weights / template.weights.sum()


def _holds(phrases: list[tuple[np.ndarray, int]], starts: np.ndarray, size: int, slack: int) -> np.ndarray:
    """Whether each key phrase stands inside the stretch, for each place to begin."""
    out = np.ones(len(starts), bool)
    for at, n in phrases:
        first = np.searchsorted(at, starts - slack)
        out &= np.append(at, np.iinfo(np.int64).max)[first] <= starts + size + slack - n
    return out


def lexicon(templates=TEMPLATES) -> np.ndarray:
    """Hashes of the words of all templates and key phrases."""
    return np.unique(np.concatenate([_hashes(x) for _, text, keys in templates for x in (text, *keys)]))


def word_weights(docs: DataFrame, templates=TEMPLATES) -> dict[int, float]:
    """log((documents + 1) / (documents with the word + 1)) of each template word, over all documents."""
    known = lexicon(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(len(known), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for part in slices(batch, "text"):
                w = words(part.column(0), ALNUM)
                k = np.minimum(np.searchsorted(known, w.hashes), len(known) - 1)
                at = np.flatnonzero(known[k] == w.hashes)
                pairs = np.unique(w.rows()[at] * len(known) + k[at])
                seen += np.bincount(pairs % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(known))), pa.array(np.append(rows, seen))], ["word", "docs"])

    got = docs.select("text").mapInArrow(count, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    of = {r.word: r.docs for r in got}
    return {int(h): float(np.log((of.get(-1, 0) + 1) / (of.get(i, 0) + 1))) for i, h in enumerate(known)}


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def detect(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """``docs`` with the columns of RESULT."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    rest = docs.drop(*names)
    index = Index.build(templates, word_weights(docs, templates))
    base = [(label, _hashes(phrase)) for label, phrase in phrases]
    schema = rest.select("*", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in RESULT.split(", "))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column(part.schema.get_field_index("text")), ALNUM)
                n = part.num_rows
                row_of = w.rows()
                places: list[list[int]] = [[] for _ in range(n)]
                base_labels: list[set[str]] = [set() for _ in range(n)]
                for label, phrase in base:
                    at = _runs(w.hashes, phrase)
                    at = at[row_of[at] == row_of[at + len(phrase) - 1]]
                    for p, r in zip(at.tolist(), row_of[at].tolist(), strict=True):
                        places[r].append(p - int(w.bounds[r]))
                        base_labels[r].add(label)
                labels, score = [set(x) for x in base_labels], np.array([1.0 if x else 0.0 for x in base_labels])
                numbers = index.numbers(w.hashes)
                reached = index.within_reach(row_of, numbers, n)
                for r in np.flatnonzero(reached.any(axis=1)).tolist():
                    more, best = index.look_up(numbers[w.bounds[r] : w.bounds[r + 1]], np.flatnonzero(reached[r]))
                    labels[r] |= more
                    score[r] = max(score[r], best)
                joined = [",".join(sorted(x)) for x in labels]
                made = [
                    pa.array(w.counts, pa.int64()), pa.array([len(p) for p in places], pa.int64()), pa.array([min(p, default=None) for p in places], pa.int64()), pa.array([max(p, default=None) for p in places], pa.int64()),
                    pa.array([",".join(sorted(x)) for x in base_labels]), pa.array(joined), pa.array(score),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    return rest.mapInArrow(run, schema)


def op8_positional_rare_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(x.split()[0] for x in RESULT.split(", ")))
