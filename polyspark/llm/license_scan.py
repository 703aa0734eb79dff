"""License scan: licence templates with optional and replaceable regions, compiled into token automata.

A template is plain wording with two kinds of markup: ``[[ ... ]]`` encloses words that may be left out and ``<<name:n>>``
stands for up to n words of any kind (names, years, holders). It compiles into a token automaton; a place in a text is
accepted when all mandatory words follow each other exactly, in order, with only the marked freedom between them. Texts
are read as word hashes in flat arrays; an automaton runs only where the template's opening words stand.

Beside the templates there are base phrases: plain runs of words, of which all places are counted.

Nulls and edges: a null text counts as empty: no words, no labels, score 0; texts of any length are read whole; repeated
rows give repeated results; an empty table gives an empty result; other columns of the input are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Wording of licences and licence notices, as their publishers give it.
TEMPLATES = {
    "gpl-notice": "licensed under the [[terms of the]] gnu [[lesser]] general public license [[as published by the free software foundation [[either]]]] [[version 2]] [[version 3]] [[or any later version]]",
    "apache-2.0-notice": "licensed under the apache license version 2.0 [[the license]]",
    "mit-notice": "[[is]] released under the [[terms of the]] mit license",
    "mit-licensed": "licensed under the [[terms of the]] mit license",
    "cc-by-notice": "licensed under [[a]] [[the]] [[creative commons]] cc by [[nc]] [[sa]] [[nd]] <<version:2>>",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<number:1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<number:1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[<<number:1>> neither the name of <<holder:12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]]",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "spdx": "spdx license identifier <<id:4>>",
}


def words_of(text: str) -> list[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return tk.word_hashes(raw, np.array([0, len(raw)]), tk.ALNUM)[0].tolist()


@dataclass(frozen=True)
class Automaton:
    """States 0..n; ``steps[s]`` lists (word hash or None for any word, next state); ``skips[s]`` lists free moves."""

    steps: tuple
    skips: tuple
    final: int
    opening: tuple[int, int]

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def longest(self, words: list[int]) -> int:
        """Length of the longest prefix of ``words`` that is accepted, or -1."""
        states, best = self.closure({0}), -1
        for k in range(len(words) + 1):
            if self.final in states:
                best = k
            if k == len(words):
                break
            states = self.closure({t for s in states for w, t in self.steps[s] if w is None or w == words[k]})
            if not states:
                break
        return best


def compile_template(template: str) -> Automaton:
    """Mandatory words become single steps, ``[[..]]`` a free move round its words, ``<<name:n>>`` n steps that may be skipped."""
    steps: list[list] = [[]]
    skips: list[list[int]] = [[]]
    opened: list[int] = []

    def state() -> int:
        steps.append([])
        skips.append([])
        return len(steps) - 1

    now, mandatory = 0, []
    for part in re.findall(r"\[\[|\]\]|<<\w+:\d+>>|[^\s\[\]<>]+", template):
        if part == "[[":
            opened.append(now)
        elif part == "]]":
            skips[opened.pop()].append(now)
        elif part.startswith("<<"):
            for _ in range(int(part[2:-2].split(":")[1])):
                nxt = state()
                steps[now].append((None, nxt))
                skips[now].append(nxt)
                now = nxt
        else:
            for w in words_of(part):
                nxt = state()
                steps[now].append((w, nxt))
                now = nxt
                if not opened:
                    mandatory.append(w)
    if opened:
        raise ValueError("an optional region is not closed")
    return Automaton(tuple(map(tuple, steps)), tuple(map(tuple, skips)), now, tuple(mandatory[:2]))


def _openings(a: Automaton) -> list[tuple[int, ...]]:
    """The word pairs with which an accepted place can begin."""
    out = set()
    for s in a.closure({0}):
        for w, t in a.steps[s]:
            if w is None:
                raise ValueError("a template must begin with a word")
            for s2 in a.closure({t}):
                out |= {(w, w2) for w2, _ in a.steps[s2] if w2 is not None}
    return sorted(out)


def scan_words(h: np.ndarray, doc: np.ndarray, phrases: list, automata: dict) -> tuple[list, list]:
    """(base places as (document, start, label), accepted templates as (document, start, words, label))."""
    n = len(h)
    base, found = [], []
    for words, label in phrases:
        k = len(words)
        if n < k:
            continue
        hit = h[: n - k + 1] == words[0]
        for i in range(1, k):
            hit &= h[i : n - k + 1 + i] == words[i]
        hit &= doc[: n - k + 1] == doc[k - 1 :]
        at = np.flatnonzero(hit)
        base.append((doc[at], at, label))
    if n >= 2:
        second = h[1:]
        for label, (a, openings) in automata.items():
            for w1, w2 in openings:
                for at in np.flatnonzero(h[:-1] == tk.U(w1)):
                    if second[at] == tk.U(w2) and doc[at] == doc[at + 1]:
                        end = int(np.searchsorted(doc, doc[at], "right"))
                        size = a.longest(h[at : min(end, at + len(a.steps))].tolist())
                        if size > 0:
                            found.append((int(doc[at]), int(at), size, label))
    return base, found


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [(np.array(words_of(p), tk.U), label) for p, label in BASE.items()]
        automata = {label: (a := compile_template(t), _openings(a)) for label, t in templates.items()}
        for batch in batches:
            buf, off = tk.column_bytes(batch.column(1))
            out = {"n_words": [], "n_base": [], "first_word": [], "last_word": [], "base_labels": [], "labels": [], "score": [], "matches": []}
            for i, j in tk.blocks(off):
                h, _, _, doc = tk.word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i], tk.ALNUM)
                m = j - i
                first = np.searchsorted(doc, np.arange(m + 1))
                base, found = scan_words(h, doc, phrases, automata)
                count, low, high = np.zeros(m, np.int64), np.full(m, len(h)), np.full(m, -1)
                labels: dict[int, set] = {}
                for d, at, label in base:
                    np.add.at(count, d, 1)
                    np.minimum.at(low, d, at)
                    np.maximum.at(high, d, at)
                    for x in np.unique(d).tolist():
                        labels.setdefault(x, set()).add(label)
                more: dict[int, list] = {}
                for d, at, size, label in found:
                    more.setdefault(d, []).append((at - int(first[d]), size, label))
                for d in range(m):
                    own, extra = labels.get(d, set()), more.get(d, [])
                    out["n_words"].append(int(first[d + 1] - first[d]))
                    out["n_base"].append(int(count[d]))
                    out["first_word"].append(int(low[d] - first[d]) if count[d] else None)
                    out["last_word"].append(int(high[d] - first[d]) if count[d] else None)
                    out["base_labels"].append(",".join(sorted(own)))
                    out["labels"].append(",".join(sorted(own | {x[2] for x in extra})))
                    out["score"].append(1.0 if extra else 0.5 if own else 0.0)
                    out["matches"].append([{"label": x[2], "start": x[0], "words": x[1]} for x in sorted(extra)])
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(v, k) for v, k in zip(out.values(), kinds)], ["doc_id", *out])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Licence labels of every whole text. ``matches`` lists each accepted template with its first word and its length in words.

    score: 1 where a template is accepted, 0.5 where only base phrases stand, else 0.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:long,words:long>>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(TEMPLATES if templates is None else templates), schema)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("matches")
