"""License scans by template-markup matching.

A template is the wording of a notice with markup in the manner of public
license templates: ``[[...]]`` is an optional region and ``{{name:n}}`` a
replaceable one of at most n words.  A template is compiled into an automaton
over word tokens: one state per token, with ways around optional regions and
loops through replaceable ones.  A notice is accepted where its mandatory
words stand one after the other, exactly; separators and A-Z case do not
matter.  The base phrases (plain wordings without markup) are templates like
the others and are counted at every place.

A block's words are split with NumPy; the automata run only where a template's
first mandatory words occur.  One pass over the documents, no shuffle.

Defined cases: a null text is the empty text (no words, no labels, score 0);
repeated rows are scanned alike; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metroscope.llm.runtime import blocks, doc_text, string_column
from metroscope.llm.words import hash_spans, split

# fixed values: the base phrases and their labels
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# fixed values: public notice wordings with markup, label first
TEMPLATES = [
    ("mit-notice", "[[released|licensed|distributed]] under the [[terms of the]] mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0"),
    ("apache-2.0-use", "you may not use this file except in compliance with the license"),
    ("gpl-notice", "under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] [[version {{version:1}}]]"),
    ("gpl-work", "this {{work:3}} is licensed under the gnu general public license [[version {{version:1}}]]"),
    ("lgpl-notice", "gnu lesser general public license [[version {{version:2}}]]"),
    ("agpl-notice", "gnu affero general public license [[version {{version:1}}]]"),
    ("cc-by-notice", "[[licensed under]] [[a]] [[creative commons]] cc by [[sa|nc|nd]] [[nc|nd|sa]] {{major:1}} 0"),
    ("cc-attribution", "creative commons attribution [[{{kind:2}}]] [[{{major:1}} 0]] [[international|unported]] license"),
    ("bsd-redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "copyright [[c]] {{years:3}} {{holder:6}} all rights reserved"),
]


@dataclass
class Automaton:
    """States are numbered; ``step[s]`` lists (word hash or None for any word, next state)."""
    label: str
    step: list[list[tuple[int | None, int]]] = field(default_factory=list)
    skip: list[list[int]] = field(default_factory=list)
    end: int = 0

    def new(self) -> int:
        self.step.append([])
        self.skip.append([])
        return len(self.step) - 1

    def closure(self, states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    def run(self, words: list[int], at: int) -> int:
        """End of the longest accepted stretch that starts at word ``at`` (-1: none)."""
        live, best = self.closure([0]), -1
        while True:
            if self.end in live:
                best = at
            if at >= len(words):
                return best
            live = self.closure({t for s in live for want, t in self.step[s] if want is None or want == words[at]})
            if not live:
                return best
            at += 1


def _hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hash_spans(raw, np.array([0]), np.array([len(raw)]))[0])


_MARK = re.compile(r"\[\[|\]\]|\{\{\w+:\d+\}\}|\||[^\s\[\]|{}]+")


def compile_template(label: str, markup: str) -> Automaton:
    """Automaton of one template; ``a|b`` inside an optional region are alternatives."""
    auto = Automaton(label)
    here, stack = auto.new(), []
    for mark in _MARK.findall(markup):
        if mark == "[[":
            stack.append((here, []))
        elif mark == "|":
            stack[-1][1].append(here)
            here = stack[-1][0]
        elif mark == "]]":
            start, ends = stack.pop()
            after = auto.new()
            for e in [start, *ends, here]:  # the way around, then each alternative
                auto.skip[e].append(after)
            here = after
        elif mark.startswith("{{"):
            most = int(mark[2:-2].split(":")[1])
            after = auto.new()
            for _ in range(most):
                nxt = auto.new()
                auto.step[here].append((None, nxt))
                auto.skip[nxt].append(after)
                here = nxt
            here = after
        else:
            nxt = auto.new()
            auto.step[here].append((_hash(mark.lower()), nxt))
            here = nxt
    auto.end = here
    return auto


def first_words(auto: Automaton) -> set[int | None]:
    """Words with which an accepted stretch can begin (None: any)."""
    return {want for s in auto.closure([0]) for want, _ in auto.step[s]}


class Scanner:
    """All templates, and where to try them: at words that can begin one."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE):
        self.base = [compile_template(label, phrase) for phrase, label in base.items()]
        self.templates = [compile_template(label, markup) for label, markup in templates]
        if any(None in first_words(a) for a in self.templates + self.base):
            raise ValueError("a template must not begin with a replaceable region")
        # where to run each automaton: at the words, or word pairs, that can begin an accepted stretch
        self.starts = [(kind, auto, self._openings(auto)) for kind, autos in (("base", self.base), ("template", self.templates)) for auto in autos]

    @staticmethod
    def _openings(auto: Automaton) -> np.ndarray:
        """Sums of the hashes of the first two words of any accepted stretch; 0 alone if the second is replaceable."""
        out = set()
        for s in auto.closure([0]):
            for a, t in auto.step[s]:
                for u in auto.closure([t]):
                    for b, _ in auto.step[u]:
                        if b is None:
                            return np.array(sorted(w for w in first_words(auto)), np.uint64)
                        out.add((a * 3 + b) % (1 << 64))
        return np.array(sorted(out), np.uint64)

    def scan(self, texts: pa.StringArray) -> Iterator[tuple]:
        """Per text: n_words, base places as (start, label), template labels, share of words in accepted stretches."""
        w = split(texts, "alnum")
        h = w.hashes()
        pair = np.zeros(len(h), np.uint64)
        pair[:-1] = h[:-1] * np.uint64(3) + h[1:]
        owner = w.owner()
        found: dict[int, list] = {}
        for kind, auto, openings in self.starts:
            firsts = np.array(sorted(first_words(auto)), np.uint64)
            single = len(openings) == len(firsts) and bool((openings == firsts).all())
            for at in np.flatnonzero(np.isin(h if single else pair, openings)).tolist():
                d = int(owner[at])
                last = int(w.first[d + 1])
                end = auto.run(h[at:min(last, at + len(auto.step))].tolist(), 0)
                if end > 0:
                    found.setdefault(d, []).append((kind, at - int(w.first[d]), end, auto))
        for d, n in enumerate(w.counts.tolist()):
            places = found.get(d, [])
            base = sorted((at, a.label) for kind, at, _, a in places if kind == "base")
            extra = {a.label for kind, _, _, a in places if kind == "template"}
            covered = np.zeros(n, bool) if places else None
            for _, at, size, _ in places:
                covered[at:at + size] = True
            yield n, base, extra, float(covered.mean()) if places else 0.0


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, covered double")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per document.

    doc_id, n_words, n_base (places of base phrases), first_word, last_word
    (smallest and largest start, null without places), base_labels, labels
    (with the accepted templates'), score and covered (share of the words in
    accepted stretches).  Score: 0 without any label, 0.5 with base labels
    alone, 0.75 plus a quarter of the covered share when a template's
    mandatory wording was accepted.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        scanner = Scanner(templates)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] * 2
        for b in blocks(batches):
            cols = [[] for _ in names[1:]]
            for n, base, extra, covered in scanner.scan(string_column(b, "text")):
                own = {label for _, label in base}
                score = 0.75 + covered / 4 if extra else 0.5 if own else 0.0
                row = (n, len(base), base[0][0] if base else None, base[-1][0] if base else None,
                       ",".join(sorted(own)), ",".join(sorted(own | extra)), score, covered)
                for c, v in zip(cols, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    return doc_text(docs).mapInArrow(run, SCHEMA)
