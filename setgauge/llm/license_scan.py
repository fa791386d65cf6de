"""Licence scan: template markup compiled into token automata.

A template is wording with markup. ``<<beginOptional>> ... <<endOptional>>`` may be left out,
``<<var;max=n>>`` stands for up to n words of any kind; all other wording is mandatory and must
match word by word. Each template becomes an automaton over words; it is started wherever the
template's first words stand, and the longest accepted run of words counts.

Cases: a null text is an empty one (no words, no labels, score 0); repeated rows give repeated
rows; an empty table gives an empty table; other columns are ignored. Of places with equal
starts the smallest and largest start are the same number.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from setgauge.llm.common import map_texts

#: Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Wording of public licence notices, by the label that they add.
TEMPLATES = {
    "apache-notice": "licensed under the apache license <<beginOptional>>version <<var;max=2>><<endOptional>>",
    "gpl-notice": """this <<var;max=3>> is licensed under the gnu general public license
        <<beginOptional>>version <<var;max=2>><<endOptional>>""",
    "gpl-program-notice": """this program is free software you can redistribute it and or modify it under the terms of the
        gnu <<beginOptional>>lesser<<endOptional>> general public license as published by the free software foundation
        <<beginOptional>>either<<endOptional>> version <<var;max=3>>
        <<beginOptional>>or at your option any later version<<endOptional>>""",
    "cc-notice": """licensed under <<beginOptional>>a creative commons attribution<<endOptional>> cc by
        <<beginOptional>>nc<<endOptional>> <<beginOptional>>sa<<endOptional>> <<beginOptional>>nd<<endOptional>> <<var;max=2>>""",
    "mit-notice": "released under the <<beginOptional>>terms of the<<endOptional>> mit license",
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to
        whom the software is furnished to do so subject to the following conditions the above copyright notice and this
        permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or
        substantial portions of the software""",
    "isc-text": """permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose
        with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in
        all copies""",
    "bsd-text": """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met <<var;max=1>> redistributions of source code must retain the above copyright notice this
        list of conditions and the following disclaimer <<var;max=1>> redistributions in binary form must reproduce the above
        copyright notice this list of conditions and the following disclaimer in the documentation and or other materials
        provided with the distribution
        <<beginOptional>><<var;max=1>> neither the name of <<var;max=12>> nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission<<endOptional>>""",
    "unlicense-text": """this is free and unencumbered software released into the public domain anyone is free to copy modify
        publish use compile sell or distribute this software either in source code form or as a compiled binary for any
        purpose commercial or non commercial and by any means""",
}

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
MARK = re.compile(r"<<(beginOptional|endOptional|var;max=(\d+))>>|(\w+)")

SCAN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "matches",
            T.ArrayType(
                T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
            ),
        ),
    ]
)


def parts(markup: str) -> list:
    """Wording as a tree: a word, ("optional", parts), or ("any", most words)."""
    stack: list[list] = [[]]
    for m in MARK.finditer(markup):
        if m[3]:
            stack[-1].append(m[3].lower())
        elif m[2]:
            stack[-1].append(("any", int(m[2])))
        elif m[1] == "beginOptional":
            stack.append([])
        else:
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


class Automaton:
    """States with steps by a word, by any word, and without a word."""

    def __init__(self, label: str, markup: str):
        self.label = label
        self.by_word: list[dict[bytes, int]] = [{}]
        self.by_any: list[int | None] = [None]
        self.free: list[list[int]] = [[]]
        tree = parts(markup)
        self.lead = []
        for part in tree:
            if not isinstance(part, str):
                break
            self.lead.append(part)
        if not self.lead:
            raise ValueError(f"template {label} must begin with mandatory wording")
        self.final = self._build(tree, 0)

    def _state(self) -> int:
        self.by_word.append({})
        self.by_any.append(None)
        self.free.append([])
        return len(self.free) - 1

    def _build(self, tree: list, at: int) -> int:
        for part in tree:
            if isinstance(part, str):
                new = self._state()
                self.by_word[at][part.encode()] = new
            elif part[0] == "optional":
                entry = self._state()  # a state of its own, so that the words inside do not mix with those after
                self.free[at].append(entry)
                inside = self._build(part[1], entry)
                new = self._state()
                self.free[inside].append(new)
                self.free[at].append(new)
            else:
                entry, new = self._state(), self._state()
                self.free[at] += [entry, new]
                for _ in range(part[1]):
                    following = self._state()
                    self.by_any[entry] = following
                    self.free[following].append(new)
                    entry = following
            at = new
        return at

    def _reach(self, states) -> set[int]:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += self.free[s]
        return seen

    def longest(self, words: list[bytes], start: int) -> int | None:
        """Where the longest accepted run from ``start`` ends, or None."""
        states, stop = self._reach([0]), None
        for i in range(start, len(words) + 1):
            if self.final in states:
                stop = i
            if i == len(words) or not states:
                break
            w = words[i]
            after = [self.by_word[s][w] for s in states if w in self.by_word[s]]
            after += [self.by_any[s] for s in states if self.by_any[s] is not None]
            states = self._reach(after)
        return stop


@lru_cache(maxsize=4)
def automata(templates: tuple[tuple[str, str], ...]) -> list[Automaton]:
    return [Automaton(label, markup) for label, markup in templates]


def places(padded: bytes, phrase: str) -> list[int]:
    """Starts, counted in words, of ``phrase`` in words that each stand between two blanks."""
    wanted = b" " + phrase.encode().replace(b" ", b"  ") + b" "
    found, at, counted, words = [], padded.find(wanted), 0, 0
    while at >= 0:
        words += padded.count(b"  ", counted, at + 1)
        found.append(words)
        counted = at + 1
        at = padded.find(wanted, at + 1)
    return found


def scan_text(text: str, machines: list[Automaton], phrases: dict[str, str] = PHRASES) -> dict:
    words = WORDS(text.encode("utf-8", "surrogatepass").lower())  # bytes: only A-Z change
    padded = b" " + b"  ".join(words) + b" "
    base = [(at, label) for phrase, label in phrases.items() for at in places(padded, phrase)]
    matches = []
    for m in machines:
        stop = 0
        for at in places(padded, " ".join(m.lead)):
            end = m.longest(words, at) if at >= stop else None
            if end is not None:
                matches.append((m.label, at, end))
                stop = end
    base_labels = {label for _, label in base}
    starts = [at for at, _ in base]
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(base_labels | {m[0] for m in matches})),
        "score": 1.0 if matches else 0.5 if base else 0.0,
        "matches": sorted(matches, key=lambda m: (m[1], m[2], m[0])),
    }


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Per document: counts and places of the phrases, labels, accepted template matches in words, score.

    The score is 1 where a template's mandatory wording is met, 0.5 where only a phrase is, else 0.
    """
    listed = tuple(templates.items())
    automata(listed)  # a faulty template fails here

    def work(texts):
        rows = [scan_text(t, automata(listed), phrases) for t in texts]
        return {name: [r[name] for r in rows] for name in SCAN.names}

    return map_texts(docs, work, SCAN)
