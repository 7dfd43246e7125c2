"""Licence notices in texts: matching statistics over a generalised suffix automaton of templates, long matches chained to spans."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm import words as W

# Phrases that are always reported, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Customary wording of public licences, with the label each stands for.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "this work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: A match counts from so many words on; matches of one template chain over gaps of at most so many words.
SHORTEST, GAP = 4, 8
#: A span is reported if its matches cover this share of the template.
COVERAGE = 0.75


def tokens(text: str) -> list[bytes]:
    data = W.LOWER[np.frombuffer(text.encode(), np.uint8)]
    piece = W.Piece(0, data, np.array([0, len(data)]))
    own = W.split(piece, W.LETTERS)
    return [data[a:b].tobytes() for a, b in zip(own.starts, own.ends, strict=True)]


class Automaton:
    """Generalised suffix automaton of sequences of numbers. ``ends[v]`` lists where state ``v``'s strings end: (sequence, end)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].add((number, place + 1))
        for state in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(dict(moves))
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, source: int, symbol: int) -> int:
        """The state of the longest string that reaches ``symbol`` from ``source``, cut off where it would be longer."""
        target = self.next[source][symbol]
        if self.length[target] == self.length[source] + 1:
            return target
        clone = self._new(self.length[source] + 1, self.next[target], self.link[target])
        self.link[target] = clone
        while source >= 0 and self.next[source].get(symbol) == target:
            self.next[source][symbol] = clone
            source = self.link[source]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        new = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, symbol)
        return new

    def statistics(self, symbols: list[int]) -> list[tuple[int, int]]:
        """For each place, the length of the longest match that ends there and its state."""
        state, length, out = 0, 0, []
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            else:
                state, length = 0, 0
            out.append((length, state))
        return out


class Scanner:
    """Templates and phrases as numbers of their words, with the automaton over them."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        texts = [tokens(t) for _, t in templates]
        own = [tokens(p) for p in phrases]
        vocabulary = sorted({w for t in [*texts, *own] for w in t})
        number = {w: k for k, w in enumerate(vocabulary)}
        value = np.array([W.hash_of(w) for w in vocabulary], np.uint64)
        self.order = np.argsort(value)
        self.sorted, self.vocabulary = value[self.order], vocabulary
        self.labels, self.sizes = [label for label, _ in templates], [len(t) for t in texts]
        self.sequences = [[number[w] for w in t] for t in texts]
        self.phrases = [([number[w] for w in p], label) for p, label in zip(own, phrases.values(), strict=True)]
        self.automaton = Automaton(self.sequences)
        grams = {tuple(s[k : k + SHORTEST]) for s in self.sequences for k in range(len(s) - SHORTEST + 1)}
        self.grams = np.unique([self._gram(np.array([g]))[0] for g in grams])

    @staticmethod
    def _gram(rows: np.ndarray) -> np.ndarray:
        value = np.zeros(len(rows), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(rows.shape[1]):
                value = value * np.uint64(100_003) + rows[:, k].astype(np.uint64)
        return value

    def numbers(self, data: np.ndarray, own: W.Words) -> np.ndarray:
        """Each word's number in the vocabulary, -1 for all others; equal hashes are checked against the word."""
        value = W.hashes(data, own)
        at = np.minimum(np.searchsorted(self.sorted, value), len(self.sorted) - 1)
        out = np.where(self.sorted[at] == value, self.order[at], -1)
        for k in np.flatnonzero(out >= 0):
            if data[own.starts[k] : own.ends[k]].tobytes() != self.vocabulary[out[k]]:
                out[k] = -1
        return out

    def places(self, numbers: np.ndarray, text: np.ndarray, phrase: list[int]) -> np.ndarray:
        n = len(numbers) - len(phrase) + 1
        if n <= 0:
            return np.zeros(0, int)
        hit = text[:n] == text[len(phrase) - 1 :]
        for k, symbol in enumerate(phrase):
            hit &= numbers[k : k + n] == symbol
        return np.flatnonzero(hit)

    def runs(self, numbers: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
        """Maximal stretches of vocabulary words in one text that hold a long enough piece of some template."""
        n = len(numbers) - SHORTEST + 1
        if n <= 0:
            return []
        inside = text[:n] == text[SHORTEST - 1 :]
        for k in range(SHORTEST):
            inside &= numbers[k : k + n] >= 0
        at = np.flatnonzero(inside)
        if not len(at):
            return []
        value = self._gram(np.stack([numbers[at + k] for k in range(SHORTEST)], 1))
        near = self.grams[np.minimum(np.searchsorted(self.grams, value), len(self.grams) - 1)] == value
        out: list[tuple[int, int]] = []
        for place in at[near].tolist():
            if out and place < out[-1][1]:
                continue
            start, end = place, place + SHORTEST
            while start > 0 and numbers[start - 1] >= 0 and text[start - 1] == text[place]:
                start -= 1
            while end < len(numbers) and numbers[end] >= 0 and text[end] == text[place]:
                end += 1
            out.append((start, end))
        return out

    def matches(self, numbers: np.ndarray, start: int, end: int) -> list[tuple[int, int, int, int]]:
        """Long matches that cannot go on: (template, first word, words, where in the template)."""
        found = self.automaton.statistics(numbers[start:end].tolist())
        out = []
        for k, (length, state) in enumerate(found):
            if length >= SHORTEST and (k + 1 == len(found) or found[k + 1][0] != length + 1):
                for template, stop in self.automaton.ends[state]:
                    out.append((template, start + k - length + 1, length, stop - length))
        return out

    def spans(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains of matches of one template in its order: (label, first word, last word, covered share)."""
        by: dict[int, list] = defaultdict(list)
        for template, first, length, place in sorted(matches):
            by[template].append((first, length, place))
        out = []
        for template, own in by.items():
            chains: list[list[int]] = []  # first word, end, end in the template, covered
            open_: list[list[int]] = []  # those that a match may still go on: matches come by first word
            for first, length, place in own:
                open_ = [c for c in open_ if first <= c[1] + GAP]
                fits = [c for c in open_ if first >= c[1] and place >= c[2]]
                if fits:
                    best = max(fits, key=lambda c: c[3])
                    best[1], best[2], best[3] = first + length, place + length, best[3] + length
                else:
                    chains.append([first, first + length, place + length, length])
                    open_.append(chains[-1])
            out += [(self.labels[template], c[0], c[1] - 1, c[3] / self.sizes[template]) for c in chains if c[3] >= COVERAGE * self.sizes[template]]
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))


_FOUND = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
    ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])))])
RESULT = [field.name for field in _FOUND]


def scan_column(scanner: Scanner, column: pa.Array) -> list[dict]:
    out: list[dict] = []
    for piece in W.pieces(column):
        data = W.LOWER[piece.data]
        own = W.split(W.Piece(0, data, piece.offsets), W.LETTERS)
        numbers = scanner.numbers(data, own)
        starts: dict[int, list[int]] = defaultdict(list)
        base: dict[int, set[str]] = defaultdict(set)
        spans: dict[int, list] = defaultdict(list)
        for phrase, label in scanner.phrases:
            for place in scanner.places(numbers, own.text, phrase):
                starts[own.text[place]].append(int(place - own.bounds[own.text[place]]))
                base[own.text[place]].add(label)
        matches: dict[int, list] = defaultdict(list)
        for start, end in scanner.runs(numbers, own.text):
            matches[own.text[start]] += scanner.matches(numbers, start, end)
        for text, found in matches.items():
            shift = int(own.bounds[text])
            spans[text] = [{"label": s[0], "first": int(s[1] - shift), "last": int(s[2] - shift), "share": float(s[3])} for s in scanner.spans(found)]
        for k, n in enumerate(np.diff(own.bounds).tolist()):
            every = base[k] | {s["label"] for s in spans[k]}
            out.append({
                "n_words": n, "n_base": len(starts[k]), "first_word": min(starts[k], default=None), "last_word": max(starts[k], default=None),
                "base_labels": ",".join(sorted(base[k])), "labels": ",".join(sorted(every)),
                "score": 1.0 if base[k] else min(1.0, max((s["share"] for s in spans[k]), default=0.0)), "spans": spans[k]})
    return out


def _scan(templates: list[tuple[str, str]], phrases: dict[str, str]):
    held: list[Scanner] = []

    @F.arrow_udf("struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,"
                 "spans:array<struct<label:string,first:long,last:long,share:double>>>")
    def scan(column: pa.Array) -> pa.Array:
        if not held:
            held.append(Scanner(templates, phrases))
        return pa.array(scan_column(held[0], column), _FOUND)

    return scan


def scan_licenses(
    docs: DataFrame, text: str | Column = "text", templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None
) -> DataFrame:
    """``docs`` with the licence notices of each text.

    Words are lower-cased runs of letters and digits (all characters from U+0080 on count as letters). ``n_words``; ``n_base`` places of the fixed
    phrases with the first and last of them; ``base_labels`` and ``labels`` (also those of the spans); ``spans`` of chained template
    matches; ``score``: 1 with a phrase, else the largest covered share. Null, empty and clean texts have counts and score 0,
    empty labels and null places. Rows may repeat. Input columns called like a result column are replaced.
    """
    body = F.col(text) if isinstance(text, str) else text
    scan = _scan(templates or TEMPLATES, phrases or PHRASES).asNondeterministic()
    found = docs.drop(*RESULT).withColumn("__found", scan(body))
    return found.select(*[c for c in docs.columns if c not in RESULT], *[F.col(f"__found.{n}").alias(n) for n in RESULT])
