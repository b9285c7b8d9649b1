"""Licence scans by template-markup matching.

A template is licence wording with two kinds of markup: an optional region,

    <<beginOptional>> ... <<endOptional>>      (may be nested)

and a replaceable one, ``<<var;name;N>>``, for which any 0 to N words may stand.
It is compiled into an automaton over words. A text is accepted where the
mandatory wording stands exactly, in order, with only the permitted variation.

Base phrases are fixed word sequences found at every place they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm import columnar as col

#: Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_TERMS = "<<beginOptional>> terms of the <<endOptional>>"
_FSF = "<<beginOptional>> as published by the free software foundation <<endOptional>> <<beginOptional>> either <<endOptional>>"
#: (label, wording)
TEMPLATES = (
    ("mit", f"under the {_TERMS} MIT License"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of <<var;work;8>> to deal in <<var;object;4>> without restriction"),
    ("apache-2.0", f"under the {_TERMS} Apache License <<beginOptional>> version <<endOptional>> 2 0"),
    ("gpl-2.0", f"under the {_TERMS} GNU General Public License {_FSF} version 2"),
    ("gpl-3.0", f"under the {_TERMS} GNU General Public License {_FSF} version 3"),
    ("cc-by-4.0", "<<beginOptional>> Creative Commons Attribution <<endOptional>> CC BY 4 0"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("copyright", "Copyright <<beginOptional>> c <<endOptional>> <<var;year;2>> <<var;holder;6>> All rights reserved"),
)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased) and its text number."""
    data, offsets = col.flat(texts)
    data = col.LOWER[data]
    start, end, doc = col.word_spans(data, offsets, col.ALNUM_WORDS)
    return col.Hasher(data)(start, end), doc


def word_hashes(phrase: str) -> list[int]:
    return words_of(pa.array([phrase]))[0].tolist()


@dataclass(frozen=True)
class Automaton:
    """States 0 .. final; ``steps[s]`` are (word hash or None for any word, next state), ``free[s]`` next states without a word."""

    label: str
    steps: tuple[tuple[tuple[int | None, int], ...], ...]
    free: tuple[tuple[int, ...], ...]
    needed: tuple[int, ...]  # words that every accepted text holds

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def openers(self) -> list[int]:
        return sorted({w for s in self.closure({0}) for w, _ in self.steps[s] if w is not None})

    def accepts(self, words: list[int]) -> bool:
        """Whether a match starts with the first word."""
        final, at = len(self.steps) - 1, 0
        states = self.closure({0})
        while final not in states:
            if not states or at >= len(words):
                return False
            states = self.closure({t for s in states for w, t in self.steps[s] if w is None or w == words[at]})
            at += 1
        return True


def compile_template(label: str, wording: str) -> Automaton:
    steps: list[list] = [[]]
    free: list[list] = [[]]
    needed: list[int] = []
    opened: list[int] = []

    def state() -> int:
        steps.append([])
        free.append([])
        return len(steps) - 1

    here = 0
    for mark, name, most, text in re.findall(r"<<(beginOptional|endOptional|var;(\w+);(\d+))>>|([^<]+)", wording):
        if mark == "beginOptional":
            opened.append(here)
        elif mark == "endOptional":
            nxt = state()
            free[here].append(nxt)
            free[opened.pop()].append(nxt)
            here = nxt
        elif mark:
            ends = [here]
            for _ in range(int(most)):
                nxt = state()
                steps[ends[-1]].append((None, nxt))
                ends.append(nxt)
            here = state()
            for s in ends:
                free[s].append(here)
        else:
            for h in word_hashes(text):
                nxt = state()
                steps[here].append((h, nxt))
                here = nxt
                if not opened:
                    needed.append(h)
    if opened:
        raise ValueError(f"{label}: an optional region is not closed")
    last = state()
    free[here].append(last)
    return Automaton(label, tuple(map(tuple, steps)), tuple(map(tuple, free)), tuple(dict.fromkeys(needed)))


@lru_cache(4)
def compiled(templates: tuple = TEMPLATES) -> tuple[Automaton, ...]:
    return tuple(compile_template(label, wording) for label, wording in templates)


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base (places of
    base phrases), first_word and last_word (their smallest and largest start,
    null without any), base_labels and labels (distinct, sorted, joined by
    commas; empty strings without any) and score: 1 where a template accepts,
    0.5 with base phrases only, else 0. A null text counts as empty; null ids and
    repeated rows are kept as they are."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(templates)
        phrases = [(np.array(word_hashes(p), np.uint64), label) for p, label in BASE.items()]
        for batch in col.pieces(batches, "text"):
            n = batch.num_rows
            words, doc = words_of(batch.column("text"))
            edge = np.searchsorted(doc, np.arange(n + 1))
            base: list[set] = [set() for _ in range(n)]
            starts = []
            for phrase, label in phrases:
                at = np.flatnonzero(words[: max(0, len(words) - len(phrase) + 1)] == phrase[0])
                for j in range(1, len(phrase)):
                    at = at[(words[at + j] == phrase[j]) & (doc[at + j] == doc[at])]
                starts.append(at)
                for d in np.unique(doc[at]):
                    base[d].add(label)
            at = np.sort(np.concatenate(starts))
            found = np.bincount(doc[at], minlength=n)
            first = np.searchsorted(doc[at], np.arange(n))
            own: list[set] = [set() for _ in range(n)]
            for a in automata:
                fits = np.ones(n, bool)
                for h in a.needed:
                    fits &= np.bincount(doc[words == np.uint64(h)], minlength=n) > 0
                    if not fits.any():
                        break
                if not fits.any():
                    continue
                opening = np.isin(words, np.array(a.openers(), np.uint64)) & fits[doc]
                for i in np.flatnonzero(opening).tolist():
                    d = doc[i]  # no match is longer than the automaton
                    if a.label not in own[d] and a.accepts(words[i : min(edge[d + 1], i + len(a.steps))].tolist()):
                        own[d].add(a.label)
            none = found == 0
            low = np.where(none, 0, (at - edge[doc[at]])[np.minimum(first, len(at) - 1)] if len(at) else 0)
            high = np.where(none, 0, (at - edge[doc[at]])[np.maximum(first + found - 1, 0)] if len(at) else 0)
            score = np.array([1.0 if o else 0.5 if b else 0.0 for o, b in zip(own, base)])
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.diff(edge)), pa.array(found), pa.array(low, mask=none), pa.array(high, mask=none),
                 pa.array([",".join(sorted(b)) for b in base], pa.string()), pa.array([",".join(sorted(b | o)) for b, o in zip(base, own)], pa.string()), pa.array(score)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    shape = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scanned, shape)
