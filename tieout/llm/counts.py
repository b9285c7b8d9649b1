"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens: leaves hold token counts,
inner nodes subtree sums. An edit replaces a range of characters. Only the
pre-tokens that the edit can reach are split and encoded again: from the last
leaf whose end lies at least ``REACH`` characters before the edit up to the first
old border after it at which the new split arrives again. Splitting is decided
by what follows a position, so from a shared border on all leaves stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm import columnar as col
from tieout.llm.bpe import _encoder, pretokens

#: Characters beyond its end that can decide where a pre-token ends: the letters of
#: a contraction, or the blank and the character after a run of white space.
REACH = 3
_CACHE = 1 << 18


@lru_cache(4)
def counter(path: str):
    one = _encoder(path).encode_ordinary
    return lru_cache(_CACHE)(lambda word: len(one(word)))


def split(text: str) -> np.ndarray:
    """Borders of the pre-tokens in characters, from 0 to the length."""
    raw = np.frombuffer(text.encode(), np.uint8)
    at, _ = pretokens(raw, np.array([0, len(raw)]))
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]


class Tree:
    """Sums over leaves in blocks: ``levels[0]`` are the leaves, each further level sums FAN entries below."""

    FAN = 32

    def __init__(self, leaves: np.ndarray):
        self.levels = [leaves]
        while len(self.levels[-1]) > 1:
            self.levels.append(self._sums(self.levels[-1]))

    def _sums(self, below: np.ndarray) -> np.ndarray:
        return np.add.reduceat(below, np.arange(0, len(below), self.FAN))

    @property
    def total(self) -> int:
        return int(self.levels[-1].sum())

    def prefix(self, n: int) -> int:
        """Sum of the first n leaves: whole subtrees, then the rest of each level."""
        out = 0
        for level in self.levels:
            whole = n // self.FAN
            out += int(level[whole * self.FAN : n].sum())
            n = whole
        return out

    def replace(self, first: int, last: int, leaves: np.ndarray) -> None:
        """Leaves first .. last - 1 become ``leaves``; sums left of them stay."""
        level = np.concatenate([self.levels[0][:first], leaves, self.levels[0][last:]])
        same = len(leaves) == last - first
        old, self.levels = self.levels, [level]
        low, high = first, first + len(leaves)
        while len(self.levels[-1]) > 1:
            below, number = self.levels[-1], len(self.levels)
            low, high = low // self.FAN, -(-high // self.FAN)
            kept = old[number] if number < len(old) else np.zeros(0, np.int64)
            low = min(low, len(kept))
            if same:  # only the subtrees over the changed leaves
                up = kept.copy()
                up[low:high] = self._sums(below[low * self.FAN : high * self.FAN])
            else:  # and all behind them, which have moved
                tail = below[low * self.FAN :]
                up = np.concatenate([kept[:low], self._sums(tail) if len(tail) else tail])
            self.levels.append(up)


class CountedText:
    """A text with its pre-token borders and tree of token counts."""

    def __init__(self, text: str, path: str):
        self.text, self.path = text, path
        self.borders = split(text)
        self.tree = Tree(self._count(text, self.borders))
        self.encoded = len(self.borders) - 1

    def _count(self, text: str, borders: np.ndarray) -> np.ndarray:
        one = counter(self.path)
        return np.array([one(text[a:b]) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())], np.int64)

    @property
    def tokens(self) -> int:
        return self.tree.total

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replace characters start .. stop - 1; returns how many pre-tokens were encoded again."""
        start = min(max(start, 0), len(self.text))
        stop = min(max(stop, start), len(self.text))
        shift = len(new) - (stop - start)
        text = self.text[:start] + new + self.text[stop:]
        first = max(0, int(np.searchsorted(self.borders, start - REACH, side="right")) - 1)
        begin = int(self.borders[first])
        reach = 64
        while True:
            end = min(len(text), stop + shift + reach)
            part = split(text[begin:end]) + begin
            if end < len(text):  # the last pre-tokens may go on behind the cut
                part = part[part <= end - REACH]
                part = part[:-1]
            old = self.borders + shift
            after = part[(part >= stop + shift)]
            meet = after[np.isin(after, old[self.borders >= stop])]
            if len(meet) or end == len(text):
                break
            reach *= 4
        border = int(meet[0]) if len(meet) else len(text)
        last = int(np.searchsorted(self.borders, border - shift)) if len(meet) else len(self.borders) - 1
        fresh = part[part <= border] if len(meet) else part
        self.tree.replace(first, last, self._count(text, fresh))
        self.borders = np.concatenate([self.borders[:first], fresh, self.borders[last + 1 :] + shift])
        self.text = text
        self.encoded = len(fresh) - 1
        return self.encoded


def count_edits(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text and ``edits``, an array of (start, stop,
    new) in order, each over the text as the earlier ones left it, in characters):
    doc_id, n_leaves, n_before, n_after and n_encoded, the pre-tokens that the
    edits made it encode again. Positions outside the text are moved to its ends;
    a null text counts as empty, null edits as none."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in col.pieces(batches, "text"):
            rows = []
            for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist()):
                one = CountedText(text or "", path)
                leaves, before, again = one.encoded, one.tokens, 0
                for e in edits or ():
                    again += one.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
                rows.append((leaves, before, one.tokens, again))
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in zip(*rows)]], ["doc_id", "n_leaves", "n_before", "n_after", "n_encoded"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "edits")
    return rows.mapInArrow(counted, "doc_id bigint, n_leaves bigint, n_before bigint, n_after bigint, n_encoded bigint")
