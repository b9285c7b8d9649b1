"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of terms are counted over the whole corpus.
2. Benchmark items become TF-IDF passages, and a randomised SVD over that table
   (random projection, one power step and a small eigenproblem, each a sum over
   passages made by Spark) gives the latent space. What a document adds outside
   the passages' row space changes no inner product with them, so the space is
   fitted on all passages and applied to every document.
3. A stretch that shares t of a passage's n words in order holds at least j of its
   n - t + j rarest ones. Counting those finds every stretch that step 4 could
   confirm, whatever its words weigh; one subsequence over the whole stretch
   drops most of the others. Documents with such a stretch are read in
   overlapping windows: those whose latent vector is close to the passage's are
   tried first, then all others around the stretch, until one holds the whole
   passage. The latent space decides the order of work and no result.
4. A candidate is confirmed by the longest common subsequence of words with the
   passage: at least ``RATIO`` of the passage, or at least ``PARAPHRASE`` of it
   when the passage's answer (its last sentence) stands there word for word.
   Passages under ``SHORT`` words must stand there word for word; they skip step 3
   and are looked up by the hash of all their words, at every place of a document.

Benchmark passages are taken in blocks of ``BLOCK`` for step 3, so that what is
sent to the tasks is bounded; the term table has a fixed number of buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm import columnar as col
from tieout.llm.stash import pick, stash

#: Term buckets: the top bits of a word's hash.
BITS = 18
#: Dimensions of the latent space, and extra random ones while fitting.
RANK, EXTRA = 96, 16
#: Words of a benchmark passage, and the words two passages of an item share.
PASSAGE, OVERLAP = 64, 16
#: Words of a document window and the step to the next.
WINDOW, STEP = 32, 8
#: Weight of a term that every document holds.
FLOOR = 0.1
#: A window is a latent candidate for a passage from this cosine on, if it also holds this share of the passage's vector.
COSINE, COVER = 0.35, 0.2
RATIO, PARAPHRASE = 0.75, 0.5
SHORT = 8
#: Benchmark passages searched at once.
BLOCK = 20_000
#: Passages whose rarest words are counted at once.
GROUP = 1000
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[[ord(c) for c in ".!?\n"]] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and sentence mark of each lower-cased word; a mark changes where a sentence ends."""
    data, offsets = col.flat(pc.utf8_lower(texts))
    start, end, doc = col.word_spans(data, offsets, col.ALNUM_WORDS)
    marks = np.cumsum(SENTENCE_END[data])[start] if len(start) else start
    return col.Hasher(data)(start, end), doc, marks


def bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BITS)).astype(np.int64)


def passages(benchmark: DataFrame) -> DataFrame:
    """item_id, words (hashes) and n_answer, how many of the last words are the answer.
    Items without words have no passage."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in col.pieces(batches, "text"):
            items, lists, answers = [], [], []
            words, doc, mark = words_of(batch.column("text"))
            edge = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            for i, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
                if a == b:
                    continue
                last = int((mark[a:b] == mark[b - 1]).sum())
                at = a
                while True:
                    stop = b if b - at <= PASSAGE + OVERLAP else at + PASSAGE
                    items.append(batch.column("item_id")[i].as_py())
                    lists.append(words[at:stop].view(np.int64).tolist())
                    answers.append(last if stop == b and last < b - at else 0)
                    if stop == b:
                        break
                    at = stop - OVERLAP
            yield pa.record_batch([pa.array(items, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(answers, pa.int32())], ["item_id", "words", "n_answer"])

    return benchmark.mapInArrow(cut, "item_id bigint, words array<bigint>, n_answer int")


def document_frequency(docs: DataFrame, wanted: np.ndarray) -> tuple[np.ndarray, int]:
    """For each bucket, the documents that hold it (counted for ``wanted`` buckets
    only), and the number of documents; over all of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << BITS, np.int64), 0
        for batch in col.pieces(batches, "text"):
            words, doc, _ = words_of(batch.column("text"))
            at = bucket(words)
            use = wanted[at]
            total += np.bincount(np.unique(doc[use] * (1 << BITS) + at[use]) & ((1 << BITS) - 1), minlength=1 << BITS)
            rows += batch.num_rows
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], rows))], ["bucket", "n"])

    got = docs.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS, np.int64)
    at, n = got["bucket"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def _sparse(lists: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage number, bucket and TF-IDF weight of each entry."""
    size = np.diff(lists.offsets.to_numpy())
    at = bucket(lists.flatten().to_numpy().view(np.uint64))
    row = np.repeat(np.arange(len(size)), size)
    pair, count = np.unique(row * (1 << BITS) + at, return_counts=True)
    row, at = pair >> BITS, pair & ((1 << BITS) - 1)
    return row, at, count * idf[at]


def latent_space(found: DataFrame, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each bucket in use (-1: none) and the term vectors, by a
    randomised SVD of the passages' TF-IDF table ``found``."""
    used = np.flatnonzero(idf > 0)
    number = np.full(1 << BITS, -1)
    number[used] = np.arange(len(used))
    width = min(RANK + EXTRA, max(1, len(used)))
    rows = pa.schema([("part", pa.int32()), ("sums", pa.binary())])

    def summed(step) -> np.ndarray:
        """Sum over passages of step(row, column, weight, passages), a float matrix."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                row, at, weight = _sparse(batch.column("words"), idf)
                part = step(row, number[at], weight, batch.num_rows)
                total = part if total is None else total + part
            if total is not None:
                yield pa.record_batch([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=rows)

        def add(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py(), np.float64) for x in group["sums"])
            return pa.table([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=rows)

        parts = found.select("words").mapInArrow(each, "part int, sums binary")
        parts = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("part").applyInArrow(add, "part int, sums binary")
        return sum(np.frombuffer(r.sums, np.float64) for r in parts.collect())  # at most 16 matrices of bounded size

    def project(row, at, weight, n, onto):
        use = at >= 0
        out = np.zeros((n, onto.shape[1]))
        np.add.at(out, row[use], weight[use, None] * onto[at[use]])
        return out

    def power(row, at, weight, n):
        draw = np.random.default_rng(7).standard_normal((len(used), width))
        low, use = project(row, at, weight, n, draw), at >= 0
        out = np.zeros((len(used), width))
        np.add.at(out, at[use], weight[use, None] * low[row[use]])
        return out

    if not len(used):
        return number, np.zeros((0, 1), np.float32)
    basis, _ = np.linalg.qr(summed(power).reshape(len(used), width))

    def gram(row, at, weight, n):
        low = project(row, at, weight, n, basis)
        return low.T @ low

    _, turn = np.linalg.eigh(summed(gram).reshape(basis.shape[1], -1))
    return number, np.ascontiguousarray((basis @ turn[:, ::-1][:, :RANK]).astype(np.float32))


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one machine step per word of b."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def contains(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether b stands in a, word for word."""
    return len(b) <= len(a) and bool((np.lib.stride_tricks.sliding_window_view(a, len(b)) == b).all(axis=1).any())


def joined(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on."""
    step = col.mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    return sum(words[i : len(words) - n + 1 + i] * step[i] for i in range(n))


@dataclass(frozen=True)
class Short:
    """Passages of n words by their hash, in its order."""

    n: int
    key: np.ndarray
    words: np.ndarray
    passage: np.ndarray

    @staticmethod
    def of(words: list[np.ndarray], n: int) -> Short:
        mine = np.array([p for p, w in enumerate(words) if len(w) == n], np.int64)
        table = np.array([words[p] for p in mine], np.uint64).reshape(len(mine), n)
        key = np.array([joined(row, n)[0] for row in table], np.uint64)
        order = np.argsort(key, kind="stable")
        return Short(n, key[order], table[order], mine[order])

    def found(self, words: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """(text number, passage) wherever all words of a passage stand in order."""
        if not len(self.key) or len(words) < self.n:
            return []
        place = np.flatnonzero(doc[: len(doc) - self.n + 1] == doc[self.n - 1 :])
        value = joined(words, self.n)[place]
        first, last = np.searchsorted(self.key, value), np.searchsorted(self.key, value, side="right")
        at, _ = col.gather(np.arange(len(self.key)), first, last - first)
        place = np.repeat(place, last - first)
        same = (words[place[:, None] + np.arange(self.n)] == self.words[at]).all(axis=1)
        pair = np.unique(doc[place[same]] * len(self.key) + at[same])
        return list(zip((pair // len(self.key)).tolist(), self.passage[pair % len(self.key)].tolist()))


@dataclass(frozen=True)
class Rarest:
    """Which of the passages ``first`` .. ``first`` + len(need) - 1 have a word among
    their rarest: those of key[i] are passage[edge[i] : edge[i + 1]]."""

    first: int
    key: np.ndarray
    edge: np.ndarray
    passage: np.ndarray
    need: np.ndarray  # how many of them a stretch of the passage holds
    reach: np.ndarray  # within so many words
    share: np.ndarray  # words of the passage that it holds in order

    @staticmethod
    def of(words: list[np.ndarray], answer: list[int], idf: np.ndarray, first: int) -> Rarest:
        need, reach, share, keys = [], [], [], []
        for mine, told in zip(words, answer):
            n = len(mine)
            t = math.ceil((PARAPHRASE if told else RATIO) * n)
            j = max(1, t // 3)
            need.append(j)
            reach.append(2 * n if told else 2 * n + WINDOW)
            share.append(t)
            keys.append(np.unique(mine[np.argsort(-idf[bucket(mine)], kind="stable")[: n - t + j]]) if n >= SHORT else mine[:0])
        every, owner = np.concatenate([*keys, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(every, kind="stable")
        key, at = np.unique(every[order], return_index=True)
        return Rarest(first, key, np.append(at, len(every)), owner[order], np.array(need), np.array(reach), np.array(share))

    def held(self, words: np.ndarray, doc: np.ndarray, n_docs: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text number, passage, from, to, first, last): words[from:to] has all stretches
        around there that hold enough, each with a word at or before ``first`` and one at or after ``last``."""
        if not len(self.key):
            return
        at = np.minimum(np.searchsorted(self.key, words), len(self.key) - 1)
        place = np.flatnonzero(self.key[at] == words)
        size = self.edge[at[place] + 1] - self.edge[at[place]]
        who, _ = col.gather(self.passage, self.edge[at[place]], size)
        place = np.repeat(place, size)
        pair = doc[place] * len(self.need) + who
        enough = np.bincount(pair, minlength=n_docs * len(self.need))[pair] >= self.need[who]
        pair, place, who = pair[enough], place[enough], who[enough]
        order = np.argsort(pair, kind="stable")
        pair, place, who = pair[order], place[order], who[order]
        end = np.arange(len(pair)) + self.need[who] - 1
        run = np.flatnonzero(end < len(pair))
        run = run[(pair[end[run]] == pair[run]) & (place[end[run]] - place[run] < self.reach[who[run]])]
        if not len(run):
            return
        low, high, pair = place[run], place[end[run]], pair[run]
        new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (low[1:] > high[:-1])])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(run)) - 1
        reach = self.reach[who[run[begin]]]
        found = (pair[begin] // len(self.need), who[run[begin]] + self.first, high[begin] - reach + 1, low[last] + reach, high[begin], low[last])
        yield from zip(*(x.tolist() for x in found))


@dataclass(frozen=True)
class Block:
    """Passages searched together, in the latent space."""

    item: list[int]
    words: list[np.ndarray]
    answer: list[int]
    unit: np.ndarray  # latent vectors, scaled to length 1
    length: np.ndarray  # and their length before
    idf: np.ndarray
    number: np.ndarray
    terms: np.ndarray
    rarest: list[Rarest]
    short: list[Short]

    @staticmethod
    def of(rows: list, idf: np.ndarray, number: np.ndarray, terms: np.ndarray) -> Block:
        words = [np.array(r.words, np.int64).view(np.uint64) for r in rows]
        row, at, weight = _sparse(pa.array([r.words for r in rows], pa.list_(pa.int64())), idf)
        low = np.zeros((len(rows), terms.shape[1]), np.float32)
        use = number[at] >= 0
        np.add.at(low, row[use], (weight[use, None] * terms[number[at[use]]]).astype(np.float32))
        length = np.linalg.norm(low, axis=1, keepdims=True)
        answer = [r.n_answer for r in rows]
        rarest = [Rarest.of(words[i : i + GROUP], answer[i : i + GROUP], idf, i) for i in range(0, len(rows), GROUP)]
        return Block([r.item_id for r in rows], words, answer, low / np.maximum(length, 1e-9), length[:, 0], idf.astype(np.float32), number, terms, rarest, [Short.of(words, n) for n in range(1, SHORT)])

    def confirmed(self, doc: np.ndarray, start: int, stop: int, p: int) -> float:
        """Share of passage p found around doc[start:stop]; 0 if that is not enough."""
        mine = self.words[p]
        n = len(mine)
        near = doc[max(0, start - n) : stop + n]
        if n < SHORT:
            return float(contains(near, mine))
        own = set(mine.tolist())
        held = [x for x in near.tolist() if x in own]
        if len(held) < PARAPHRASE * n or len(set(held)) < PARAPHRASE * len(own) / 2:
            return 0.0
        share = common_subsequence(mine.tolist(), held) / n
        if share < RATIO and not (share >= PARAPHRASE and self.answer[p] and contains(near, mine[-self.answer[p] :])):
            return 0.0
        return share if share >= PARAPHRASE and self._dense(mine, near) else 0.0

    def _dense(self, mine: np.ndarray, near: np.ndarray) -> bool:
        """The match must fit into a stretch of twice the passage, not be gathered from all around."""
        n = len(mine)
        steps = range(0, max(1, len(near) - n), max(1, n // 2))
        return any(common_subsequence(mine.tolist(), near[i : i + 2 * n].tolist()) >= PARAPHRASE * n for i in steps)

    def _able(self, words: np.ndarray, doc: np.ndarray, edge: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text number, passage, first, last) for each stretch that may hold enough
        of a passage: every window that does reaches to first or beyond, and to last or before."""
        for rarest in self.rarest:
            for d, p, start, stop, first, last in rarest.held(words, doc, len(edge) - 1):
                mine, need = self.words[p].tolist(), rarest.share[p - rarest.first]
                own = set(mine)
                near = [x for x in words[max(edge[d], start) : min(edge[d + 1], stop)].tolist() if x in own]
                if len(near) >= need and common_subsequence(mine, near) >= need:
                    yield d, p, first, last

    def _latent(self, words: np.ndarray, doc: np.ndarray, edge: np.ndarray, whose: np.ndarray, step: np.ndarray, able: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, passage) pairs that are close in the latent space, of the texts and
        passages in ``able``. A window is the sum of the steps it covers."""
        if not len(able):
            return
        mine = np.zeros(len(edge) - 1, bool)
        mine[able // len(self.item)] = True
        at = bucket(words)
        hit = np.flatnonzero((self.number[at] >= 0) & mine[doc])
        window = np.flatnonzero(mine[whose])
        spread = WINDOW // STEP
        steps = -(-np.diff(edge) // STEP) + spread - 1  # the last ones are empty
        base = np.cumsum(steps) - steps
        owner = base[doc[hit]] + (hit - edge[doc[hit]]) // STEP
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        sums = np.zeros((int(steps.sum()), self.terms.shape[1]), np.float32)
        for i in range(0, len(first), 4096):
            a, b = first[i], first[i + 4096] if i + 4096 < len(first) else len(hit)
            part = at[hit[a:b]]
            sums[owner[first[i : i + 4096]]] = np.add.reduceat(self.idf[part][:, None] * self.terms[self.number[part]], first[i : i + 4096] - a, axis=0)
        place = base[whose] + step
        for i in range(0, len(window), 4096):
            part = window[i : i + 4096]
            low = sum(sums[place[part] + k] for k in range(spread))
            inner = low @ self.unit.T
            far = np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-9)
            near, p = np.nonzero((inner >= COSINE * far) & (inner >= COVER * self.length) & (inner > 0))
            use = np.isin(whose[part[near]] * len(self.item) + p, able)
            yield from zip(part[near[use]].tolist(), p[use].tolist())

    def matches(self, texts: pa.Array) -> list[tuple[int, int, float]]:
        """(text number, item_id, share) of every confirmed match, best share per pair."""
        words, doc, _ = words_of(texts)
        best: dict[tuple[int, int], float] = {}
        if not len(words) or not self.item:
            return []
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))
        size = np.diff(edge)
        count = np.where(size > 0, 1 + (np.maximum(size - WINDOW, 0) + STEP - 1) // STEP, 0)
        whose = np.repeat(np.arange(len(texts)), count)
        step = np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count)

        def look(d: int, k: int, p: int) -> None:
            """Try window k of text d."""
            key = (d, self.item[p])
            if best.get(key, 0) < 1:
                a, b = edge[d], edge[d + 1]
                share = self.confirmed(words[a:b], k * STEP, min(k * STEP + WINDOW, int(b - a)), p)
                if share > best.get(key, 0):
                    best[key] = share

        for short in self.short:
            for d, p in short.found(words, doc):
                best[d, self.item[p]] = 1.0
        able = list(self._able(words, doc, edge))
        for w, p in self._latent(words, doc, edge, whose, step, np.array([d * len(self.item) + p for d, p, _, _ in able], np.int64)):
            look(int(whose[w]), int(step[w]), p)
        for d, p, first, last in able:
            n, a = len(self.words[p]), int(edge[d])
            windows = range(max(0, (first - a - WINDOW - n) // STEP), min(int(count[d]), (last - a + n) // STEP + 1))
            middle = (first + last - WINDOW) // 2 - a
            for k in sorted(windows, key=lambda k: abs(k * STEP - middle)):
                look(d, k, p)
        return [(d, item, share) for (d, item), share in best.items()]


def prepare(docs: DataFrame, benchmark: DataFrame) -> list[Block]:
    """Blocks of passages, ready to be searched for. Null texts and item ids are left out."""
    found = stash(passages(pick(benchmark, {"item_id": "item_id", "text": "text"}).where("item_id is not null and text is not null").withColumn("item_id", F.col("item_id").cast("bigint"))), "passages")
    total = found.count()
    mine = found.select(F.explode("words").alias("w")).select(F.shiftrightunsigned("w", 64 - BITS).alias("bucket")).distinct()  # at most 2 ** BITS rows
    wanted = np.zeros(1 << BITS, bool)
    wanted[mine.toPandas()["bucket"].to_numpy(np.int64)] = True
    seen, n = document_frequency(docs, wanted)
    idf = np.where(wanted, FLOOR + np.log((n + 1) / (seen + 1)), 0)
    number, terms = latent_space(found, idf)
    parts = -(-total // BLOCK)
    numbered = found.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(max(1, parts))))
    return [Block.of(numbered.where(F.col("block") == b).orderBy("item_id", "words").collect(), idf, number, terms) for b in range(parts)]


def leaks(docs: DataFrame, blocks: list[Block]) -> DataFrame:
    """doc_id, item_id and share (of the passage's words, best passage of the item)
    for every document that holds a benchmark item. A null or empty text holds
    none; repeated rows give repeated results; with an empty benchmark there are none."""
    shape = "doc_id bigint, item_id bigint, share double"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = rows.limit(0).selectExpr("doc_id", "doc_id as item_id", "cast(null as double) as share")
    for block in blocks:

        def search(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in col.pieces(batches, "text"):
                got = block.matches(batch.column("text"))
                doc = batch.column("doc_id").take(pa.array([g[0] for g in got], pa.int64()))
                yield pa.record_batch([doc, pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())], ["doc_id", "item_id", "share"])

        out = out.union(rows.mapInArrow(search, shape))
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share")) if len(blocks) > 1 else out


def without_leaks(docs: DataFrame, blocks: list[Block]) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""

    def clean(block: Block):
        @F.pandas_udf("boolean")
        def free(texts: pd.Series) -> pd.Series:
            out, at = np.ones(len(texts), bool), 0
            for piece in col.pieces([pa.record_batch([pa.array(texts, pa.string(), from_pandas=True)], ["text"])], "text"):
                for d, _, _ in block.matches(piece.column(0)):
                    out[at + d] = False
                at += piece.num_rows
            return pd.Series(out)

        return free("text")

    for block in blocks:
        docs = docs.where(clean(block))
    return docs
