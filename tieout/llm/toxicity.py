"""Toxicity by multiple-instance learning.

Labels belong to documents, the model to sentences: a sentence is toxic with
probability s = sigmoid(bias + weights of its features), a document unless all
of its sentences are clean: 1 - product(1 - s). The weights are fitted on the
document labels through that noisy-or, and the same sentence probabilities then
say where a document offends.

Features are a sentence's lower-cased words and their first 4, 5 and 6 bytes,
as 64-bit hashes. Fitting uses a bounded sample of labelled rows
(``SAMPLE``: so many rows of each class, those with the smallest hash of
their id, and of these as many as fit into ``SAMPLE_BYTES``, in that order); scoring
covers every document and every sentence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.llm import columnar as col
from tieout.llm.stash import pick, stash

#: Labelled rows used for fitting, of each class at most, and the bytes of their texts together.
SAMPLE = {1: 3000, 0: 5000}
SAMPLE_BYTES = 96 << 20
#: Features kept, those most tied to label 1.
FEATURES = 20_000
PREFIXES = (4, 5, 6)
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights, and the bias of a sentence."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def sentence_scores(self, found: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Probability of each of n sentences; ``found`` are feature numbers."""
        z = self.bias + np.bincount(owner, self.weights[found], minlength=n)
        return 1 / (1 + np.exp(-z))


@dataclass(frozen=True)
class Sentences:
    """Sentences with words of a piece of documents, in order."""

    doc: np.ndarray  # document number of each sentence
    start: np.ndarray  # first byte of its first word
    end: np.ndarray  # after the last byte of its last word
    feature: np.ndarray  # feature hashes
    owner: np.ndarray  # sentence number of each feature


def sentences(data: np.ndarray, offsets: np.ndarray) -> Sentences:
    data = col.fold(data)
    start, end, doc = col.word_spans(data, offsets, col.ALNUM_WORDS)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Sentences(none, none, none, none.astype(np.uint64), none)
    place = np.cumsum(_BREAK[data])[start] + doc
    number = np.concatenate([[0], np.cumsum(place[1:] != place[:-1])])
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    hashed = col.Hasher(data)
    feature, owner = [hashed(start, end)], [number]
    for n in PREFIXES:
        at = end - start > n
        feature.append(hashed(start[at], start[at] + n) ^ np.uint64(n))
        owner.append(number[at])
    return Sentences(doc[first], start[first], end[last], np.concatenate(feature), np.concatenate(owner))


def _known(features: np.ndarray, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features the model knows, with their sentences; once for each sentence."""
    if not len(features) or not len(s.feature):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(features, s.feature), len(features) - 1)
    hit = features[at] == s.feature
    pair = np.unique(s.owner[hit] * len(features) + at[hit])
    return pair % len(features), pair // len(features)


class Counts:
    """Documents with each feature, and how many of them are of label 1. Holds one
    entry per distinct feature and a few pieces' worth of new ones."""

    def __init__(self):
        self.held = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, feature: np.ndarray, label: np.ndarray) -> None:
        """A piece of documents: a row per document and feature."""
        names, number = np.unique(feature, return_inverse=True)
        self.new.append((names, np.bincount(number, minlength=len(names)).astype(float), np.bincount(number, label, minlength=len(names))))
        self.waiting += len(names)
        if self.waiting > max(1 << 20, len(self.held[0])):
            self.table()

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features in order, documents with them, those of label 1."""
        every = [np.concatenate(x) for x in zip(self.held, *self.new)]
        names, number = np.unique(every[0], return_inverse=True)
        self.held = names, *(np.bincount(number, x, minlength=len(names)) for x in every[1:])
        self.new, self.waiting = [], 0
        return self.held


def _numbered(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of a batch with the number of their first row."""
    base = 0
    for piece in col.pieces([batch], "text"):
        yield base, piece
        base += piece.num_rows


def fit(texts: pa.Array, labels: np.ndarray, weight: np.ndarray, rounds: int = 800, rate: float = 0.1, penalty: float = 2e-3) -> Model:
    """Fit on one table of labelled texts; ``weight`` is each row's weight.
    Without both classes the model has no features and its bias is the share of label 1."""
    labels = labels.astype(np.float64)
    prior = float(np.average(labels, weights=weight)) if len(labels) else 0.5
    if not len(labels) or labels.min() == labels.max():
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(p / (1 - p))))
    batch = pa.record_batch([texts], ["text"])
    counts = Counts()
    for base, piece in _numbered(batch):
        s = sentences(*col.flat(piece.column(0)))
        feature, owner = col.unique_pairs(s.feature, s.doc[s.owner] + base)
        counts.add(feature, labels[owner])
    names, with_it, toxic = counts.table()
    rate_1, rate_0 = (toxic + 0.5) / (labels.sum() + 1), (with_it - toxic + 0.5) / ((1 - labels).sum() + 1)
    tie = np.log(rate_1 / rate_0)
    tie[(toxic < 2) | (tie < 1)] = -np.inf
    best = np.argsort(-tie, kind="stable")[:FEATURES]
    names = np.sort(names[best[np.isfinite(tie[best])]])

    # once more over the texts, now for the features that are kept
    found, place, doc, total = [], [], [], 0
    for base, piece in _numbered(batch):
        s = sentences(*col.flat(piece.column(0)))
        f, o = _known(names, s)
        found.append(f)
        place.append(o + total)
        doc.append(s.doc + base)
        total += len(s.doc)
    found, place, doc = np.concatenate(found), np.concatenate(place), np.concatenate(doc)
    w, bias = np.zeros(len(names)), -6.0
    grads = np.zeros((2, len(names) + 1))
    share = weight / weight.sum()
    for step in range(1, rounds + 1):
        z = bias + np.bincount(place, w[found], minlength=total)
        q = np.maximum(np.bincount(doc, np.logaddexp(0, z), minlength=len(labels)), 1e-9)
        by_doc = share * np.where(labels == 1, -1 / np.expm1(q), 1.0)
        by_sentence = by_doc[doc] / (1 + np.exp(-z))
        g = np.append(np.bincount(found, by_sentence[place], minlength=len(names)) + penalty * w / max(len(names), 1), by_sentence.sum())
        grads[0] += 0.1 * (g - grads[0])
        grads[1] += 0.01 * (g * g - grads[1])
        move = rate * (grads[0] / (1 - 0.9**step)) / (np.sqrt(grads[1] / (1 - 0.99**step)) + 1e-9)
        w = np.clip(w - move[:-1], 0, None)  # a feature only ever speaks for label 1
        bias -= move[-1]
    keep = w > 0
    return Model(names[keep], w[keep], float(bias))


def score_piece(model: Model, texts: pa.Array) -> tuple[Sentences, np.ndarray, np.ndarray]:
    """Sentences of some texts, their probabilities, and those of the texts."""
    s, n = sentences(*col.flat(texts)), len(texts)
    p = model.sentence_scores(*_known(model.features, s), len(s.doc))
    clean = np.bincount(s.doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)
    blank = 1 / (1 + np.exp(-model.bias))
    return s, p, np.clip(np.where(np.bincount(s.doc, minlength=n) > 0, -np.expm1(clean), blank), 0, 1)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Model:
    """Fit on labelled documents. ``docs`` has doc_id and text, ``labels`` doc_id
    and toxic; ``usable`` limits the label rows (over their columns). Null ids,
    null labels and labels other than 0 and 1 are not used; of labels that repeat
    an id the largest counts, of documents that repeat an id the smallest text."""
    marks = pick(labels.where(usable) if usable is not None else labels, {"doc_id": "doc_id", "toxic": "toxic"})
    marks = marks.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    count = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = None
    for value, most in SAMPLE.items():
        some = marks.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        sample = some if sample is None else sample.unionByName(some)
    # SAMPLE bounds the rows of this side, so it can be sent to every task
    rows = pick(docs, {"doc_id": "doc_id", "text": "text"}).join(F.broadcast(sample), "doc_id")
    rows = stash(rows.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "labelled")
    before = F.sum(F.octet_length("text").cast("bigint")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over the sample's rows
    fits = rows.select("doc_id", before.alias("bytes")).where(F.col("bytes") <= SAMPLE_BYTES).select("doc_id")
    rows = rows.join(F.broadcast(fits), "doc_id")
    used = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    each = {v: count.get(v, 0) / max(1, used.get(v, 0)) for v in SAMPLE}

    def fitted(table: pa.Table) -> pa.Table:
        order = np.lexsort((np.diff(col.flat(table["text"])[1]), table["doc_id"].to_numpy()))
        table = table.take(order)
        mark = table["toxic"].to_numpy()
        model = fit(table["text"].combine_chunks(), mark, np.where(mark == 1, each[1], each[0]))
        return pa.table({"feature": model.features.view(np.int64).tolist() + [0], "weight": model.weights.tolist() + [model.bias]},
                        schema=pa.schema([("feature", pa.int64()), ("weight", pa.float64())]))

    got = rows.groupBy(F.lit(0).alias("one")).applyInArrow(fitted, "feature bigint, weight double").toPandas()
    if got.empty:
        return fit(pa.array([], pa.string()), np.zeros(0), np.zeros(0))
    return Model(got["feature"].to_numpy(np.int64)[:-1].view(np.uint64), got["weight"].to_numpy()[:-1], float(got["weight"].iloc[-1]))


def score(docs: DataFrame, model: Model, offending: float = 0.5) -> DataFrame:
    """One row per document: doc_id, ``score`` (0 to 1) and ``sentences``, an array
    of (start, end, score, text) for the sentences with a score of ``offending``
    or more; start and end count UTF-8 bytes. A text that is null, empty or
    without words has no sentence; its score is that of one sentence without
    features."""
    sentence = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("text", pa.string())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in col.pieces(batches, "text"):
            data, offsets = col.flat(batch.column("text"))
            s, p, total = score_piece(model, batch.column("text"))
            spots: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(p >= offending):
                d, a, b = s.doc[i], s.start[i], s.end[i]
                spots[d].append({"start": int(a - offsets[d]), "end": int(b - offsets[d]), "score": float(p[i]), "text": data[a:b].tobytes().decode("utf-8", "replace")})
            yield pa.record_batch([batch.column("doc_id"), pa.array(total), pa.array(spots, pa.list_(sentence))], ["doc_id", "score", "sentences"])

    shape = "doc_id bigint, score double, sentences array<struct<start:bigint,end:bigint,score:double,text:string>>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(scored, shape)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose document scores under ``threshold``, with all
    their columns. Repeated rows stay repeated."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in col.pieces(batches, "text"):
            yield piece.filter(pa.array(score_piece(model, piece.column("text"))[2] < threshold))

    return docs.mapInArrow(clean, docs.schema)
