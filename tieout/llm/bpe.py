"""Byte-level BPE by a global shuffle of distinct words.

Texts are dealt into blocks of some MB. Each block cuts its texts into
pre-tokens, whose order in the text is their position, and sends each distinct
word once. Words meet by their bytes over the whole corpus, every distinct word
is encoded once, and its ids go back to the blocks that asked for it, where they
are joined to the positions and put together again. Decoding joins the ids with
the table of token bytes.

The split is the rank file's pattern, computed for whole columns at once from
the class of each character (letter, number, white space, other).
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm import columnar as col
from tieout.llm.stash import text_key

BLOCK_BYTES = 6 << 20
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
#: The endings that follow an apostrophe as one pre-token.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    every = "".join(map(chr, range(0x110000)))
    out = np.full(0x110000, _OTHER, np.uint8)
    for pattern, value in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\p{White_Space}+", _SPACE)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = value
    return out


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each pre-token in ``data`` (with len(data) at the end; they leave no
    gaps) and its text number."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    point = data[lead].astype(np.uint32)
    for low, high, keep, more in ((0xC0, 0xDF, 0x1F, 1), (0xE0, 0xEF, 0x0F, 2), (0xF0, 0xFF, 0x07, 3)):
        at = np.flatnonzero((data[lead] >= low) & (data[lead] <= high))
        value = point[at] & keep
        for j in range(1, more + 1):
            value = (value << 6) | (padded[lead[at] + j] & 0x3F)
        point[at] = value
    kind = _classes()[point]
    n = len(kind)
    opens = np.zeros(n + 1, bool)  # a text starts with this character
    opens[np.searchsorted(lead, offsets)] = True
    opens[0] = opens[n] = True
    begin = opens[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # one blank goes with what follows it
    follows = np.flatnonzero(begin & ~space & ~opens[:n])
    begin[follows[point[follows - 1] == 0x20]] = False
    # of white space before something else, the last character is on its own or goes with it
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~opens[1:n])
    begin[last] = True
    mark = np.flatnonzero((point == 0x27) & begin)
    if len(mark):
        wide = np.concatenate([point, [0, 0, 0]])
        same = np.concatenate([~opens, [False, False]])
        for ending in _ENDINGS:
            hit = mark[np.all([(wide[mark + j + 1] == ord(c)) & same[mark + j + 1] for j, c in enumerate(ending)], axis=0)] if len(mark) else mark
            begin[hit + 1] = False
            beyond = hit + 1 + len(ending)
            begin[beyond[beyond < n]] = True
    start = lead[begin]
    return np.append(start, len(data)), np.searchsorted(offsets, start, side="right") - 1


def spelled(data: np.ndarray, start: np.ndarray) -> pa.Array:
    """The pre-tokens between consecutive starts as bytes, without a copy."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start) - 1, [None, pa.py_buffer(np.ascontiguousarray(start, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens in the order of their ids, and where each begins."""
    table = ranks(path)
    words = [b""] * (max(table.values()) + 1)
    for word, number in table.items():
        words[number] = word
    edges = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    return np.frombuffer(b"".join(words), np.uint8), edges


def _blocks(docs: DataFrame) -> DataFrame:
    """key, text and block of every row; a block holds about BLOCK_BYTES."""
    total = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", text_key()), F.lit(n))).repartition("block")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ``ids`` (packed little-endian unsigned 32-bit integers) of
    every row of ``docs``, by the ranks in the file at ``path`` (present on every
    executor). A null text counts as empty and gives no ids; repeated rows and
    null ids stay as they are."""
    blocks = _blocks(docs)

    def distinct(group: pa.Table) -> pa.Table:
        words = []
        for piece in col.pieces(group.select(["text"]).to_batches(), "text"):
            data, offsets = col.flat(piece.column("text"))
            words.append(pc.unique(spelled(data, pretokens(data, offsets)[0])))
        word = pc.unique(pa.chunked_array(words, pa.large_binary())).cast(pa.binary())
        return pa.table([pa.repeat(group["block"][0], len(word)), word], names=["block", "word"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _encoder(path).encode_ordinary
        last, ids = None, b""
        for batch in batches:
            seen = pc.dictionary_encode(batch.column("word"))
            table = []
            for word in seen.dictionary.to_pylist():
                if word != last:  # words come in order, so one can go on from the batch before
                    last, ids = word, np.array(one(word.decode()), "<u4").tobytes()
                table.append(ids)
            yield pa.record_batch([batch.column("block"), batch.column("word"), pa.array(table, pa.binary()).take(seen.indices)], ["block", "word", "ids"])

    def joined(texts: pa.Table, words: pa.Table) -> pa.Table:
        known = words["word"].combine_chunks().cast(pa.large_binary())
        packed, at = col.flat(words["ids"])
        packed, at = packed.view("<u4") if len(packed) else np.zeros(0, "<u4"), at // 4
        out = []
        for piece in col.pieces(texts.to_batches(), "text"):
            data, offsets = col.flat(piece.column("text"))
            start, owner = pretokens(data, offsets)
            word = pc.index_in(spelled(data, start), known).to_numpy()
            ids, edge = col.gather(packed, at[word], at[word + 1] - at[word])
            edge = edge[np.searchsorted(owner, np.arange(piece.num_rows + 1))]
            out.append(pa.record_batch([piece.column("doc_id"), pa.array(np.diff(edge)), col.take_spans(ids.view(np.uint8), 4 * edge[:-1], 4 * edge[1:])], ["doc_id", "n_tokens", "ids"]))
        return pa.Table.from_batches(out, pa.schema([texts.schema.field("doc_id"), ("n_tokens", pa.int64()), ("ids", pa.binary())]))

    asked = blocks.groupBy("block").applyInArrow(distinct, "block bigint, word binary")
    answers = asked.repartition("word").sortWithinPartitions("word").mapInArrow(encoded, "block bigint, word binary, ids binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(joined, f"doc_id {kind}, n_tokens bigint, ids binary")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode`` with ``decoded``, the bytes of their ids. An unknown id fails."""

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, begin = _token_bytes(path)
        for batch in col.pieces(batches, "ids"):
            packed, offsets = col.flat(batch.column("ids"))
            ids = packed.view("<u4").astype(np.int64) if len(packed) else np.zeros(0, np.int64)
            text, edge = col.gather(table, begin[ids], begin[ids + 1] - begin[ids])
            edge = edge[offsets // 4]
            yield pa.record_batch([*batch.columns, col.take_spans(text, edge[:-1], edge[1:])], [*batch.schema.names, "decoded"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(bytes_of, f"doc_id {kind}, n_tokens bigint, ids binary, decoded binary")
