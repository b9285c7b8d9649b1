"""Removal of repeated passages by hashing of lines and sentences.

A text is cut behind every line break and every sentence end (``.``, ``!`` or ``?``
before a blank), or behind blank lines into paragraphs; the units together are the
whole text. They are normalised - A-Z lower-cased, runs of blanks made one, ends
trimmed - and hashed. Digests are grouped over the whole corpus with map-side
minima; the earliest occurrence (smallest doc_id, then position) stays, later ones
are repeats. Repeats that follow one another form a run, and a run goes when it
holds at least ``shortest`` words: a stock line that stands alone stays. Units that
are blank are never removed, and don't end a run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tieout.llm import columnar as col
from tieout.llm.stash import id_key, stash, text_key

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: What ends a unit.
SENTENCES, PARAGRAPHS = re.compile(rb"\n|[.!?][ \t\r\f\v\n]+"), re.compile(rb"\n[ \t\r\f\v]*\n+")
#: Words of the shortest run of repeats that goes.
SHORTEST = 25
#: A digest that is more than 1 / HOT of all repeats is spread over SALTS tasks; there are fewer than HOT of them.
HOT, SALTS = 500, 32


def units(text: bytes, ends: re.Pattern) -> list[tuple[int, int]]:
    """Start and end (in bytes) of each unit, its end mark included."""
    cuts = [0, *(m.end() for m in ends.finditer(text))]
    if cuts[-1] < len(text):
        cuts.append(len(text))
    return list(zip(cuts, cuts[1:]))


def long_runs(text: bytes, spans: list[tuple[int, int]], repeats: set[int], shortest: int) -> set[int]:
    """Numbers of the repeated units that stand in a run of at least ``shortest`` words."""
    gone: set[int] = set()
    run: list[int] = []
    words = 0
    for i, (a, b) in enumerate(spans):
        if i in repeats:
            run.append(i)
            words += len(text[a:b].split())
        elif text[a:b].strip():
            if words >= shortest:
                gone.update(run)
            run, words = [], 0
    if words >= shortest:
        gone.update(run)
    return gone


def without_repeats(docs: DataFrame, paragraphs: bool = False, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and more) as ``row``, with n_units, ``removed``,
    the units that went as an array of (start, stop) in characters of the original
    text, and ``kept``, the rest of the text as it stands.

    ``shortest`` 1 removes every repeated unit. A null text counts as empty and has no
    unit; a null doc_id is the smallest id. Rows that repeat doc_id and text are one
    document and each show its result; rows that share a doc_id with different texts
    are documents ordered by text hash.
    """
    ends = PARAGRAPHS if paragraphs else SENTENCES
    keyed = docs.select(id_key().cast("bigint").alias("d"), text_key().alias("t"), F.coalesce("text", F.lit("")).alias("text"), F.struct("*").alias("row"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in col.pieces(batches, "text"):
            owner, place, digest = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                lower = text.encode().translate(_LOWER)
                for p, (a, b) in enumerate(units(lower, ends)):
                    unit = b" ".join(lower[a:b].split())
                    if unit:
                        owner.append(i)
                        place.append(p)
                        digest.append(hashlib.blake2b(unit, digest_size=16).digest())
            at = pa.array(owner, pa.int64())
            yield pa.record_batch([batch.column("d").take(at), batch.column("t").take(at), pa.array(place, pa.int32()), pa.array(digest, pa.binary())], ["d", "t", "place", "digest"])

    found = keyed.select("d", "t", "text").mapInArrow(hashed, "d bigint, t int, place int, digest binary")
    where = F.struct("d", "t", "place")
    first = stash(found.groupBy("digest").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1"), "units")
    # Both copies of this one-row total and of the few hot digests are small by construction.
    hot = first.join(F.broadcast(first.agg(F.sum("n").alias("all"))), F.col("n") * HOT > F.col("all"))
    salted = found.join(F.broadcast(hot.select("digest", F.lit(True).alias("hot"))), "digest", "left")
    salted = salted.select("d", "t", "place", "digest", F.when(F.col("hot"), F.pmod(F.hash("d", "place"), F.lit(SALTS))).otherwise(0).alias("salt"))
    copies = first.join(F.broadcast(hot.select("digest", F.lit(True).alias("hot"))), "digest", "left")
    copies = copies.select("digest", "first", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    late = salted.join(copies, ["digest", "salt"]).where(where != F.col("first"))
    repeats = late.groupBy("d", "t").agg(F.collect_set("place").alias("repeats"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in col.pieces(batches, "text"):
            count, removed, kept = [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("repeats").to_pylist()):
                data = text.encode()
                spans = units(data, ends)
                gone = long_runs(data, spans, set(places), shortest) if places else set()
                went, rest, at, chars = [], [], 0, 0
                for i in sorted(gone):
                    a, b = spans[i]
                    before, inside = data[at:a].decode(), data[a:b].decode()
                    start = chars + len(before)
                    chars, at = start + len(inside), b
                    went.append({"start": start, "stop": chars})
                    rest.append(before)
                count.append(len(spans))
                removed.append(went)
                kept.append("".join([*rest, data[at:].decode()]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.record_batch([batch.column("row"), pa.array(count, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.string())], ["row", "n_units", "removed", "kept"])

    extra = StructType.fromDDL("n_units bigint, removed array<struct<start:bigint,stop:bigint>>, kept string")
    return keyed.join(repeats, ["d", "t"], "left").select("row", "text", "repeats").mapInArrow(cut, StructType([keyed.schema["row"], *extra.fields]))
