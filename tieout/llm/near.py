"""Near-duplicates by a chosen-path set similarity join.

Documents become sets of 5-word shingles, equal sets become one class, and
every class carries minwise tokens. Each tree picks one or two token positions
at its root; a class follows every picked position into the child node named by
its token there, so classes that agree meet. A node of a few classes is
compared exhaustively, in this order: its pivot (the smallest class) with every other
member; then, after components have been updated, the members that are not in
the pivot's component (strays) with all others. Members of one component need no
comparison, and since 1 - similarity is a metric, a member at distance d from the
pivot can only link to strays nearer than 0.25 + d to it. A large node that still
has many strays branches again on further positions; what holds together below
the roots up to DENSE classes is compared as a whole in one task. So a group of near copies costs one
comparison per member however large it is, no pairs of a group are listed, and
no node is cut off.

Candidates are confirmed on the full sets (64-bit shingle hashes modulo a prime, by
bases drawn for the run, one for the tokens and others for the confirming steps). Roots use
disjoint positions: a pair at the threshold shares no root node with
probability 0.25 ** (number of root positions), 2e-13 for the 21 here. Pairs that
a large root node leaves to its children have to agree there again, which that
figure does not cover.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm import columnar as col
from tieout.llm.stash import discard, id_key, stash, text_key

TREES = 16
#: Token positions below the roots; a node takes one or two of them.
DEEPER = 26
#: Classes in a node that is compared exhaustively.
SMALL = 200
#: Members outside the pivot's component that are compared with every member of a larger node.
FEW = 8
#: Classes in a node below the roots that one task compares on their full sets.
#: What still holds together there is dense, and branching would only repeat it.
DENSE = 2000
#: Documents whose texts are picked by a key table that is sent to every task.
KEYS = 100_000
#: Pairs whose minwise tokens agree in fewer positions are not compared on their
#: sets. Of the 47 positions a pair at the threshold agrees in 35 on average, and
#: in 15 or fewer with probability 3e-10; at similarity 0.7 that is 3e-8.
AGREE = 16
UNLIKE = 0.3
WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75

_ROOTS = [[(tree, tree + tree // 3 + i) for i in range(2 if tree % 3 == 2 else 1)] for tree in range(TREES)]
ROOTS = [(tree, position) for picked in _ROOTS for tree, position in picked]
_N_ROOTS = max(p for _, p in ROOTS) + 1
KEY = "struct<d:bigint,t:int>"


def document_sets(texts: pa.Array, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (by a base drawn for the run) and the text number of each, both in order."""
    data, offsets = col.flat(texts)
    data = col.LOWER[data]
    start, end, doc = col.word_spans(data, offsets, col.BLANK_WORDS)
    return col.unique_pairs(*col.shingles(col.Hasher(data, base)(start, end), doc, len(texts), WORDS))


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = col.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return a | np.uint64(1), col.mix(a)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key columns d and t, n_shingles, two halves of a 128-bit sum over
    the set (equal for equal sets) and its minwise tokens."""
    n_tokens, base = _N_ROOTS + DEEPER, col.draw_base()
    factor, shift = _steps(n_tokens)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in col.pieces(batches, "text"):
            n = batch.num_rows
            value, owner = document_sets(batch.column("text"), base)
            size = np.bincount(owner, minlength=n)
            tokens = np.empty((n, n_tokens), np.int32)
            for i in range(n_tokens):
                least = col.minima((value ^ shift[i]) * factor[i], owner, n, 0)
                tokens[:, i] = (least >> np.uint64(16)).astype(np.uint32).view(np.int32)
            halves = [col.sums(col.mix(value ^ s), owner, n).view(np.int64) for s in shift[:2]]
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * n_tokens, n_tokens, dtype=np.int32)), pa.array(tokens.ravel()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("d"), batch.column("t"), pa.array(size), pa.array(halves[0]), pa.array(halves[1]), sig],
                                  ["doc_id", "d", "t", "n", "f1", "f2", "sig"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), id_key().cast("bigint").alias("d"), text_key().alias("t"), "text")
    return rows.mapInArrow(signed, "doc_id bigint, d bigint, t int, n bigint, f1 bigint, f2 bigint, sig array<int>")


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Key and text of the documents in ``keys`` (distinct k)."""
    rows = docs.select(F.struct(id_key().cast("bigint").alias("d"), text_key().alias("t")).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(keys, "k", "left_semi")


def _only(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts of at most KEYS documents without a shuffle of the others; all, if more are asked for."""
    keys = keys.distinct()
    return texts.join(F.broadcast(keys), "k", "left_semi") if keys.limit(KEYS + 1).count() <= KEYS else texts


def _confirm(pairs: DataFrame, texts: DataFrame, passing: list[str]) -> DataFrame:
    """Pairs (a, b) with ``both`` and ``either``, the sizes of intersection and union of their full sets."""
    pairs = stash(pairs.select("a", "b"), "asked", passing)
    texts = _only(texts, pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))))
    base = col.draw_base()  # not that of the tokens: what one hash confuses the other tells apart
    left, right = (texts.select(F.col("k").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in col.pieces(batches, "text_a", "text_b"):
            (va, oa), (vb, ob) = (document_sets(batch.column(f"text_{c}"), base) for c in "ab")
            n = batch.num_rows
            value, owner = np.concatenate([va, vb]), np.concatenate([oa, ob])
            order = np.lexsort((value, owner))
            value, owner = value[order], owner[order]
            twice = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
            both = np.bincount(owner[1:][twice], minlength=n)
            either = np.bincount(owner, minlength=n) - both
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(both), pa.array(either)], ["a", "b", "both", "either"])

    joined = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(compared, f"a {KEY}, b {KEY}, both bigint, either bigint")


def _agreeing(a: str, b: str) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) >= AGREE


def _alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in enough minwise tokens."""
    sides = [classes.select(F.col("k").alias(c), F.col("sig").alias(f"s{c}")) for c in "ab"]
    return pairs.join(sides[1], "b").join(sides[0], "a").where(_agreeing("sa", "sb")).select("a", "b")


def _exhausted(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that connect the members of each node (node, k) as all their links
    would: every pair of a node is compared on its full sets, by posting lists."""
    shape = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("both", pa.int64()), ("either", pa.int64())])
    drawn = col.draw_base()

    def compared(group: pa.Table) -> pa.Table:
        n = group.num_rows
        values, owners, base = [], [], 0
        for piece in col.pieces(group.select(["text"]).to_batches(), "text"):
            value, owner = document_sets(piece.column(0), drawn)
            values.append(value)
            owners.append(owner + base)
            base += piece.num_rows
        value, owner = np.concatenate(values), np.concatenate(owners)
        size = np.bincount(owner, minlength=n)
        order = np.argsort(value, kind="stable")
        ranked = value[order]
        first, last = np.searchsorted(ranked, value), np.searchsorted(ranked, value, side="right")
        posting, edge = owner[order], np.searchsorted(owner, np.arange(n + 1))
        root = list(range(n))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        weight = [1] * n
        links: list[tuple[int, int, int, int]] = []
        for i in range(n):
            mine = slice(edge[i], edge[i + 1])
            both = np.bincount(col.gather(posting, first[mine], last[mine] - first[mine])[0], minlength=n)
            either = size[i] + size - both
            for j in np.flatnonzero(100 * both >= PERCENT * either):
                x, y = top(i), top(int(j))
                if x != y:
                    x, y = (x, y) if weight[x] >= weight[y] else (y, x)
                    root[y] = x
                    weight[x] += weight[y]
                    links.append((i, int(j), int(both[j]), int(either[j])))
        at = pa.table([pa.array(x, t) for x, t in zip(zip(*links), shape.types)], schema=shape) if links else shape.empty_table()
        k = group["k"].combine_chunks()
        return pa.table([k.take(at["a"]), k.take(at["b"]), at["both"], at["either"]], names=["a", "b", "both", "either"])

    rows = nodes.join(_only(texts, nodes.select("k")), "k").select("node", "k", "text")
    return rows.groupBy("node").applyInArrow(compared, f"a {KEY}, b {KEY}, both bigint, either bigint")


def _linked() -> Column:
    return 100 * F.col("both") >= PERCENT * F.col("either")


def _unsettled(held: DataFrame) -> DataFrame:
    """(node, k, c, stray) of the members that can still have a link to find in their
    node. ``held`` has members (node, p, k), the components c of k and pc of the pivot
    p (null: alone) and ``far``, the distance to the pivot (null: not compared)."""
    home = F.coalesce("c", "k")
    stray = home != F.coalesce("pc", "p")
    # without a comparison a stray is at least UNLIKE away, and a member that a chain holds may be at any distance
    far = F.coalesce("far", F.when(stray, F.lit(UNLIKE)).otherwise(F.lit(1.0)))
    held = held.select("node", "k", far.alias("far"), home.alias("c"), stray.alias("stray"))
    least = held.where("stray").groupBy("node").agg(F.min("far").alias("least"))
    limit = 1 - PERCENT / 100
    return held.join(least, "node").where(F.col("stray") | (F.col("far") >= F.col("least") - limit - 1e-9)).select("node", "k", "c", "stray")


def _children(classes: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """Rows (node, k) one level below: each node takes one or two of the deeper positions, by its hash."""
    h = F.xxhash64("node", F.lit(level))
    first = F.pmod(h, F.lit(DEEPER))
    second = F.pmod(first + 1 + F.pmod(F.shiftright(h, 20), F.lit(DEEPER - 1)), F.lit(DEEPER))
    picked = F.when(F.pmod(F.shiftright(h, 40), F.lit(3)) == 0, F.array(first, second)).otherwise(F.array(first))
    found = nodes.join(classes.select("k", "sig"), "k").select("node", "k", "sig", F.explode(picked).alias("at"))
    return found.select(F.xxhash64("node", F.lit(level), "at", F.element_at("sig", (F.col("at") + _N_ROOTS + 1).cast("int"))).alias("node"), "k")


def components(edges: DataFrame, passing: list[str] | None = None) -> DataFrame:
    """(k, c) for every end of an edge (a, b): c is the smallest end reachable.
    Labels fall along edges and then jump to their label's label, so rounds grow
    with the logarithm of a component's width."""
    both = stash(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges", passing)
    label = stash(both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.first("a")).alias("c")), "labels", passing)
    while True:
        near = both.join(label.withColumnRenamed("k", "b"), "b").groupBy(F.col("a").alias("k")).agg(F.min("c").alias("m"))
        low = label.join(near, "k").select("k", F.least("c", "m").alias("c"), F.col("c").alias("was"))
        jump = low.select(F.col("k").alias("c"), F.col("c").alias("cc"))
        new = stash(low.join(jump, "c").select("k", F.least("c", "cc").alias("c"), "was"), "labels", passing)
        label = new.select("k", "c")
        if new.where("c <> was").isEmpty():
            return label


def link(docs: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Classes of equal sets (k, n, f1, f2) and the components (k, c) of those that
    have confirmed links; None without any. ``seen`` is the stored result of ``signatures``."""
    sets = seen.where("n > 0").groupBy("f1", "f2", "n").agg(F.min(F.struct("d", "t")).alias("k"), F.first("sig").alias("sig"))
    classes = stash(sets, "classes")
    roots = F.array(*[F.xxhash64(F.lit(tree), F.lit(p), F.element_at("sig", p + 1)) for tree, p in ROOTS])
    nodes = classes.select("k", F.explode(roots).alias("node"))
    texts, found, label, level, passing = None, [], None, 0, []
    while True:
        level += 1
        meet = nodes.groupBy("node").agg(F.count("*").alias("size"), F.min("k").alias("p")).where("size > 1")
        members = stash(nodes.join(meet, "node").select("node", "p", "k", "size"), "members", passing)
        if texts is None:
            texts = stash(_texts(docs, members.select("k").distinct()), "texts", passing)
        if level > 1:
            found.append(stash(_exhausted(members.where(F.col("size") <= DENSE).select("node", "k"), texts), "dense", passing))
            members = members.where(F.col("size") > DENSE)
        members = members.where("k <> p")
        if members.isEmpty():
            break
        alike = _alike(members.select(F.col("p").alias("a"), F.col("k").alias("b")).distinct(), classes)
        stars = stash(_confirm(alike, texts, passing), "stars", passing)
        found.append(stars.where(_linked()))
        # what the pivot leaves open, for each node: members of other components, and
        # those of its own that the distances do not rule out as their partners
        label, found = _merged(label, found, passing), []
        home = label.withColumnRenamed("k", "p").withColumnRenamed("c", "pc")
        far = 1 - F.col("both") / F.col("either")
        held = members.join(stars.select(F.col("a").alias("p"), F.col("b").alias("k"), far.alias("far")), ["p", "k"], "left").join(home, "p", "left").join(label, "k", "left")
        left = stash(_unsettled(held), "left", passing)
        if left.isEmpty():
            break
        counts = left.groupBy("node").agg(F.count("*").alias("rest"), F.count_if("stray").alias("strays")).where("rest > 1")
        # few strays are compared with every member, many branch
        small = (F.col("rest") <= SMALL) | (F.col("strays") <= FEW)
        near = left.join(counts.where(small), "node").join(classes.select("k", "sig"), "k")
        stray = near.where("stray").select("node", F.col("k").alias("a"), F.col("c").alias("ca"), F.col("sig").alias("sa"))
        other = near.select("node", F.col("k").alias("b"), F.col("c").alias("cb"), F.col("stray").alias("both_ways"), F.col("sig").alias("sb"))
        pairs = stray.join(other, "node").where("ca <> cb and (a < b or not both_ways)").where(_agreeing("sa", "sb"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found.append(stash(_confirm(pairs, texts, passing), "pairs", passing).where(_linked()))
        nodes = stash(_children(classes, left.join(counts.where(~small), "node").select("node", "k"), level), "nodes", passing)
    label = _merged(label, found, passing)
    label = label if label is None else stash(label, "components")
    discard(docs.sparkSession, passing)
    return classes, label


def _merged(label: DataFrame | None, found: list[DataFrame], passing: list[str]) -> DataFrame | None:
    """Components (k, c) after further links: these join old components, so only
    links between different ones are followed."""
    if not found:
        return label
    edges = reduce(DataFrame.union, [part.select("a", "b") for part in found])
    if label is None:
        return components(edges, passing)
    home = [label.select(F.col("k").alias(x), F.col("c").alias(f"c{x}")) for x in "ab"]
    ends = edges.join(home[0], "a", "left").join(home[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    fresh = stash(ends.where("a <> b").distinct(), "edges", passing)
    if fresh.isEmpty():
        return label
    joined = components(fresh, passing)
    moved = label.join(joined.select(F.col("k").alias("c"), F.col("c").alias("to")), "c", "left").select("k", F.coalesce("to", "c").alias("c"))
    return stash(moved.union(joined.join(label.select("k"), "k", "left_anti").select("k", "c")), "labels", passing)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id
    and kept.

    component_id is the smallest doc_id reachable over links, the document's own
    included; ``kept`` marks the row with that id. Documents without words have
    an empty set and no links. A null doc_id counts as the smallest id. Rows that
    repeat doc_id and text are one document and each get its result; rows that
    share a doc_id with different texts are documents of their own.
    """
    rows, label = _labelled(docs)
    mine = F.coalesce(F.col("c.d"), F.col("d"))
    shown = F.when(mine != -(2**63), mine)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), shown.alias("component_id"), F.col("doc_id").eqNullSafe(shown).alias("kept"))


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signature rows with c, the key of their component's first document."""
    seen = stash(signatures(docs), "signatures")
    classes, label = link(docs, seen)
    if label is None:
        label = classes.select("k", F.col("k").alias("c")).limit(0)
    home = classes.select("f1", "f2", "n", "k").join(label, "k", "left").select("f1", "f2", "n", F.coalesce("c", "k").alias("c"))
    return seen.drop("sig").join(home, ["f1", "f2", "n"], "left"), label


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns, less those whose component
    holds an earlier document: one document of each group stays. Rows that repeat
    doc_id and text are one document; one of them stays."""
    rows, _ = _labelled(docs)
    keys = F.struct("d", "t").alias("k")
    gone = rows.where(F.col("c").isNotNull() & (F.col("c") != F.struct("d", "t"))).select(keys).distinct()
    again = rows.groupBy(keys).agg(F.count("*").alias("rows")).where("rows > 1").select("k")
    keyed = docs.select(F.struct(id_key().cast("bigint").alias("d"), text_key().alias("t")).alias("k"), F.struct("*").alias("row"))
    left = keyed.join(gone, "k", "left_anti")
    if not again.isEmpty():
        left = left.join(again, "k", "left_anti").union(left.join(again, "k", "left_semi").dropDuplicates(["k"]))
    return left.select("row.*")
