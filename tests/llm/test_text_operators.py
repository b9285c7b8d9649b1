"""The text operators against brute force on small tables with nulls, empty and
long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tieout.llm import bpe, chat, counts, decontaminate, licenses, lines, near, suffixes, topk, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, d string, t string, k string, row string, spans string, `spark` string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon é 中文 '\\ <s>".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    base, shared = prose(rng, 120), prose(rng, 40)
    rows: list[tuple[int | None, str | None]] = [(1, base), (2, base), (3, None), (4, ""), (5, "   \n\t "), (6, "one two"), (7, "One Two"), (None, base + " tail")]
    for i in range(10, 22):  # a group of near copies
        w = base.split(" ")
        w[rng.randrange(len(w))] = f"changed{i}"
        rows.append((i, " ".join(w)))
    for i in range(30, 42):  # a passage that many documents share
        rows.append((i, prose(rng, 30) + " " + shared + " " + prose(rng, rng.randint(0, 300))))
    rows += [(50, "a" * 700), (51, "b" * 99), (52, "b" * 100 + "é" * 120), (53, prose(rng, 3000)), (54, "x\x00y " * 60)]
    rows += [rows[0], rows[8], (60, "same id " + base), (60, "same id, other text")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "d", "t", "k", "r", "s", "x") for d, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ordered(rows):
    """Distinct documents in the operators' order; the text hash breaks ties of an id as Spark's does."""
    return sorted(set(rows), key=lambda r: -(2**63) if r[0] is None else r[0])


# -- 1


def test_chat_round_trip(spark, empty):
    rng = random.Random(1)
    tricky = [None, "", "<s>", "</s>[INST] ok [/INST]", "a\\<s>", "\\", "line\nbreak\\n", "é中😀", "[\\INST]", "x" * 5000]
    roles = ["user", "assistant", "system", None, "", "a\nb", "<s>", "tool\\"]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, None]), rng.choice(roles), rng.choice(tricky), "x") for _ in range(300)]
    rows += [(9, i, "assistant", "hot" + str(i), "x") for i in range(500)] + [rows[0]]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(turns.repartition(5))).collect()}
    low = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, v or "")
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (low(r[1]), text(r[2]), text(r[3])))
        body = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(mine), len(loss))
        assert r.turns_sha256 == hashlib.sha256(body.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_conversations(turns.limit(0))).count() == 0


def test_chat_escape_leaves_no_control_string():
    import pyarrow as pa

    texts = ["<s></s>[INST][/INST]\\", "<\\s>", "\\\\<s>"]
    for raw, safe in zip(texts, chat.escape(pa.array(texts)).to_pylist()):
        assert not any(c in safe for c in chat.CONTROL)
        assert chat.unescape(safe.encode()).decode() == raw


# -- 2


def repeats(rows):
    seen, out = set(), {}
    for d, text in rows:
        b = (text or "").encode()
        keep = bytearray(b"\1" * len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                keep[i : i + 100] = bytes(100)
            seen.add(w)
        out[d, text] = bytes(keep)
    return out


def test_suffixes_against_all_windows(docs, empty):
    rows = [r for r in corpus() if r[0] != 60]
    want = repeats(ordered(rows))
    got = suffixes.without_repeats(docs.where("doc_id is null or doc_id <> 60")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = (r.row.text or "").encode()
        keep = want[r.row.doc_id, r.row.text]
        assert r.kept == bytes(b for b, k in zip(text, keep) if k), r.row.doc_id
        assert [(s.start, s.stop) for s in r.spans] == [m.span() for m in re.finditer(b"\0+", keep)]
    assert suffixes.without_repeats(empty).count() == 0


def test_suffixes_split_groups_alike(docs, monkeypatch):
    plain = {(r.row.doc_id, r.row.text): r.kept for r in suffixes.without_repeats(docs).collect()}
    monkeypatch.setattr(suffixes, "GROUP", 3)
    monkeypatch.setattr(suffixes, "BATCH", 5)
    assert {(r.row.doc_id, r.row.text): r.kept for r in suffixes.without_repeats(docs).collect()} == plain


def test_suffixes_whole_characters(spark):
    twice = "é" * 80
    rows = frame(spark, [(1, twice), (2, "xyz" + twice + "中"), (3, twice)])
    for r in suffixes.without_repeats(rows, whole_characters=True).collect():
        r.kept.decode()  # valid


def test_smaller_neighbours():
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 200):
        x = rng.permutation(n)
        before, after = suffixes.smaller_neighbours(x)
        for i in range(n):
            assert before[i] == max((j for j in range(i) if x[j] < x[i]), default=-1)
            assert after[i] == min((j for j in range(i + 1, n) if x[j] < x[i]), default=n)


# -- 3


def plain_passages(texts, paragraphs, shortest):
    """Per distinct (doc_id, text) in order: number of units, removed character spans and the rest, in plain Python on characters."""
    end = r"\n[ \t\r\f\v]*\n+" if paragraphs else r"\n|[.!?][ \t\r\f\v\n]+"
    seen, out = set(), {}
    for d, text in texts:
        parts = [p for p in re.findall(rf"(?s).*?(?:{end})|.+\Z", text or "") if p]
        norm = [re.sub(r"[ \t\r\f\v\n]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in p)).strip(" ") for p in parts]
        late = []
        for n in norm:
            late.append(bool(n) and n in seen)
            if n:
                seen.add(n)
        spans, rest, at = [], "", 0
        for i, p in enumerate(parts):
            left, right = i, i
            while left and (late[left - 1] or not norm[left - 1]):
                left -= 1
            while right + 1 < len(parts) and (late[right + 1] or not norm[right + 1]):
                right += 1
            if late[i] and sum(len(norm[j].split(" ")) for j in range(left, right + 1) if norm[j]) >= shortest:
                spans.append((at, at + len(p)))
            else:
                rest += p
            at += len(p)
        out[d, text] = len(parts), spans, rest
    return out


@pytest.mark.parametrize("paragraphs,shortest", [(False, 25), (False, 1), (True, 25), (True, 3)])
def test_passages(spark, empty, paragraphs, shortest):
    rng = random.Random(8)
    pool = ["Same  line. ", "same line.\n", "\n", "  ", "other! ", "é?\t", "A stock line of seven words is here.\n", "long " * 300 + "\n\n", *(prose(rng, 9) + ". " for _ in range(6)), "\n \n"]
    texts = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(90, None), (91, ""), (None, "".join(pool)), (3, pool[6] * 9)]
    texts += [texts[5], texts[5], (92, "long text, all one sentence " * 40000 + "".join(pool[8:14]) * 60)]  # repeated rows; one very long text
    got = {(r.row.doc_id, r.row.text): r for r in lines.without_repeats(frame(spark, texts).repartition(3), paragraphs, shortest).collect()}
    assert lines.without_repeats(frame(spark, texts), paragraphs, shortest).count() == len(texts)
    hashes = {t: spark.range(1).select(F.hash(F.lit(t))).first()[0] for d, t in texts if d == 3}
    order = sorted(set(texts), key=lambda r: (-(2**63) if r[0] is None else r[0], hashes[r[1]] if r[0] == 3 else 0))
    want = plain_passages(order, paragraphs, shortest)
    assert set(got) == set(want)
    for key, (n, spans, rest) in want.items():
        assert got[key].n_units == n and [(s.start, s.stop) for s in got[key].removed] == spans and got[key].kept == rest
    assert any(spans for _, spans, _ in want.values())
    assert lines.without_repeats(empty).count() == 0


def test_passages_hot(spark):
    """A sentence that makes up nearly all repeats is spread over salts; the first copy of each stays."""
    texts = [(i, "Alpha beta gamma delta. " * 40 + f"own{i}.\n") for i in range(50)]
    got = {r.row.doc_id: r for r in lines.without_repeats(frame(spark, texts)).collect()}
    assert [len(got[i].removed) for i in range(50)] == [39] + [40] * 49
    assert got[0].kept == "Alpha beta gamma delta. own0.\n" and got[7].kept == "own7.\n"
    stock = [(i, f"own {i} text.\nAll rights reserved by the house.\nmore own {i}.") for i in range(30)]
    assert not any(r.removed for r in lines.without_repeats(frame(spark, stock)).collect())


# -- 4


def test_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 6).astype(np.float32)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(400, 440)] + [rows[0], (7, None), (8, [None] * 6), (9, [float("nan")] * 6), (11, [float("inf")] * 6), (None, [0.1] * 6), (12, []), (13, [1.0])]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, code int, score int")
    clean = {(i, tuple(int(np.floor(1024 * np.float64(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and v}
    want = []
    for q, a in clean:
        if q % 100 == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b)), c) for c, b in clean if c != q and len(a) == len(b)))[:10]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    got = [tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# -- 5


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_UPPER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs, empty):
    rows = corpus()
    sets = {r: shingle_set(r[1]) for r in set(rows)}
    root = {r: r for r in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    low = lambda r: -(2**63) if r[0] is None else r[0]
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)), key=low)
            root[y] = x
    got = near.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = sorted(((r[0], len(sets[r]), min((x for x in sets if find(x) == find(r)), key=low)[0]) for r in rows), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near.near_duplicates(empty).count() == 0


def test_near_recursion_gives_the_same(docs, monkeypatch):
    plain = sorted(map(str, near.near_duplicates(docs).collect()))
    for name, value in (("SMALL", 2), ("FEW", 0), ("DENSE", 4)):
        monkeypatch.setattr(near, name, value)
    assert sorted(map(str, near.near_duplicates(docs).collect())) == plain


def test_near_keeps_chained_members_open(spark):
    """Pivot 1, its neighbour 2, 5 at the far end of a chain (not compared with 1) and the stray 6, which may link to 5."""
    rows = [(1, 1, 2, 1, 1, 0.2), (1, 1, 5, 1, 1, None), (1, 1, 6, 1, None, 0.6), (2, 1, 5, 1, 1, None), (2, 1, 7, 1, None, None)]
    left = near._unsettled(spark.createDataFrame(rows, "node bigint, p int, k int, pc int, c int, far double"))
    assert sorted(tuple(r) for r in left.collect()) == [(1, 5, 1, False), (1, 6, 6, True), (2, 5, 1, False), (2, 7, 7, True)]


def test_keep_one_keeps_one_of_each_group(docs):
    left = near.keep_one(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert len(ids) == len(set(ids))
    assert not {1, 2, 7, *range(10, 22)} & set(ids)  # the null id comes first in its group; one text of id 60 is in it
    assert {None, 3, 4, 5, 6, 53, 60} <= set(ids)


# -- 6


def test_counts_after_edits(spark, docs, empty):
    rng = random.Random(6)
    encoder = bpe._encoder(PATH)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " ", "  ", "\n", "'", "ll", "s", "1", ".", "é", "word "]) for _ in range(rng.choice([0, 5, 200])))
        one = counts.CountedText(text, PATH)
        for _ in range(3):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.randint(0, 9))
            one.edit(a, b, "'s")
            text = text[:a] + "'s" + text[b:]
            assert (one.text, one.tokens) == (text, len(encoder.encode_ordinary(text)))
    edits = F.array(F.struct(F.lit(3).alias("start"), F.lit(5).alias("stop"), F.lit("zz").alias("new")))
    got = counts.count_edits(docs.select("doc_id", "text", edits.alias("edits")), PATH)
    assert got.count() == docs.count() and got.where("n_encoded > 12 and n_leaves > 100").count() == 0
    assert counts.count_edits(empty.select("doc_id", "text", edits.alias("edits")), PATH).count() == 0


# -- 7


def test_bpe_is_the_library(docs, empty):
    encoder = bpe._encoder(PATH)
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    want = sorted((str(d), np.array(encoder.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in corpus())
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert bpe.encode(empty, PATH).count() == 0


def test_pretokens_are_the_pattern():
    import pyarrow as pa
    import regex

    from tieout.llm import columnar

    rng = random.Random(2)
    alphabet = [*"aZé中9²٣ \t\n '.,_\x1c\x00😀́ 　", "'s", "'ll", "'re", "'ve", "'x", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    data, offsets = columnar.flat(pa.array(texts))
    start, owner = bpe.pretokens(data, offsets)
    raw, found = data.tobytes(), [[] for _ in texts]
    for a, b, i in zip(start[:-1], start[1:], owner):
        found[i].append(raw[a:b].decode())
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert found == [pattern.findall(t) for t in texts]


# -- 8


def test_toxicity_held_out(spark, empty):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.3
        s = [prose(rng, rng.randint(5, 20)) for _ in range(rng.randint(1, 8))]
        if bad:
            s[rng.randrange(len(s))] += " you utter " + rng.choice(["fool", "scoundrel", "rascal"])
        rows.append((i, ". ".join(s)))
        labels.append((i, 1, int(bad)))
    rows += [(700, None), (701, ""), (702, "...")]
    docs = frame(spark, rows)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, marks, usable=F.col("doc_id") < 400)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].score >= 0.7) == bool(y) for i, _, y in labels if i >= 400]
    assert np.mean(held) > 0.97
    assert all(got[i].score < 0.7 for i in (700, 701, 702))
    spot = next(r for r in got.values() if r.sentences)
    assert re.search("fool|scoundrel|rascal", spot.sentences[0].text)
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.score < 0.7}
    assert toxicity.score(empty, model).count() == 0
    blank = toxicity.train(empty, marks)
    assert toxicity.score(docs, blank).count() == len(rows)


# -- 9


def test_leaks(spark, empty):
    rng = random.Random(11)
    items = [(i, ". ".join(prose(rng, 12).capitalize() for _ in range(2)) + ".") for i in range(30)] + [(40, None), (41, ""), (42, "two words"), (None, "no id")]
    rows, want = [], set()
    for i in range(60):
        body = prose(rng, 80)
        if i < 15:  # as it stands, in capitals
            body += " " + items[i][1].upper() + " " + prose(rng, 40)
            want.add((i, i))
        elif i < 25:  # some words changed
            w = items[i][1].split(" ")
            for j in rng.sample(range(len(w)), 3):
                w[j] = "other"
            body = " ".join(w) + " " + body
            want.add((i, i))
        rows.append((i, body))
    rows += [(90, None), (91, "")]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    blocks = decontaminate.prepare(docs, bench)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, blocks).collect()} == want
    kept = {r.doc_id for r in decontaminate.without_leaks(docs, blocks).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.leaks(empty, decontaminate.prepare(empty, bench)).count() == 0
    assert decontaminate.leaks(docs, decontaminate.prepare(docs, bench.limit(0))).count() == 0


def test_leaks_in_many_documents(spark):
    rng = random.Random(12)
    hot = " ".join(f"hot{i}" for i in range(24)) + "."
    plain = " ".join(rng.sample([w for w in WORDS if w.isalpha()] * 2, 24))
    everyday = " ".join(w for w in WORDS)
    rows = [(i, everyday + " " + prose(rng, 60) + (" " + hot if i % 3 == 0 else "") + (" " + plain if i in (4, 9) else "") + " " + prose(rng, 30)) for i in range(90)]
    items = [(1, hot), (2, plain), (3, prose(rng, 20))]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    blocks = decontaminate.prepare(docs, bench)
    got = {(r.doc_id, r.item_id): r.share for r in decontaminate.leaks(docs, blocks).collect()}
    want = {(i, 1) for i in range(0, 90, 3)} | {(4, 2), (9, 2)}
    assert want <= got.keys() and all(got[k] == 1 for k in want) and not {(d, i) for d, i in got if i != 2} - want
    assert {r.doc_id for r in decontaminate.without_leaks(docs, blocks).collect()} == {d for d, _ in rows} - {d for d, _ in got}


def test_leaks_against_all_windows(spark):
    """Short items, items of common words beside rare ones, and edited copies."""
    rng = random.Random(13)
    common = [f"c{i}" for i in range(30)]
    rare = lambda n: [f"r{rng.randint(0, 10**9)}" for _ in range(n)]
    filler = lambda n: [x for _ in range(n) for x in (rng.choice(common), *rng.choice([[], rare(1)]))]
    items, rows = {}, {}
    for i in range(100):
        n = (1 + i % 7) if i < 42 else rng.randint(8, 90)
        words = rng.choices(common, k=n) if i % 4 == 3 and n > 4 else rare(n) if i % 2 else filler(n)[:n]
        items[i] = " ".join(words) if i % 3 else " ".join(words[: n // 2]) + ". " + " ".join(words[n // 2 :]) + "."
    benchmark_words = [w for t in items.values() for w in re.findall(r"\w+", t) if w[0] == "r"]
    for d in range(160):
        copy = items[d % 100].split(" ")
        if d % 100 >= 42:
            for _ in range(int(len(copy) * rng.choice([0, 0.1, 0.2, 0.24, 0.3, 0.45]))):
                j = rng.randrange(len(copy))
                copy[j : j + 1] = rng.choice([[], ["new"], [copy[j], "new"]])
        around = [w if rng.random() < 0.5 else rng.choice(benchmark_words) for w in filler(rng.randint(10, 90))]
        at = rng.randint(0, len(around))
        rows[d] = " ".join(around[:at] + copy + around[at:])
    docs = frame(spark, list(rows.items()))
    blocks = decontaminate.prepare(docs, spark.createDataFrame(list(items.items()), "item_id bigint, text string"))
    want: dict[tuple[int, int], float] = {}
    for block, (d, text) in itertools.product(blocks, rows.items()):
        words = decontaminate.words_of(pa.array([text]))[0]
        for start, p in itertools.product(range(0, max(1, len(words) - decontaminate.WINDOW + decontaminate.STEP), decontaminate.STEP), range(len(block.item))):
            share = block.confirmed(words, start, min(start + decontaminate.WINDOW, len(words)), p)
            if share > want.get((d, block.item[p]), 0):
                want[d, block.item[p]] = share
    assert {(i, i) for i in range(42)} <= want.keys() and sum(0 < s < 1 for s in want.values()) > 15
    assert {(r.doc_id, r.item_id): r.share for r in decontaminate.leaks(docs, blocks).collect()} == want


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in "ab")
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common_subsequence(a, b) == table[-1, -1]


# -- 10


def test_licences(spark, docs, empty):
    texts = {
        1: ("Released under the MIT License.", "", "mit", 1.0),
        2: ("Licensed UNDER the terms-of the Apache License, Version 2.0.", "", "apache-2.0", 1.0),
        3: ("under the GNU General Public License, version 3", "gpl", "gpl,gpl-3.0", 1.0),
        4: ("under the GNU General Public License, edition 3; cc-by", "cc-by,gpl", "cc-by,gpl", 0.5),
        5: ("Copyright (c) 2020 Some One. All rights reserved. all rights reserved", "reserved", "copyright,reserved", 1.0),
        6: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this thing to deal in it without restriction", "", "mit", 1.0),
        7: ("under the most MIT License", "", "", 0.0),
        8: (None, "", "", 0.0),
    }
    got = {r.doc_id: r for r in licenses.scan(frame(spark, [(d, t[0]) for d, t in texts.items()])).collect()}
    for d, (_, base, labels, score) in texts.items():
        assert (got[d].base_labels, got[d].labels, got[d].score) == (base, labels, score), d
    assert (got[5].n_base, got[5].first_word, got[5].last_word) == (2, 5, 8)
    assert got[8].first_word is None and got[8].n_words == 0
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


def test_template_markup():
    a = licenses.compile_template("x", "one <<beginOptional>> two <<beginOptional>> three <<endOptional>> <<endOptional>> <<var;n;2>> end")
    for words, fits in (("one end", 1), ("one two end", 1), ("one two three end", 1), ("one a b end", 1), ("one two three a b end", 1), ("one a b c end", 0), ("two end", 0), ("one", 0)):
        assert a.accepts(licenses.word_hashes(words)) == bool(fits), words
    with pytest.raises(ValueError):
        licenses.compile_template("x", "a <<beginOptional>> b")


# -- hashes


def thue_morse(n: int) -> tuple[str, str]:
    """Two words that polynomials modulo a power of two cannot tell apart."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_built_to_collide(spark):
    one, other = thue_morse(2048)
    rows = frame(spark, [(1, one), (2, other)])
    assert [(r.component_id, r.kept) for r in near.near_duplicates(rows).orderBy("doc_id").collect()] == [(1, True), (2, True)]
    import tiktoken

    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})
    for r in bpe.decode(bpe.encode(rows, PATH), PATH).collect():
        text = one if r.doc_id == 1 else other
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text) and r.decoded == text.encode()
    want = repeats([(1, one), (2, other)])
    for r in suffixes.without_repeats(rows).collect():
        assert r.kept == bytes(b for b, k in zip(r.row.text.encode(), want[r.row.doc_id, r.row.text]) if k)


def test_hash_is_the_polynomial_modulo_the_prime(monkeypatch):
    from tieout.llm import columnar as col

    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    start = rng.integers(0, 3000, 40)
    end = np.minimum(3000, start + rng.integers(0, 900, 40))
    for stretch in (1 << 22, 1000, 7):
        monkeypatch.setattr(col, "_STRETCH", stretch)
        base = col.draw_base()
        want = [sum((int(x) + 1) * pow(base, i, col.PRIME) for i, x in enumerate(data[a:b])) % col.PRIME for a, b in zip(start, end)]
        assert (col.Hasher(data, base)(start, end) == col.mix(np.array(want, np.uint64))).all()


def test_toxicity_scores_are_the_noisy_or_of_sentences(spark, docs):
    """Each sentence scored on its own by plain Python, with the model's weights."""
    rows = [(1000 + i, "this text is vile and foul. nothing here" if i % 2 else "a calm note. more calm words") for i in range(60)]
    labels = spark.createDataFrame([(1000 + i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    model = toxicity.train(frame(spark, [*rows, *rows[:7], (1001, "zzz another text of one id")]), labels)
    weight = dict(zip(model.features.tolist(), model.weights))
    assert weight
    for r in toxicity.score(docs.union(frame(spark, rows)), model).join(docs.union(frame(spark, rows)), "doc_id").select("doc_id", "text", "score").dropDuplicates().collect():
        if r.text in (None, "") or not re.search(r"[0-9A-Za-z\x80-\U0010ffff]", r.text) or [d for d, _ in corpus()].count(r.doc_id) > 1:
            continue
        clean = 1.0
        for part in re.split(r"[.!?\n]", r.text):
            s = toxicity.sentences(np.frombuffer(part.encode(), np.uint8), np.array([0, len(part.encode())]))
            if len(s.doc):
                clean *= 1 - 1 / (1 + np.exp(-model.bias - sum(weight.get(f, 0) for f in set(s.feature.tolist()))))
        assert abs(r.score - (1 - clean)) < 1e-6, r.doc_id


def test_toxicity_counts_by_pieces():
    rng = np.random.default_rng(3)
    feature, label = rng.integers(0, 50, 4000).astype(np.uint64), rng.integers(0, 2, 4000).astype(float)
    counts = toxicity.Counts()
    for part in np.array_split(np.arange(4000), 13):
        counts.add(feature[part], label[part])
        counts.waiting *= 2**20  # forces a merge
    names, n, ones = counts.table()
    assert names.tolist() == sorted(set(feature.tolist()))
    assert n.tolist() == [int((feature == f).sum()) for f in names] and ones.tolist() == [label[feature == f].sum() for f in names]


def test_toxicity_fit_keeps_to_its_bytes(spark, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    rows = frame(spark, [(i, ("vile " if i % 2 else "calm ") * 50) for i in range(40)])
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2000)
    assert 0 < len(toxicity.train(rows, labels).features)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 10)
    assert len(toxicity.train(rows, labels).features) == 0
