"""The five pipeline stages on planted rows, each against plain Python."""

import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import PATH, repeats
from tieout.llm import bpe, toxicity
from tieout.llm.stash import held_out

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, d string, row string, kept string, spans string"
WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "lan mer nis por rut sev tol wex yon zar".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def planted():
    rng = random.Random(12)
    item = prose(rng, 30)
    shared = prose(rng, 45)
    rows = [(i, prose(rng, rng.randrange(60, 120)) + ".") for i in range(200)]
    for i in range(0, 60, 2):
        rows[i] = (i, rows[i][1] + " you vile rotten filth.")
    rows += [(300, rows[101][1]), (301, rows[103][1] + " one more word"), (302, prose(rng, 30) + " " + item + " " + prose(rng, 30))]
    rows += [(310 + i, prose(rng, 40) + " " + shared + " " + prose(rng, 40)) for i in range(5)]
    rows += [(400, None), (401, ""), (402, "  \n "), (403, "short text"), (None, prose(rng, 70)), (404, prose(rng, 4000))]
    return rows, item


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages_against_plain_python(spark, tmp_path):
    rows, item = planted()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "d", "r", "k", "s") for d, t in rows], COLUMNS)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60 and i % 2 == 0)) for i in range(150)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, found = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        found.append({r.doc_id: r for r in now.collect()})
        if name != "byte_bpe":
            assert now.columns == docs.columns
            assert all(r.n_chars == len(r.text or "") for r in found[-1].values())
    order = lambda d: -(2**63) if d is None else d

    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), usable=~held_out())
    clean = {r.doc_id: r.score < 0.7 for r in toxicity.score(docs, model).collect()}
    assert set(found[0]) == {d for d, ok in clean.items() if ok} and not set(found[0]) & set(range(0, 60, 2))
    assert {d for d, _ in rows if d is None or d >= 60} <= set(found[0])

    kept = []
    sets = {d: shingles(r.text) for d, r in found[0].items()}
    for d in sorted(sets, key=order):  # no chains among these rows
        if not any(100 * len(sets[d] & sets[k]) >= 75 * len(sets[d] | sets[k]) for k in kept if sets[d] and sets[k]):
            kept.append(d)
    assert set(found[1]) == set(kept) and not {300, 301} & set(kept)

    before = sorted(((d, r.text) for d, r in found[1].items()), key=lambda r: order(r[0]))
    marks = repeats(before)
    for d, text in before:
        assert found[2][d].text == "".join(c for c, keep in zip(text or "", marks[d, text]) if keep)  # plain letters: a byte each
    assert len(found[2][314].text) < len(dict(rows)[314]) - 200

    assert set(found[3]) == {d for d, r in found[2].items() if item not in r.text} and 302 not in found[3]
    assert all(found[3][d].text == found[2][d].text for d in found[3])

    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})
    assert {d: r.n_tokens for d, r in found[4].items()} == {d: len(library.encode_ordinary(r.text or "")) for d, r in found[3].items()}


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], COLUMNS)
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).where(F.lit(True)).count() == 0
