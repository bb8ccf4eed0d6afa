"""The pipeline against a plain version of its stages, on a small corpus."""

import hashlib
import random
import re

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from colkit.llm import common, mixing
from colkit.llm.common import new_path, numbered
from tests.llm.test_ngram_join import brute


def corpus():
    rnd = random.Random(12)
    syllables = {"xx": "ka lo mi tu re sa".split(), "yy": "sch ein ung ver keit zu".split()}
    rows = []
    for i in range(90):
        lang = "xx" if i % 3 else "yy"
        text = " ".join("".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(20, 120)))
        rows.append((i, text, lang, f"src{i % 4}"))
    for i in range(90, 110):  # copies, up to white space, and near copies
        base = rows[rnd.randrange(60)]
        words = base[1].split(" ")
        if i % 2:
            words[rnd.randrange(len(words))] = "kalo"
        rows.append((i, "  ".join(words), *base[2:]))
    return rows + [(200, None, None, "src0"), (201, "12 34", "xx", None), (202, "", "yy", "src1"), (None, rows[5][1], "xx", "src2"), (203, rows[7][1], "yy", None)]


def test_stages_do_what_they_say(spark):
    rows = corpus()
    sf_dir = new_path(spark, "pipeline-test")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf_dir}/documents.parquet")
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := new_path(spark, "stage"))
        docs = spark.read.parquet(path)
        at.append(docs)
    lang, exact, near, mixed, tokens = at
    for df in at[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [[r["doc_id"] for r in df.collect()] for df in at]
    assert set(ids[0]) == {r[0] for r in rows} - {200, 201, 202}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    first: dict = {}
    for i, t, *_ in sorted((r for r in rows if r[0] in set(ids[0])), key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(norm(t), i)
    assert sorted(ids[1], key=str) == sorted(first.values(), key=str)
    known = {i: t for t, i in first.items()}
    parts = brute([(i, t) for i, t in known.items()], 5, 80, 100)
    assert sorted(ids[2]) == sorted(i for i, (_, c) in parts.items() if i == c)
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].count(i) for i in ids[3]) <= 2
    assert sorted(ids[4]) == sorted(ids[3])
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    for r in tokens.collect():
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == 4 * r["n_tokens"]
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in whole) == sorted((r["doc_id"], r["n_tokens"]) for r in tokens.collect())


def test_rows_without_an_id_and_with_a_shared_one(spark):
    """Decisions of the near-duplicate and mix stages hold for one row, not for all that share its id."""
    rnd = random.Random(4)
    prose = lambda: " ".join("".join(rnd.choice("kalomitures") for _ in range(rnd.randint(2, 8))) for _ in range(80))
    alone, base, other, shared, third = prose(), prose(), prose(), prose(), prose()
    rows = [(None, alone), (None, base), (None, base + " tail"), (7, other), (None, other + " tail"), (8, shared), (8, third), (9, shared + " tail"), (6, third + " tail")]
    docs = spark.createDataFrame([(*r, "xx", f"src{k % 2}") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(3)
    docs = spark.read.parquet(_stored(spark, docs))
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, docs, "").collect()]
    sure = [(None, alone), (7, other), (8, shared), (6, third + " tail")]
    assert len(got) == 5 and set(sure) < set(got) and len({(None, base), (None, base + " tail")} & set(got)) == 1

    many = [(None, prose() if k % 3 else "short text " + str(k), "xx", f"src{k % 3}") for k in range(60)]
    docs = spark.read.parquet(_stored(spark, spark.createDataFrame(many, "doc_id long, text string, lang string, source string").repartition(3)))
    table = numbered(docs, "mix-test")
    text = {r["__row"]: r["text"] for r in table.collect()}
    taken = {text[r["__row"]]: r["taken"] // r["size"] for r in mixing.mix(table, also=("__row",)).collect()}
    assert len(set(taken.values())) > 1
    got = [r["text"] for r in corpus_pipeline.mixed(spark, docs, "").collect()]
    assert {t: got.count(t) for _, t, *_ in many} == taken


@pytest.mark.parametrize("most", [8192, 2])
def test_picked_rows(spark, monkeypatch, most):
    """Rows by number, once for each copy, in one go and slice by slice."""
    monkeypatch.setattr(common, "MOST_BITMAPS", most)
    table = numbered(spark.range(100, numPartitions=7).selectExpr("id", "'x' as __block"), "picked-test")
    rows = {r["id"]: r["__row"] for r in table.collect()}
    want = sorted([i for i in range(100) if i % 3] + [i for i in range(100) if i % 5 == 1])
    picks = spark.createDataFrame([(rows[i], 0) for i in range(100) if i % 3] + [(rows[i], 1) for i in range(100) if i % 5 == 1], "__row long, __copy int")
    got = common.picked(table, picks)
    assert got.columns == ["id", "__block"] and sorted(r["id"] for r in got.collect()) == want
    assert common.picked(table, picks.where("__row < 0")).count() == 0


def test_stages_on_empty_tables_and_repeated_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.read.schema(kind).parquet(_stored(spark, spark.createDataFrame([], kind)))
    twice = [(1, "same words here", "xx", "a", 1)] * 3 + [(2, None, None, None, None)] * 2 + [(None, "", "xx", "a", 0)]
    some = spark.read.schema(kind).parquet(_stored(spark, spark.createDataFrame(twice, kind)))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name
    assert sorted((r["doc_id"] for r in corpus_pipeline.exact(spark, some, "").collect()), key=str) == [1, 2]
    assert corpus_pipeline.near(spark, some, "").where("doc_id = 1").count() == 1
    assert corpus_pipeline.mixed(spark, some, "").where("doc_id <> 1 or doc_id is null").count() == 0


def _stored(spark, df):
    df.write.parquet(path := new_path(spark, "pipeline-rows"))
    return path
