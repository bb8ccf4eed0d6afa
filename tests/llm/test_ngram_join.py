import random
import re

import pytest

from colkit.llm import ngram_join
from colkit.llm.ngram_join import similar_components


def brute(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    label[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus():
    rnd = random.Random(3)
    vocab = [f"w{k}" for k in range(60)]
    rows, i = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "One  TWO"), (5, "Éa b c d"), (6, "éa b c d")], 7
    passage = [rnd.choice(vocab) for _ in range(60)]
    for _ in range(30):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([5, 8, 12, 30, 80, 200]))]
        if rnd.random() < 0.4:
            base[3:3] = passage
        for _ in range(rnd.randint(1, 12)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            if rnd.random() < 0.3:
                copy = copy + [rnd.choice(vocab) for _ in range(rnd.randint(1, 4))]
            rows.append((i, " ".join(copy)))
            i += 1
    return rows


@pytest.mark.parametrize("width,num,den,block", [(4, 85, 100, 1000), (5, 80, 100, 3)])
def test_components_equal_brute_force(spark, monkeypatch, width, num, den, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # small blocks: families fill several
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(df, width=width, threshold=(num, den), buckets=5).collect()}
    assert got == brute(rows, width, num, den)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, node string, bucket int")
    assert similar_components(df).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f", "x"), (4, "a b c d e f", "y"), (4, "a b c d e f", "y")], "doc_id long, text string, node string")
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in similar_components(df).collect()) == [(-1, 4), (4, 4), (4, 4)]


def test_sketches_fold_and_lose_no_similar_pair():
    import numpy as np

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in (3, 100, 1000, 5000)]
    sets += [np.unique(np.r_[s[: -len(s) // 20], rng.integers(0, 1 << 62, len(s) // 20, dtype=np.uint64)]) for s in sets]
    sizes = np.array([s.size for s in sets])
    rows = ngram_join.sketches_of(np.concatenate(sets), sizes)
    for i in range(8):
        for j in range(8):
            bits = 8 * min(len(rows[i]), len(rows[j]))
            x, y = ngram_join.folded([rows[i]], bits), ngram_join.folded([rows[j]], bits)
            assert np.bitwise_count(x ^ y).sum() <= np.setxor1d(sets[i], sets[j]).size


@pytest.mark.parametrize("local", [2, 1000])
def test_groups_that_fill_batches_equal_brute_force(spark, monkeypatch, local):
    """Groups of near copies in one batch, whose rows pass their bucket; digests that clash; many of them with one text."""
    monkeypatch.setattr(ngram_join, "LOCAL", local)
    real = ngram_join.set_ids
    monkeypatch.setattr(ngram_join, "set_ids", lambda flat, sizes, salt=0: real(flat, sizes, salt) if salt else real(flat, sizes) % 40)
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(80):
        copy = list(base)
        for _ in range(rnd.choice([0, 1, 2, 6, 12])):
            copy[rnd.randrange(120)] = f"x{rnd.randrange(500)}"
        rows.append((i, " ".join(copy if i % 4 else base[:70] + [f"y{rnd.randrange(900)}" for _ in range(40)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(df, buckets=3).collect()}
    assert got == brute(rows, 5, 80, 100)
