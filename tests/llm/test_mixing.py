import hashlib
import re

from colkit.llm.mixing import mix
from colkit.llm import mixing


def brute(rows, budget_share=1.5, repeats=2):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    budget, target, open_ = budget_share * sum(total.values()), {}, set(names)
    while True:  # reshare until no target is above its bound
        left = budget - sum(target.values())
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * weight[s] > repeats * total[s]}
        if not full:
            return size, total, target | {s: level * weight[s] for s in open_}
        target |= {s: float(repeats * total[s]) for s in full}
        open_ -= full


def corpus():
    rows = [(i, "w " * (1 + i * 7919 % 40), f"s{i % 4}" if i % 10 else "hot") for i in range(600)]
    return rows + [(700, None, "s0"), (701, "", "s1"), (702, "a b", None), (None, "c d", "s2"), (703, "x " * 5000, "hot"), (704, "same same", "s3"), (704, "same same", "s3"), (705, None, "blank")]


def test_targets_and_taken_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 5)
    monkeypatch.setattr(mixing, "SPAN", 1)
    rows = corpus() + [(None, f"same id {k}" + " x" * (k % 7), "hot") for k in range(300)]
    size, total, target = brute(rows)
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, target double")
    got = mix(df.repartition(4)).collect()
    again = mix(df.repartition(2)).collect()
    key = lambda r: (str(r["doc_id"]), r["taken"])
    assert [(r["doc_id"], r["taken"]) for r in sorted(got, key=key)] == [(r["doc_id"], r["taken"]) for r in sorted(again, key=key)]
    assert len(got) == len(rows)
    taken = dict.fromkeys(target, 0)
    for r in got:
        assert r["source_size"] == total[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    largest = {s: max((size(t) for _, t, x in rows if x == s), default=0) for s in target}
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] + 1, s
    assert sum(taken.values()) <= 1.5 * sum(total.values()) + 2


def test_order_is_that_of_the_hash(spark):
    rows = [(i, "w", "s") for i in range(20)] + [(100 + i, "w", "t") for i in range(20)]
    got = {r["doc_id"]: r for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    turns = sorted(range(20), key=lambda i: hashlib.md5(f"{i}mix".encode()).hexdigest())
    assert [r.doc_id for r in sorted((got[i] for i in range(20)), key=lambda r: r["finish"])] == turns


def test_given_weights_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (2, "d e f", "y")], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("x", 1)], "source string, weight int")
    got = {r["doc_id"]: r["taken"] for r in mix(df, weights, budget_share=0.5).collect()}
    assert got == {1: 3, 2: 0}
    assert mix(df.where("doc_id > 5")).count() == 0
    blank = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mix(blank).collect()] == [0]
