import random
from itertools import product

import numpy as np

from colkit.llm import quality
from colkit.llm.quality import MAX_DOCS, fit_crf, forward_backward, learn, line_features, marginals, score


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(5):
        lines = rng.integers(1, 6, size=4)
        s, trans = rng.normal(size=lines.sum()), rng.normal(size=(2, 2))
        good, pairs, logz = forward_backward(s, lines, trans)
        at, want_pairs = 0, np.zeros((2, 2))
        for k, n in enumerate(lines):
            total, marginal, mine = 0.0, np.zeros(n), np.zeros((2, 2))
            for y in product((0, 1), repeat=int(n)):
                w = np.exp(sum(s[at + t] * y[t] for t in range(n)) + sum(trans[y[t - 1], y[t]] for t in range(1, n)))
                total += w
                marginal += w * np.array(y)
                for t in range(1, n):
                    mine[y[t - 1], y[t]] += w
            assert np.allclose(good[at : at + n], marginal / total) and np.isclose(logz[k], np.log(total))
            want_pairs += mine / total
            at += n
        assert np.allclose(pairs, want_pairs)


def corpus(n=300):
    rnd = random.Random(9)
    rows = []
    for i in range(n):
        good = i % 4 != 0
        lines = []
        for _ in range(rnd.randint(1, 12)):
            words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(rnd.randint(4, 14))]
            lines.append(" ".join(words).capitalize() + "." if good else rnd.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words), (words[0] + " ") * 20]))
        rows.append((i, "\n".join(lines), int(good)))
    return rows


def test_held_out_documents_and_edges(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 5] + [(None, 1), (1, None), (9999, 1)], "doc_id long, quality int")
    model = learn(df, labels)
    got = {r["doc_id"]: r for r in score(df, model).collect()}
    held = [(got[i]["predicted"], q) for i, _, q in rows if i % 5 == 0]
    assert np.mean([p == q for p, q in held]) >= 0.95
    again = learn(df.repartition(7), labels)
    assert np.allclose(again.weights, model.weights)
    odd = [(1, None), (2, ""), (None, "A fine line."), (3, "\n\n\n"), (4, "x" * 300_000), (5, "line of words.\n" * 20_000), (5, "line of words.\n" * 20_000)]
    out = score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    assert len(out) == len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (1, 2)}) == 1
    assert score(df.where("doc_id > 9999"), model).count() == 0


def test_no_labels_and_one_label(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    for labels in ([], [(1, 1)]):
        model = learn(df, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert len(score(df, model).collect()) == 1


def test_features_do_not_depend_on_the_batch():
    texts = ["One line.\nTwo | lines!", None, "", "third\n"]
    f, size, lines = line_features(texts)
    assert lines.tolist() == [2, 1, 1, 2] and size.tolist() == [9, 12, 0, 0, 5, 0]
    at = np.cumsum(lines)
    for k, t in enumerate(texts):
        assert np.allclose(line_features([t])[0], f[at[k] - lines[k] : at[k]])
    assert MAX_DOCS == 4000 and fit_crf(f, size, lines, np.array([1, 1, 1, 1])).slope == 0.0


def test_pieces_of_long_chains_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    for piece in (1, 3, 128):
        monkeypatch.setattr(quality, "PIECE", piece)
        lines = np.array([1, 7, 3, 300, 2, 129])
        s, trans = 3 * rng.normal(size=lines.sum()), rng.normal(size=(2, 2))
        assert np.allclose(marginals(s, lines, trans), forward_backward(s, lines, trans)[0])
    assert marginals(np.zeros(0), np.zeros(0, dtype=np.int64), trans).size == 0


def mixed_corpus(n=400):
    """Good documents have good lines, bad ones both kinds; (text, label, whether each line is good)."""
    rnd = random.Random(10)
    out = []
    for i in range(n):
        label, lines, kinds = int(i % 3 != 0), [], []
        for _ in range(rnd.randint(4, 12)):
            good = bool(label) or rnd.random() < 0.4
            words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(rnd.randint(5, 14))]
            lines.append(" ".join(words).capitalize() + "." if good else " | ".join(w.upper() + "#" for w in words))
            kinds.append(good)
        out.append(("\n".join(lines), label, kinds))
    return out


def test_lines_of_one_document_can_differ():
    rows = mixed_corpus()
    f, size, lines = line_features([t for t, _, _ in rows])
    model = fit_crf(f, size, lines, np.array([q for _, q, _ in rows]))
    good, at, right, n, varied = model.lines(f, lines), 0, 0, 0, 0
    for (_, label, kinds), m in zip(rows, lines.tolist(), strict=True):
        mine = good[at : at + m]
        at += m
        if label == 0 and len(set(kinds)) == 2:
            right, n, varied = right + int(((mine > 0.5) == kinds).sum()), n + m, varied + (np.ptp(mine) > 0.5)
    assert right / n > 0.9 and varied > 80
    predicted = 1 / (1 + np.exp(-(model.slope * model.quality(f, size, lines) + model.shift))) >= 0.3
    assert np.mean(predicted == [q for _, q, _ in rows]) > 0.9


def test_document_scores_equal_enumeration():
    rows = mixed_corpus(120)
    f, size, lines = line_features([t for t, _, _ in rows])
    model = fit_crf(f, size, lines, np.array([q for _, q, _ in rows]))
    for text in [rows[k][0] for k in range(0, 30, 3)] + ["", "one line", None]:
        f, size, lines = line_features([text])
        s = np.clip(model.observe(f, lines) @ model.weights, -30, 30)
        n, total, marginal = int(lines[0]), 0.0, np.zeros(int(lines[0]))
        for y in product((0, 1), repeat=n):
            w = np.exp(s @ np.array(y) + sum(model.trans[a, b] for a, b in zip(y, y[1:])))
            total, marginal = total + w, marginal + w * np.array(y)
        weight = size if size.sum() else np.ones(n)
        q = np.clip((marginal / total) @ weight / weight.sum(), 1e-9, 1 - 1e-9)
        want = 1 / (1 + np.exp(-(model.slope * np.log(q / (1 - q)) + model.shift)))
        assert np.isclose(model.score([text])[0], want)


def test_long_documents_teach_a_stretch_of_lines(spark):
    rows = [(i, "\n".join(f"A good line of words {k}." if i % 2 else f"| BAD {k} #### |" for k in range(1 + 90 * (i % 7)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = learn(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int"), max_lines=50)
    got = {r["doc_id"]: r["predicted"] for r in score(docs, model).collect()}
    assert np.mean([got[i] == i % 2 for i, _ in rows]) > 0.95
