import random
from collections import Counter

import numpy as np

from colkit.llm import lang_id
from colkit.llm.lang_id import Filter, fit, grams, keep_determined, pieces, predict

SYLLABLES = {"xx": "ka lo mi tu re sa".split(), "yy": "sch ein ung ver keit zu".split(), "zz": "ée eau oui ç ên tre".split()}


def corpus(n=240):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        rows.append((i, " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(40)), lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    df = spark.createDataFrame([(*r, "clash") for r in corpus()], "doc_id long, text string, lang string, score string").repartition(3)
    model = fit(df.where("doc_id % 4 <> 2"))
    got = predict(df.where("doc_id % 4 = 2"), model).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 60 and all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got)
    odd = [(1, None), (2, ""), (3, "12345 !? 67"), (None, "kalomi tureka"), (4, "KALO Mitu"), (4, "KALO Mitu"), (5, "kalo mi " * 150_000), (6, "一二三")]
    got = predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    assert len(got) == len(odd)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by[1] == by[2] == by[3] == ("und", 0.0)
    assert by[None][0] == by[4][0] == by[5][0] == "xx"
    assert by[6][0] in SYLLABLES
    kept = keep_determined(spark.createDataFrame([(i, t, 7) for i, t in odd], "doc_id long, text string, extra int"), model)
    assert kept.columns == ["doc_id", "text", "extra"] and sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "4", "5", "None"]


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "xx")], "doc_id long, text string, lang string")
    model = fit(df)
    assert {r["lang_pred"] for r in predict(df, model).collect()} == {"und"}
    assert predict(df.where("doc_id > 5"), model).count() == 0


def test_filter_against_sets():
    """Every n-gram's languages are found; what is found beyond them is as rare as its estimate says."""
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 64, size=5000, dtype=np.uint64)
    masks = rng.integers(1, 8, size=5000, dtype=np.uint64)
    model = Filter.build(["a", "b", "c"], hashes, masks)
    assert (model.holders(hashes) & masks == masks).all()
    other = model.holders(rng.integers(0, 1 << 64, size=200_000, dtype=np.uint64))
    for k in range(3):
        assert abs(((other >> np.uint64(k)) & np.uint64(1)).mean() - model.false_positive[k]) < 0.01


def test_grams_do_not_depend_on_neighbours():
    texts = ["héllo wörld", "", "a", "b c"]
    h, n = grams(texts)
    at = np.cumsum(n)
    for k, t in enumerate(texts):
        one, m = grams([t])
        assert m[0] == n[k] and one.tolist() == h[at[k] - n[k] : at[k]].tolist()
    assert [w for w, _, _ in pieces([None, "ABC"])] == [[0, 1]]


def test_more_languages_than_a_word_has_bits(spark):
    """Each of 130 languages has its own two letters."""
    rows = []
    for k in range(130):
        x, y = chr(0x4E00 + 2 * k), chr(0x4E01 + 2 * k)
        rows += [(3 * k + j, f"{x}{y} {y}{x} {x}{x}{y} " * (j + 4), f"l{k:03}") for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = fit(df)
    assert len(model.languages) == 130 and model.slots.shape[0] == 3
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(df, model).collect()}
    assert all(got[i][0] == lang and got[i][1] > 0.8 for i, _, lang in rows)
    assert keep_determined(df, model).count() == len(rows)


def test_bounds_of_the_fit_reject_nothing(spark):
    """Short documents alone in their language stay, and all do if nothing was learned."""
    rnd = random.Random(3)
    rows = corpus()
    for i in range(30):
        letters = rnd.sample("abcdefghijklmnopqrstuvwxyzäöüßéèñçåøæ", 20)
        rows.append((1000 + i, " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(3, 8))) for _ in range(20)), f"rare{i:02}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = fit(df)
    assert keep_determined(df, model).count() == len(rows)
    none = spark.createDataFrame([(1, "abc", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in keep_determined(none, fit(none)).collect()] == [1]
    # texts that no language knows still go
    odd = spark.createDataFrame([(1, "一二三 四五六", "xx")], "doc_id long, text string, lang string")
    assert keep_determined(odd, model).count() == 0


def plain_grams(text):
    """Each letter with its neighbours, None for what is not a letter."""
    c = [None, *(x if x.isalpha() else None for x in text.lower()), None]
    return [tuple(c[k - 1 : k + 2]) for k in range(1, len(c) - 1) if c[k]]


def test_predictions_equal_brute_force(spark):
    """Sets of n-grams instead of filters: the same language, and nearly the same coverage."""
    rnd = random.Random(11)
    rows = [(i, t if i % 5 else t + " " + " ".join(rnd.choice(SYLLABLES["zz"]) for _ in range(rnd.randint(1, 60))), lang) for i, t, lang in corpus()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    counts = {lang: Counter(g for _, t, x in rows if x == lang for g in plain_grams(t)) for lang in SYLLABLES}
    share, needed = {}, {}
    for lang, c in counts.items():
        total = sum(c.values())
        enough = [m for m in range(2, lang_id.MIN_COUNT + 1) if sum(n for n in c.values() if n >= m) / total >= lang_id.KNOWN_MASS]
        needed[lang] = max([1, *enough])
        share[lang] = {g: n / total for g, n in c.items() if n >= needed[lang]}
    top = Counter()
    for lang, f in share.items():
        for g, x in f.items():
            if counts[lang][g] >= lang_id.MIN_COUNT:
                top[g] = max(top[g], x)
    own = {lang: {g for g, x in f.items() if x >= lang_id.MIN_SHARE * top[g]} for lang, f in share.items()}
    got = {r["doc_id"]: r for r in predict(df, fit(df)).collect()}
    for i, t, _ in rows:
        g = plain_grams(t)
        cover = {lang: sum(x in own[lang] for x in g) / len(g) for lang in own}
        best = max(sorted(cover), key=lambda x: cover[x])
        second = sorted(cover.values())[-2]
        if cover[best] - second > 0.03:
            assert got[i]["lang_pred"] == best and abs(got[i]["coverage"] - cover[best]) < 0.03, i


def test_long_texts_have_the_ngrams_of_the_whole(monkeypatch):
    rnd = random.Random(12)
    text = "".join(rnd.choice("abc déß.\n") for _ in range(1_200_000))
    whole, n = grams([text])
    parts = list(pieces([text]))
    assert len(parts) > 2 and np.array_equal(np.concatenate([h for _, h, _ in parts]), whole) and sum(int(c.sum()) for _, _, c in parts) == n[0]
    for size in (1, 2, 7):
        monkeypatch.setattr(lang_id, "PIECE_CHARS", size)
        texts = ["ab", "", "x", "abc def", None, "éa1b"]
        found = list(pieces(texts))
        h, n = grams([t or "" for t in texts])
        assert np.array_equal(np.concatenate([x for _, x, _ in found]), h)
        assert [sum(int(c[k]) for w, _, c in found for k in range(len(w)) if w[k] == i) for i in range(len(texts))] == n.tolist()
