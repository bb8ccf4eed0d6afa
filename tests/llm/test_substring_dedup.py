import random
import re

import pytest

from colkit.llm.cdc import chunk_texts
from colkit.llm.substring_dedup import repeated_passages


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rnd.randint(1, 9))) for _ in range(n))


def test_chunks_cover_the_text_and_resist_shifts():
    rnd = random.Random(1)
    text = prose(rnd, 3000).encode()
    moved = b"inserted here " + text[:9000] + b"and there" + text[9000:]
    of, start, end, digest = chunk_texts([text, b"", moved, b"a" * 1000])
    for k, part in enumerate((text, b"", moved, b"a" * 1000)):
        mine = of == k
        assert b"".join(part[s:e] for s, e in zip(start[mine], end[mine], strict=True)) == part
    assert (end - start).max() <= 256
    a, b = set(digest[of == 0].tolist()), set(digest[of == 2].tolist())
    assert len(a & b) > 0.97 * len(a)
    # a text's chunks do not depend on its neighbours
    assert chunk_texts([moved])[3].tolist() == digest[of == 2].tolist()


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rnd = random.Random(2)
    rows, planted, clean = [], set(), set()
    passages = [prose(rnd, rnd.randint(60, 90)) for _ in range(10)]
    short = prose(rnd, 20)
    for i in range(200):
        text = prose(rnd, rnd.randint(30, 300))
        if i % 4 == 0:
            text += " " + passages[(i // 4) % 10] + " " + prose(rnd, 20)
            planted.add(i)
        else:
            clean.add(i)
            text += " " + short + " " + prose(rnd, 10) if i % 4 == 1 else ""
        rows.append((i, text))
    rows += [(None, passages[0]), (300, None), (301, ""), (302, "x" * 100_000)]
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = {r["doc_id"] for r in found}
    assert not got & clean
    assert planted <= got
    texts = dict(rows)
    for r in found:
        passage = texts[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]]
        assert passage in texts[r["first_doc_id"]].encode() and r["kept"] == (r["first_doc_id"] == r["doc_id"])


def test_empty_table(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string, digest int")).count() == 0


def brute(rows, n=50):
    """(document, first word) of all stretches of n words that another document has; a document is its id and text."""
    seen: dict = {}
    docs = sorted({r for r in rows if r[0] is not None and r[1]})
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d[1])
        for k in range(len(words) - n + 1):
            seen.setdefault(tuple(words[k : k + n]), set()).add((d, k))
    return {p for places in seen.values() if len({d for d, _ in places}) > 1 for p in places}


def places(rows, found, n=50):
    """The same of a result, by the words that start in its spans."""
    texts: dict = {}
    for i, t in rows:
        if i is not None and t:
            texts.setdefault(i, set()).add(t)
    out = set()
    for r in found:
        for t in texts[r["doc_id"]]:
            passage = t.encode()[r["start_byte"] : r["end_byte"]]
            words = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())]
            if r["start_byte"] in words and len(re.findall(rb"[^\x20\x09-\x0D]+", passage)) == r["n_words"]:
                at = words.index(r["start_byte"])
                out |= {((r["doc_id"], t), at + k) for k in range(r["n_words"] - n + 1)}
    return out


@pytest.mark.parametrize("letters", [(1, 9), (1, 3), (4, 12)])
def test_equal_to_brute_force(spark, letters):
    """Every stretch of 50 words that two documents share, and no other: passages of 45 to 80 words at any place, short words too."""
    rnd = random.Random(letters[1])
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(*letters)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in range(45, 81)]
    rows = []
    for i in range(220):
        parts = [text(rnd.randint(0, 120))]
        for _ in range(rnd.choice([0, 1, 1, 2])):
            parts += [rnd.choice(passages).replace(" ", rnd.choice([" ", " ", "\n"])), text(rnd.randint(1, 60))]
        rows.append((i, " ".join(parts)))
    rows += [(500, rows[3][1]), (501, "x " * 400), (502, "x " * 300), (503, "y " * 500), (504, "same  " + rows[9][1]), (504, "same " + rows[11][1]), (None, rows[5][1]), (505, ""), (506, None), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got, want = places(rows, repeated_passages(df).collect()), brute(rows)
    assert got <= want
    # a passage whose chunks all reach beyond it is the one way to miss it: of 50 to 60 words of one to three letters
    assert len(want - got) <= (0 if letters[1] > 3 else 0.02 * len(want))


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rnd = random.Random(5)
    passage = prose(rnd, 70)
    a, b, c = (prose(rnd, 40) + " " + passage + " " + prose(rnd, 30) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, prose(rnd, 200)), (2, prose(rnd, 50) + " " + passage[:200])]
    found = repeated_passages(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, doc string").repartition(4)).collect()
    assert sorted((r["doc_id"], r["n_words"] >= 70, r["kept"]) for r in found) == [(1, True, True), (1, True, True)]
    assert repeated_passages(spark.createDataFrame([(1, c), (1, c)], "doc_id long, text string")).count() == 0
