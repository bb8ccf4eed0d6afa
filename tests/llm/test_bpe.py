import random

import numpy as np
import pytest

from colkit.llm.bpe import Encoder, Tables

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


def texts():
    rnd = random.Random(5)
    pools = ["abc", "aA1 .,\n\t'", "éèüñß ", "   　\x85\x1c\x0b", "你好世界안녕", "🙈👍🏽‍", "'s't're 'LL", "0123456789²½Ⅷ٣"]
    out = ["", " ", "a", "aaaaaaa", "a" * 3001, "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "don't we'll I'M", "  two   spaces  \n\n end  "]
    for _ in range(400):
        out.append("".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(1, 60))))
    return out


def test_same_ids_as_the_library():
    path = P.path("byte_bpe_50k.json")
    own, lib = Encoder(Tables(path)), tokenizers.Tokenizer.from_file(path)
    lib.no_truncation(), lib.no_padding()
    for text, ids in zip(texts(), own(texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_encode_and_decode_frames(spark):
    from pyspark.sql import functions as F

    from colkit.llm.bpe import decode, encode, ids_array

    path = P.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rows = [(1, "Hello <|endoftext|> wörld"), (None, "null id"), (2, None), (3, ""), (4, "x" * 200_000), (4, "repeated id"), (5, "é" * 5000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    got = decode(encode(df, path), path).select("doc_id", "ids", "text", ids_array(F.col("ids")).alias("array")).collect()
    assert len(got) == len(rows)
    want = {(i, tuple(lib.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in rows}
    assert {(r["doc_id"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist()), r["text"]) for r in got} == want
    assert all(r["array"] == np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in got)
    assert encode(df.where("doc_id > 99"), path).count() == 0
    once = encode(df, path, decoded=True).select("doc_id", "ids", "text", "n_tokens").collect()
    key = lambda r: (str(r["doc_id"]), bytes(r["ids"]), r["text"])
    assert sorted(map(key, once)) == sorted(map(key, got)) and all(r["n_tokens"] == len(r["ids"]) // 4 for r in once)


def test_bytes_that_are_not_text_are_replaced(spark):
    from colkit.llm.bpe import decode

    path = P.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    ids = lib.encode("🙈é", add_special_tokens=False).ids[:2]
    df = spark.createDataFrame([(1, np.array(ids, "<u4").tobytes()), (2, None)], "doc_id long, ids binary")
    assert {r["doc_id"]: r["text"] for r in decode(df, path).collect()} == {1: lib.decode(ids, skip_special_tokens=False), 2: ""}


def test_small_caches_change_nothing(monkeypatch):
    from colkit.llm import bpe

    path = P.path("byte_bpe_50k.json")
    whole = Encoder(Tables(path))(texts())
    monkeypatch.setattr(bpe, "CACHE_WORDS", 7)
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    assert Encoder(Tables(path))(texts()) == whole


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "etaoin", "ab", "éüa", "-="])
def test_long_words_take_a_bounded_number_of_rounds(letters):
    import time

    path = P.path("byte_bpe_50k.json")
    own, lib = Encoder(Tables(path)), tokenizers.Tokenizer.from_file(path)
    rnd = random.Random(6)
    word = "".join(rnd.choice(letters) for _ in range(200_000))
    began = time.perf_counter()
    ids = own([word])[0]
    assert time.perf_counter() - began < 2
    assert np.frombuffer(ids, "<u4").tolist() == lib.encode(word, add_special_tokens=False).ids


def test_windows_change_nothing():
    """Long words' rounds give what the rounds of short words give, runs of equal symbols and repeated pieces included."""
    from colkit.llm.bpe import encode_long, encode_words

    t, rnd = Tables(P.path("byte_bpe_50k.json")), random.Random(7)
    pieces = ["a", "aa", "the", "ing", "e", "x", "tion", "aaa", "-", "--", "=", "é", "zq"]
    for _ in range(150):
        word = "".join(rnd.choice(pieces[: rnd.randint(1, len(pieces))]) for _ in range(rnd.randint(1, 900))).encode()
        assert encode_long(word, t) == encode_words([word], t)[0]
