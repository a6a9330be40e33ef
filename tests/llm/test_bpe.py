import random

import numpy as np

from flowsentry.llm import bpe, common, words

NASTY = ["a", "b", "the", "'s", "'", '"', "ing", " ", "  ", "\n", "É", "é", "́", "中文", "\U0001f600", "<|endoftext|>", "12", "!!", "ss", "ſ", "ᄀ", "ᅡ", "ᆨ"]


def plain(text):
    return words.load(words.default_path()).encode(text or "", add_special_tokens=False).ids


def test_tree_equals_whole():
    encoder = words.word_ids(words.default_path())
    rng = random.Random(8)
    for k in range(250):
        pool = rng.sample(NASTY, rng.randint(1, len(NASTY)))
        text = "".join(rng.choices(pool, k=rng.randint(0, 400)))
        e = bpe.encode_tree(encoder, text, rng.choice([3, 17, 60]))
        assert np.frombuffer(e.ids, "<u4").tolist() == plain(text), repr(text)
        assert e.text == text
        cut = rng.randint(0, len(text))
        two = bpe.join(encoder.tokenizer, *(bpe.encode_whole(encoder.tokenizer, t) for t in (text[:cut], text[cut:])))
        assert two.ids.tolist() == plain(text)


def test_unsplit_text():
    encoder = words.word_ids(words.default_path())
    rng = random.Random(9)
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "!?", "thein"):
        text = "".join(rng.choices(letters, k=5000))
        assert np.frombuffer(bpe.encode_tree(encoder, text, 300).ids, "<u4").tolist() == plain(text)


def test_long_words_of_any_make(monkeypatch):
    """Short edges and small windows, so that words go on over many parts and the edges often do not suffice."""
    encoder = words.word_ids(words.default_path())
    rng = random.Random(12)
    monkeypatch.setattr(bpe, "LONG_WORD", 100)
    for k in range(60):
        monkeypatch.setattr(bpe, "EDGE_IDS", rng.choice([4, 30, 200]))
        pool = rng.choice(["ab", "abcdefghijklmnopqrstuvwxyz", "thein!?", "aé́中", "'s 12", "x", "<|endoftext|>"])
        text = "".join(rng.choices(pool, k=rng.randint(500, 4000)))
        for at in rng.sample(range(len(text)), rng.choice([0, 1, 5])):
            text = text[:at] + " " + text[at:]
        e = bpe.encode_tree(encoder, text, rng.choice([130, 400, 1000]))
        assert np.frombuffer(e.ids, "<u4").tolist() == plain(text), (k, pool)
        assert e.text == text


def test_joins_of_unsplit_text_encode_little_anew(monkeypatch):
    encoder = words.word_ids(words.default_path())
    rng = random.Random(13)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    parts = [bpe.encode_leaf(encoder, text[i : i + bpe.LEAF_CHARS]) for i in range(0, len(text), bpe.LEAF_CHARS)]
    again = []
    encode = bpe.encode_whole
    monkeypatch.setattr(bpe, "encode_whole", lambda tokenizer, t: again.append(len(t)) or encode(tokenizer, t))
    whole = bpe.join_all(encoder.tokenizer, parts)
    assert sum(again) < len(text) // 100
    assert np.frombuffer(whole.ids, "<u4").tolist() == plain(text)


def test_encode_and_decode_in_spark(spark):
    common.prepare(spark)
    rng = random.Random(10)
    docs = [(i, "".join(rng.choices(NASTY, k=rng.randint(0, 300)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "word " * 4000), (503, "x" * 9000), (504, "same " * 60), (504, "same " * 60), (None, "n" * 500)]
    df = spark.createDataFrame([(i, t, "k", b"i") for i, t in docs], "doc_id long, text string, key string, ids binary")
    tokenizer = words.load(words.default_path())
    want = sorted((str(i), np.array(plain(t), "<u4").tobytes(), tokenizer.decode(plain(t), skip_special_tokens=False)) for i, t in docs)
    got = bpe.decode(bpe.encode(df, leaf_chars=100)).collect()
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), r["decoded"]) for r in got) == want
    assert bpe.decode(bpe.encode(df.limit(0))).collect() == []
