import random
import zlib
from collections import Counter

import numpy as np

from flowsentry.llm import common, packing, words


def test_place_has_least_sum_of_squares():
    rng = random.Random(4)
    for _ in range(300):
        w = packing.Windows(16, 0)
        for g in range(1, 16):
            w.counts[g] = rng.choice([0, 0, 1, 2, 5])
        size = rng.randint(1, 16)

        def cost(g):
            n = Counter({i: int(c) for i, c in enumerate(w.counts)})
            n[g] -= g > 0
            n[g + size] += g + size < 16
            return sum(c * c for i, c in n.items() if 0 < i < 16)

        allowed = [g for g in range(0, 17 - size) if g == 0 or w.counts[g]]
        best = min(allowed, key=lambda g: (cost(g), -g))
        assert w.level_for(size) == best


def check(rows, docs, window):
    tokenizer = words.load(words.default_path())
    want = Counter()
    by_sequence = {}
    pieces = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in docs:
        want[doc_id] += 1
    for doc_id, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        mine = pieces[doc_id]
        cover = Counter()
        for r in mine:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
            cover.update(range(r["start"], r["start"] + r["length"]))
        assert cover == Counter({i: want[doc_id] for i in range(len(ids))})
    padding = 0
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_every_id_once_and_no_padding(spark):
    common.prepare(spark)
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["alpha", "be", "c", "Été", "x9!"], k=rng.randint(0, 90)))) for i in range(200)]
    docs += [(1000, None), (1001, ""), (1002, "long text " * 3000), (1003, "twice"), (1003, "twice"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, start long, offset string")
    for parts in (1, 5):
        rows = packing.pack(df.repartition(parts), window=64).collect()
        assert check(rows, docs, 64) == 0
    assert packing.pack(df.limit(0)).collect() == []


def test_open_windows_are_bounded():
    w = packing.Windows(16, 0, most_open=5)
    out = []
    for i in range(200):
        ids = bytes(4 * 9)
        out += w.add((i, ids, 0, 9), 9)
        assert w.n_open <= 6
    out += w.empty(last=True)
    assert sum(r[2] for r in out) == 200 * 9
    fill = Counter()
    for r in out:
        fill[r[5]] += r[2]
    assert all(n == 16 or n & (n - 1) == 0 for n in fill.values())


def test_word_ids_equal_the_library():
    encoder, tokenizer = words.WordIds(words.default_path(), limit=50), words.load(words.default_path())
    rng = random.Random(6)
    alphabet = list("abcxyzABÀÉßöÿ'×0189!-_<|> \t\n \x1c\x85́Σİ中\U0001f600") + ["'s", "<|endoftext|>", "ll"]
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 80)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(ids, "<u4").tobytes()
