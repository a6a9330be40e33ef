import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from flowsentry.llm import align, common, mergepath, queries
from tests.llm.conftest import SF_SMALL

A, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
NASTY = ["a", "the ", " The", "'s", '"', "ing", " ", "  ", "\n\n", "\t", "É", "é", "é", "ß", "中文", "\U0001f600", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "12345", "!!", "\x00", "\x85", "\xa0", " ", "ŉ", "ǅ", "　", "ﬁ", "②", "ˈ", "\x1c"]


def test_merge_path():
    rng = np.random.default_rng(0)
    for _ in range(1500):
        n, m = rng.integers(0, 30, 2)
        a, b = (np.sort(rng.choice(60, size, replace=False)) for size in (n, m))
        work = int(rng.integers(1, 9))
        i, j = mergepath.borders(a, b, work)
        assert (i[0], j[0], i[-1], j[-1]) == (0, 0, n, m)
        for k in range(len(i)):
            before, after = [*a[: i[k]], *b[: j[k]]], [*a[i[k] :], *b[j[k] :]]
            assert not before or not after or max(before) < min(after)
        sizes = np.diff(i) + np.diff(j)
        assert not len(sizes) or sizes.max() <= work + 1
        x, y = mergepath.links(a, b, work)
        assert a[x].tolist() == b[y].tolist() == sorted({*a.tolist()} & {*b.tolist()})


@pytest.fixture(scope="module")
def plain():
    """Ids and token bytes straight from the two libraries, one text at a time."""
    tokenizer, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    ranks = (line.split() for line in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))
    a_bytes = {int(i): base64.b64decode(t) for t, i in ranks}

    def b_bytes(i):
        text = model.id_to_piece(i)
        return bytes.fromhex(text[3:5]) if model.is_byte(i) else text.replace("▁", " ").encode()

    def encode(text):
        a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        a, b = [(i, a_bytes[i]) for i in a], [(i, b_bytes(i)) for i in b]
        body = (" " + text).encode()
        return (a, b) if text and all(b"".join(t for _, t in s) == body for s in (a, b)) else ([], [])

    return encode


def brute(plain, docs):
    rows, links = [], []
    for doc_id, text in docs:
        a, b = plain(text or "")
        ends = [{}, {}]
        for side, tokens in enumerate((a, b)):
            at = 0
            for i, t in tokens:
                at += len(t)
                ends[side][at] = i
        common_ends = sorted(ends[0].keys() & ends[1].keys())
        groups, last = [], 0
        for end in common_ends:
            groups.append("|".join(",".join(str(i) for at, i in side.items() if last < at <= end) for side in ends))
            last = end
        links.append([(ends[0][e], ends[1][e]) for e in common_ends])
        text = ";".join(groups)
        rows.append((str(doc_id), len(a), len(b), len(groups), text))
    count = Counter(p for ps in links for p in ps)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted(
        (*row[:4], len(ps), sum(count[p] == most[p[1]] for p in ps), sum(count[p] for p in ps),
         hashlib.sha256(row[4].encode()).hexdigest() if ps else "")
        for row, ps in zip(rows, links)
    )


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def collected(df):
    return sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in df.collect())


def test_both_ways_of_encoding_agree():
    """The faster library on texts of the range it is used for, against the file's own."""
    side, tokenizer = align.side_a(A), Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    rng = random.Random(4)
    texts = ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0x20, 0x7F), 0x20])) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["".join(chr(c) for c in range(0x250))] + [a + chr(c) + b for c in range(0x250) for a, b in ((" ", " "), ("a", "a"), ("1", " "), ("'", "s"))]
    assert all(align._LATIN(t) for t in texts)
    assert side.encode(texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_alignment_in_spark(spark, monkeypatch, plain):
    monkeypatch.setattr(align, "LONG_BYTES", 300)
    monkeypatch.setattr(align, "WORK", 37)
    common.prepare(spark)
    rng = random.Random(12)
    docs = [(k, "".join(rng.choices(rng.sample(NASTY, rng.randint(1, len(NASTY))), k=rng.randint(0, 200)))) for k in range(150)]
    docs += [(k, " ".join(rng.choices(["the", "Tokens", "of", "straße", "unübersetzbar", "l'été", "2024,"], k=rng.randint(1, 300)))) for k in range(200, 260)]
    docs += [(500, None), (501, ""), (502, " "), (503, "x" * 9000), (504, "same text " * 60), (504, "same text " * 60), (None, "n" * 500), (None, "b"), (505, "b"), (505, "b")]
    df = spark.createDataFrame([(i, t, "k", b"i", 3) for i, t in docs], "doc_id long, text string, key string, links binary, piece int")
    want = brute(plain, docs)
    assert collected(align.link_statistics(df)) == want
    # Some are given back byte by byte, some not; some are cut into pieces.
    assert 0 < sum(r[1] == 0 for r in want) < len(want) / 2 and max(r[1] for r in want) > 500
    for r in align.align(df.where("doc_id = 504")).collect():
        groups = [g.split("|") for g in r["groups"].split(";")]
        assert [len(",".join(g[s] for g in groups).split(",")) for s in (0, 1)] == [r["n_a"], r["n_b"]]
    assert align.link_statistics(df.limit(0)).collect() == []


def test_query_equals_brute_force(spark, plain):
    docs = [(r["doc_id"], r["text"]) for r in common.table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    assert collected(queries.op13_token_alignment(spark, SF_SMALL)) == brute(plain, docs)
