import random

import numpy as np
import xxhash

from flowsentry.llm import common, simhash
from flowsentry.llm.components import components


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    ws = [w for w in lowered.split(" ") if w]
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, distance, least=min):
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i] ^ items[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


def clusters(rng, n):
    out = []
    while len(out) < n:
        code = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 40])):
            for _ in range(rng.randint(0, 4)):
                code ^= 1 << rng.randrange(64)
            out.append(code)
    return out[:n]


def test_tree_search_equals_brute_force():
    rng = random.Random(1)
    code = np.array(clusters(rng, 700), np.uint64)
    group = np.sort(np.array([rng.randrange(5) for _ in code]))
    tree = simhash.GrayTree(group, code)
    q, o = tree.neighbours(0, len(code), 4)
    near = np.bitwise_count(tree.code[:, None] ^ tree.code[None, :]) <= 4
    near &= tree.group[:, None] == tree.group[None, :]
    assert sorted(zip(q.tolist(), o.tolist())) == list(zip(*(x.tolist() for x in np.nonzero(near))))


def test_links_connect_all_that_are_near(spark):
    common.prepare(spark)
    rng = random.Random(2)
    codes = sorted(set(clusters(rng, 900)) | {0, (1 << 64) - 1} | {(1 << b) - 1 for b in range(0, 64, 3)})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    want = brute_components(codes, 4)
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    for rows in (4096, 8):
        got = {r["node"]: r["root"] for r in components(simhash.links(df, 4, group_rows=rows)).collect()}
        label = [got.get(c, c) for c in signed]
        pairs = set(zip(want, label))
        assert len(pairs) == len(set(want)) == len(set(label))


def test_documents(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=120)) for _ in range(20)]
    texts = base + [b + " tail" for b in base[:5]] + base[:3] + [None, "", " \n", "One Two", "one\ttwo", "É x", "a b c d", "a b c d e"]
    texts += ["word " * 40_000]
    docs = [(10 + i, t) for i, t in enumerate(texts)] + [(10, texts[0]), (None, texts[1])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, fp long, component_id int")
    got = simhash.near_duplicates(df).collect()
    fps = [brute_fingerprint(t) for _, t in docs]
    label = brute_components(fps, 4)
    least = {}
    for (i, _), g in zip(docs, label):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted((str(i), fp, least.get(g)) for (i, _), fp, g in zip(docs, fps, label))
    assert sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (5, 5)], "src long, dst long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)}
