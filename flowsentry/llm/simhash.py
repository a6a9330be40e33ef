"""SimHash near-duplicates: word-shingle fingerprints linked within a bit distance by Gray-order trees."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import common
from flowsentry.llm.components import components
from flowsentry.session import materialize

SEED = 42
#: Shingles whose bits are counted at a time.
_SLICE = 1 << 15
#: Fingerprints of one band value that are searched together; larger groups are dealt out in pairs of parts.
GROUP_ROWS = 4096
FAN = 8


def fingerprint(text: str, width: int = 4) -> int:
    """64 bits, each 1 if set in over half of the shingle hashes; 0 without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only 20 and 09-0D split
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= width:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = [0, *ends[:-width].tolist()]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        some = np.array(hashes[at : at + _SLICE], "<u8")
        counts += np.unpackbits(some.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) with the 64 bits as a long."""

    def rows(batches):
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                fp = fingerprint(text or "", width)
                yield doc_id, fp - (1 << 64) if fp >> 63 else fp

    return common.map_rows(docs.select("doc_id", "text"), rows, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the Gray order: neighbours in this order share most bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayTree:
    """Codes sorted by group and Gray rank under nodes of ``FAN`` children.

    A node keeps the bits all codes below it share (mask and pattern) and the groups it spans. A search goes down with
    all queries at once; the bits in which a query differs from a node's pattern are a lower bound for everything
    below, and a node leaves the search, with its whole subtree, when they exceed the distance or the group is not there.
    """

    def __init__(self, group: np.ndarray, code: np.ndarray):
        order = np.lexsort((gray_rank(code), group))
        self.order, self.group, self.code = order, group[order], code[order]
        full = np.full(len(code), np.uint64(0xFFFFFFFFFFFFFFFF))
        self.levels = [(full, self.code, self.group, self.group)]
        while len(self.levels[-1][0]) > FAN:
            mask, pattern, low, high = self.levels[-1]
            heads = np.arange(0, len(mask), FAN)
            ones = np.bitwise_and.reduceat(pattern, heads)
            zeros = np.bitwise_and.reduceat(~pattern, heads)
            shared = np.bitwise_and.reduceat(mask, heads) & (ones | zeros)
            self.levels.append((shared, ones & shared, np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)))

    def neighbours(self, first: int, last: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, other) for the sorted codes first..last-1, by query; each code is among its own neighbours."""
        top = len(self.levels[-1][0])
        query = np.repeat(np.arange(first, last), top)
        node = np.tile(np.arange(top), last - first)
        for depth in range(len(self.levels) - 1, -1, -1):
            mask, pattern, low, high = self.levels[depth]
            group = self.group[query]
            near = (low[node] <= group) & (group <= high[node])
            query, node = query[near], node[near]
            near = np.bitwise_count((self.code[query] ^ pattern[node]) & mask[node]) <= distance
            query, node = query[near], node[near]
            if depth:
                below = len(self.levels[depth - 1][0])
                query = np.repeat(query, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = node < below
                query, node = query[inside], node[inside]
        return query, node

    def labels(self, distance: int, slice_rows: int = 512) -> np.ndarray:
        """For each sorted code, the first one it is connected with."""
        label = np.arange(len(self.code))
        links = [self.neighbours(a, min(a + slice_rows, len(label)), distance) for a in range(0, len(label), slice_rows)]
        query, other = (np.concatenate(x) for x in zip(*links))
        heads = np.searchsorted(query, label)
        while True:
            new = np.minimum(label, np.minimum.reduceat(label[other], heads))
            new = new[new]
            if (new == label).all():
                return label
            label = new


def _bands(distance: int) -> list[tuple[int, int]]:
    """(shift, bits) of distance + 1 bands: two codes within the distance agree in at least one of them."""
    n = distance + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(codes: DataFrame, distance: int = 4, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (src, dst) that connect all distinct codes ``fp`` within ``distance`` bits of each other.

    Codes are dealt out by the value of each band. Where one value holds more than ``group_rows`` codes, they are split
    into parts by hash and each pair of parts is searched by itself, so no task gets an unbounded group and no link is
    lost. A task links what it holds by Gray-order trees and returns spanning edges, not all pairs.
    """

    def band(shift: int, bits: int, i: int) -> Column:
        value = F.shiftrightunsigned("fp", shift).bitwiseAND((1 << bits) - 1)
        return F.shiftleft(value, 8) + i

    keyed = codes.select("fp", F.explode(F.array(*[band(s, b, i) for i, (s, b) in enumerate(_bands(distance))])).alias("band"))
    large = keyed.groupBy("band").count().where(F.col("count") > group_rows)
    parts = F.ceil(F.col("count") / group_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j)
    )
    dealt = keyed.join(large, "band", "left").select(
        "fp", "band", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("pair")
    )

    def rows(batches):
        held_key, held_code, n = [], [], 0

        def search(group, code):
            tree = GrayTree(group, code)
            label = tree.labels(distance)
            apart = np.flatnonzero(label != np.arange(len(label)))
            signed = tree.code.view(np.int64)
            yield from zip(signed[label[apart]].tolist(), signed[apart].tolist())

        for batch in batches:
            key = np.stack([batch["band"].to_numpy(), batch["pair"].to_numpy()], 1)
            held_key.append(key)
            held_code.append(batch["fp"].to_numpy().view(np.uint64))
            n += len(key)
            if n >= 2 * group_rows:
                key, code = np.concatenate(held_key), np.concatenate(held_code)
                group = np.r_[0, np.cumsum((key[1:] != key[:-1]).any(1))]
                done = np.searchsorted(group, group[-1])  # the last key may go on
                if done:
                    yield from search(group[:done], code[:done])
                held_key, held_code, n = [key[done:]], [code[done:]], len(key) - done
        if n:
            key, code = np.concatenate(held_key), np.concatenate(held_code)
            yield from search(np.r_[0, np.cumsum((key[1:] != key[:-1]).any(1))], code)

    ordered = dealt.repartition("band", "pair").sortWithinPartitions("band", "pair")
    return common.map_rows(ordered, rows, "src long, dst long").distinct()


#: Keys the nodes of one component are dealt out by when they are named.
SALTS = 16


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints link within ``distance`` bits, directly or over others.

    ``component_id`` is the smallest doc_id of the component. A text without words (null, empty) has fingerprint zero
    and links like any other. Equal fingerprints are one node, so copies cost nothing beyond their row. Repeated rows
    stay; a row without doc_id is linked but never names a component unless nothing else is in it (then null). An empty
    table gives no rows; other columns are ignored.
    """
    found = materialize(fingerprints(docs, width), "simhash")
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = materialize(links(nodes.select("fp"), distance), "simhash-links")
    member = components(edges)  # node, root
    rooted = nodes.join(member, nodes["fp"] == member["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    # One component may hold most nodes: they meet copies of its one row under SALTS keys. Single nodes meet none.
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt")
    several = smallest.where("nodes > 1").drop("nodes")
    copies = several.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    named = rooted.select("*", salt).join(copies, ["root", "salt"], "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id")
    )
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
