"""Alignment of the tokens of two tokenizers, A and B, over the same bytes.

Texts of usual length are encoded, merged and grouped where they are read, a batch at a time: the ends of all texts of
a batch are one pair of ascending arrays, cut into pieces of equal work. The pieces of a long text are dealt out over
all tasks, which emit the ends that both sides share, and put together again in order.

Two tokens that end at the same byte have bytes of which one is the end of the other. So the pairs that can ever be
linked follow from the vocabularies alone (:class:`Pairs`), and counts by pair are an array of known size on any corpus.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import common, mergepath, words
from flowsentry.session import materialize

#: Texts of more bytes are merged in pieces by several tasks.
LONG_BYTES = 1 << 16
#: Ends of a piece.
WORK = 1 << 15


class Side(NamedTuple):
    """A vocabulary: bytes and their number by id, and how to encode texts, without special tokens."""

    encode: object
    bytes_of: list[bytes]
    sizes: np.ndarray


#: Letters and signs up to Latin Extended-B: both libraries split these alike, whatever their Unicode version.
_LATIN = re.compile("[\x00-ɏ]*").fullmatch


@lru_cache(maxsize=4)
def side_a(path: str) -> Side:
    """A byte-level BPE file of the tokenizers library; special tokens in texts are plain text.

    Latin texts go through the same vocabulary in tiktoken, which is several times as fast; others through the library.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["id"] for t in file["added_tokens"]}
    symbol = words.byte_symbols()
    bytes_of = [b""] * tokenizer.get_vocab_size()
    for token, i in file["model"]["vocab"].items():
        bytes_of[i] = token.encode() if i in special else bytes(symbol[c] for c in token)
    ranks = {b: i for i, b in enumerate(bytes_of) if i not in special}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in file["model"]["merges"]]
    in_order = [file["model"]["vocab"][m] for m in merges] == list(range(256, 256 + len(merges)))
    latin = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(texts: list[str]) -> list[list[int]]:
        if in_order:
            return [latin(t) if _LATIN(t) else tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return Side(encode, bytes_of, np.array([len(b) for b in bytes_of], np.int64))


@lru_cache(maxsize=4)
def side_b(path: str) -> Side:
    """A sentencepiece model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def piece(i: int) -> bytes:
        text = model.id_to_piece(i)
        return bytes([int(text[3:-1], 16)]) if model.is_byte(i) else text.replace("▁", " ").encode()

    bytes_of = [piece(i) for i in range(model.get_piece_size())]
    return Side(lambda texts: model.encode(texts, num_threads=1), bytes_of, np.array([len(b) for b in bytes_of], np.int64))


class Pairs:
    """All pairs (a, b) of ids of which one's bytes are the end of the other's, numbered in ascending order."""

    def __init__(self, a: Side, b: Side):
        self.width = len(b.bytes_of)
        keys = set()
        for one, other, key in ((a, b, lambda i, j: i * self.width + j), (b, a, lambda i, j: j * self.width + i)):
            named: dict[bytes, list[int]] = {}
            for j, text in enumerate(other.bytes_of):
                named.setdefault(text, []).append(j)
            for i, text in enumerate(one.bytes_of):
                for at in range(len(text)):
                    keys.update(key(i, j) for j in named.get(text[at:], ()))
        self.keys = np.array(sorted(keys), np.int64)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.width + b
        at = np.searchsorted(self.keys, key)
        assert not len(at) or (self.keys[np.minimum(at, len(self.keys) - 1)] == key).all()
        return at.astype("<u4")

    def b_ids(self) -> np.ndarray:
        return self.keys % self.width


@lru_cache(maxsize=2)
def pairs(a_path: str, b_path: str) -> Pairs:
    return Pairs(side_a(a_path), side_b(b_path))


class Names:
    """Ids as text, each with what follows it: a comma, or the sign behind the last id of a side."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = len(a.bytes_of), len(b.bytes_of)
        texts = [f"{i}{s}" for n, s in ((self.a, ","), (self.a, "|"), (self.b, ","), (self.b, ";")) for i in range(n)]
        self.texts = np.array(texts, object)

    def in_order(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Numbers of the texts of all groups, one after the other; (i, j) are the links, the last one at the end."""
        first_j = np.concatenate([[0], j[:-1] + 1])
        flat = np.empty(len(a) + len(b), np.int64)
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[i], end_b[j] = 1, 1
        flat[np.arange(len(a)) + np.repeat(first_j, np.diff(i, prepend=-1))] = a + self.a * end_a
        flat[np.arange(len(b)) + np.repeat(i + 1, np.diff(j, prepend=-1))] = b + 2 * self.a + self.b * end_b
        return flat


@lru_cache(maxsize=2)
def names(a_path: str, b_path: str) -> Names:
    return Names(side_a(a_path), side_b(b_path))


def encode(a: Side, b: Side, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
    """Ids on both sides; none for a text that is null or empty, or that a side does not give back byte by byte."""
    given = [t or "" for t in texts]
    out = []
    for text, x, y in zip(given, a.encode([" " + t for t in given]), b.encode(given)):
        body = b" " + text.encode()
        if not text or b"".join(map(a.bytes_of.__getitem__, x)) != body or b"".join(map(b.bytes_of.__getitem__, y)) != body:
            x, y = [], []
        out.append((x, y))
    return out


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, links binary"
PART = "key long, doc_id long, piece int, a binary, b binary, i binary, j binary"


def _grouped(name: Names, numbered: Pairs, doc_id, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple:
    """The row of one text from its ids and links."""
    if not len(a):
        return doc_id, 0, 0, 0, "", b""
    text = "".join(name.texts[name.in_order(a, b, i, j)].tolist())[:-1]
    return doc_id, len(a), len(b), len(i), text, numbered.number(a[i], b[j]).tobytes()


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, links) of every text with a space before it.

    groups is ``a1,a2|b1;a3|b2,b3``: ids between the places at which a token ends on both sides. links holds the number
    in :class:`Pairs` of each pair of tokens that end together, in order, as little-endian unsigned 32-bit integers.

    A text that is null, empty, or not given back byte by byte by a tokenizer has no tokens, no groups and no links.
    Repeated rows and rows without doc_id are rows like others; an empty table gives an empty one; other columns are
    ignored.
    """
    import public_tokenizers

    a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
    b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    long_bytes, work = LONG_BYTES, WORK

    def short(batches):
        a, b, name, numbered = side_a(a_path), side_b(b_path), names(a_path, b_path), pairs(a_path, b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                doc_ids, both = part["doc_id"].to_pylist(), encode(a, b, part["text"].to_pylist())
                # The texts of a part one after the other: each ends where both sides end.
                x, y = (np.fromiter((i for ids in side for i in ids), np.int64) for side in zip(*both))
                i, j = mergepath.links(np.cumsum(a.sizes[x]), np.cumsum(b.sizes[y]), work)
                if len(x):
                    texts, number = name.texts[name.in_order(x, y, i, j)].tolist(), numbered.number(x[i], y[j])
                p, q, n = 0, 0, 0
                for doc_id, (ids_a, ids_b) in zip(doc_ids, both):
                    if not ids_a:
                        yield doc_id, 0, 0, 0, "", b""
                        continue
                    m = int(np.searchsorted(i, p + len(ids_a)))
                    text = "".join(texts[p + q : p + q + len(ids_a) + len(ids_b)])[:-1]
                    yield doc_id, len(ids_a), len(ids_b), m - n, text, number[n:m].tobytes()
                    p, q, n = p + len(ids_a), q + len(ids_b), m

    def cut(batches):
        """Pieces: their ids, and in i and j the ends."""
        a, b = side_a(a_path), side_b(b_path)
        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ((x, y),) = encode(a, b, [text])
                x, y = np.array(x, "<u4"), np.array(y, "<u4")
                ends = np.cumsum(a.sizes[x]), np.cumsum(b.sizes[y])
                key += 1
                found = list(mergepath.pieces(*ends, work)) or [(0, 0, slice(0), slice(0))]
                for k, (_, _, p, q) in enumerate(found):
                    yield key, doc_id, k, x[p].tobytes(), y[q].tobytes(), ends[0][p].tobytes(), ends[1][q].tobytes()

    def merge(batches):
        """The same pieces, with the places of the shared ends in i and j."""
        for batch in batches:
            for r in batch.to_pylist():
                i, j = mergepath.shared(np.frombuffer(r["i"], "<i8"), np.frombuffer(r["j"], "<i8"))
                yield r["key"], r["doc_id"], r["piece"], r["a"], r["b"], i.tobytes(), j.tobytes()

    def stitch(batches):
        name, numbered = names(a_path, b_path), pairs(a_path, b_path)

        def whole(parts):
            a, b = (np.frombuffer(b"".join(r[c] for r in parts), "<u4").astype(np.int64) for c in "ab")
            i, j, p, q = [], [], 0, 0
            for r in parts:
                i.append(np.frombuffer(r["i"], "<i8") + p)
                j.append(np.frombuffer(r["j"], "<i8") + q)
                p, q = p + len(r["a"]) // 4, q + len(r["b"]) // 4
            return _grouped(name, numbered, parts[0]["doc_id"], a, b, np.concatenate(i), np.concatenate(j))

        parts = []
        for batch in batches:
            for r in batch.to_pylist():
                if parts and r["key"] != parts[0]["key"]:
                    yield whole(parts)
                    parts = []
                parts.append(r)
        if parts:
            yield whole(parts)

    found = common.map_rows(docs.where(size <= long_bytes), short, ALIGNED)
    long = common.map_rows(docs.where(size > long_bytes), cut, PART)
    merged = common.map_rows(long.repartition("key", "piece"), merge, PART)
    in_order = merged.repartition("key").sortWithinPartitions("key", "piece")
    return found.unionByName(common.map_rows(in_order, stitch, ALIGNED))


def pair_counts(aligned: DataFrame, size: int) -> np.ndarray:
    """Links of all texts by pair number.

    Each task sums into one array of ``size`` and the arrays are summed by pair, so nothing here grows with the corpus
    but the numbers; the result has one row for each possible pair at most.
    """

    def rows(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            np.add.at(total, np.frombuffer(b"".join(batch["links"].to_pylist()), "<u4"), 1)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["pair", "n"])

    sums = aligned.select("links").mapInArrow(rows, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(size, np.int64)
    count[sums["pair"].to_numpy()] = sums["n"].to_numpy()
    return count


def best_of(count: np.ndarray, b_ids: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its B id."""
    most = np.zeros(int(b_ids.max(initial=-1)) + 1, np.int64)
    np.maximum.at(most, b_ids, count)
    return count == most[b_ids]


def link_statistics(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every text, see :func:`align`.

    A pair's count is the number of links of all texts with it; n_best counts the links whose pair no other pair of the
    same B id exceeds, count_sum adds up the counts over the links. Without tokens all are 0 and the digest is empty.
    """
    import public_tokenizers

    a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
    b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
    digest = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    found = align(docs, a_path, b_path).select("doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "links")
    found = materialize(found, "aligned")
    numbered = pairs(a_path, b_path)
    count = pair_counts(found, len(numbered.keys))
    # One number for each pair the vocabularies allow, on any corpus.
    tables = docs.sparkSession.sparkContext.broadcast((count, best_of(count, numbered.b_ids())))

    def rows(batches):
        counts, best = tables.value
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"))
            for doc_id, n_a, n_b, n_groups, digest, links in zip(*columns):
                numbers = np.frombuffer(links, "<u4")
                yield doc_id, n_a, n_b, n_groups, len(numbers), int(best[numbers].sum()), int(counts[numbers].sum()), digest

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return common.map_rows(found, rows, schema)
