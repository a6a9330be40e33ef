"""BPE encoding by tree concatenation, and decoding, with a vocabulary file of the tokenizers library."""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import common, words

#: Texts of more code points are cut into leaves of this length, which are encoded apart from each other.
LEAF_CHARS = 32_768
#: A word of more code points is joined by its ids' spans, of which this many are kept at each end of a part.
LONG_WORD, EDGE_IDS = 2048, 1024
#: No special token of the vocabulary may be longer; windows reach at least twice as far.
LONGEST_SPECIAL = 16


class Encoded(NamedTuple):
    """A text with its ids and the code points each id covers."""

    text: str
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray


def encode_whole(tokenizer, text: str) -> Encoded:
    e = tokenizer.encode(text, add_special_tokens=False)
    spans = np.array(e.offsets, np.int64).reshape(-1, 2)
    return Encoded(text, np.array(e.ids, np.uint32), spans[:, 0], spans[:, 1])


def _free(c: str) -> bool:
    """True for a character that never joins the one before it under NFC."""
    return ord(c) < 0x300 or (unicodedata.category(c)[0] != "M" and not 0x1100 <= ord(c) <= 0x11FF)


def _borders(e: Encoded, base: int = 0) -> np.ndarray:
    """Ids that start where the one before them has ended, at a character that stands for itself."""
    clean = np.ones(len(e.ids), bool)
    clean[1:] = e.end[:-1] <= e.start[1:]
    at = np.flatnonzero(clean)
    return at[[_free(e.text[s - base]) for s in e.start[at]]] if len(at) else at


class Joined(NamedTuple):
    """The encoding of a join, and which of the left's last and the right's first ids it has kept."""

    whole: Encoded
    left_kept: int
    right_from: int


def join_at(
    tokenizer, left: Encoded, right: Encoded, reach: int = 2 * LONGEST_SPECIAL, more_left: bool = False, more_right: bool = False
) -> Joined | None:
    """The encoding of ``left.text + right.text`` from both sides' encodings.

    A window around the join is encoded anew and doubled until its first id is one of the left side's ids and one of its
    later ids is one of the right side's, on the same characters. Every pair of neighbouring ids has then been seen
    side by side in one of the three encodings, and merges never cross such a pair in a longer text either; splitting
    into pieces goes on alike from a shared id. So the result equals that of encoding the whole text.

    With ``more_left`` the left is only the end of a longer text, with ``more_right`` the right only the beginning of
    one. None if the window would have to reach beyond them.
    """
    text, cut = left.text + right.text, len(left.text)
    right_start, right_end = right.start + cut, right.end + cut
    left_borders = _borders(left)
    while True:
        keep = left_borders[left.start[left_borders] <= cut - reach]
        if not len(keep) and more_left:
            return None
        i = int(keep[-1]) if len(keep) else 0
        a = int(left.start[i]) if len(keep) else 0
        b = min(len(text), cut + 2 * reach)
        if b == len(text) and more_right:
            return None
        window = encode_whole(tokenizer, text[a:b])
        start, end = window.start + a, window.end + a
        if not len(keep) or (len(window.ids) and (window.ids[0], start[0], end[0]) == (left.ids[i], a, left.end[i])):
            k, j = len(window.ids), len(right.ids)
            if b < len(text):
                k = j = -1
                ours = _borders(window)
                ours = ours[start[ours] >= cut + LONGEST_SPECIAL]
                theirs = np.searchsorted(right_start, start[ours])
                for x, y in zip(ours.tolist(), theirs.tolist()):
                    if y < len(right.ids) and (window.ids[x], start[x], end[x]) == (right.ids[y], right_start[y], right_end[y]):
                        if y == 0 or right_end[y - 1] <= right_start[y]:
                            k, j = x, y
                            break
            if k >= 0:
                whole = Encoded(
                    text,
                    np.concatenate([left.ids[:i], window.ids[:k], right.ids[j:]]),
                    np.concatenate([left.start[:i], start[:k], right_start[j:]]),
                    np.concatenate([left.end[:i], end[:k], right_end[j:]]),
                )
                return Joined(whole, i, j)
        reach *= 2


def join(tokenizer, left: Encoded, right: Encoded, reach: int = 2 * LONGEST_SPECIAL) -> Encoded:
    """:func:`join_at` for two whole texts."""
    return join_at(tokenizer, left, right, reach).whole


class Edge(NamedTuple):
    """The code points that the first or the last ids of a part cover, counted from the part's beginning."""

    start: np.ndarray
    end: np.ndarray


class Part(NamedTuple):
    """A stretch of text with its ids as bytes, four each.

    ``head`` and ``tail`` are there where the first or the last word is so long that a join must not encode it anew.
    """

    text: str
    ids: bytes
    head: Edge | None = None
    tail: Edge | None = None


_LAST_WORD, _GAP = re.compile(r".*(?:\A|[ \t\n\r])(?=[^ \t\n\r])", re.DOTALL), re.compile(r"[ \t\n\r]|\Z")
_REACH = 2 * LONGEST_SPECIAL


def _first_words(text: str) -> int:
    """Where the first white space behind the window of a join is."""
    return _GAP.search(text, min(len(text), 3 * _REACH)).start()


def _last_words(text: str) -> int:
    """Where the last word begins that starts before the window of a join."""
    m = _LAST_WORD.match(text, 0, max(0, len(text) - _REACH))
    return m.end() if m else 0


def _edge(e: Encoded, first: bool) -> Edge:
    part = slice(0, EDGE_IDS) if first else slice(max(0, len(e.ids) - EDGE_IDS), None)
    return Edge(e.start[part], e.end[part])


def encode_leaf(encoder: words.WordIds, text: str) -> Part:
    long_head, long_tail = _first_words(text) > LONG_WORD, len(text) - _last_words(text) > LONG_WORD
    if not long_head and not long_tail:
        return Part(text, encoder.encode(text))
    e = encode_whole(encoder.tokenizer, text)
    ids = e.ids.astype("<u4").tobytes()
    return Part(text, ids, _edge(e, True) if long_head else None, _edge(e, False) if long_tail else None)


def _end_of(tokenizer, part: Part, whole_word: bool) -> tuple[Encoded, bool]:
    """(the part's last ids with what they cover, whether the word goes on to the left of them)."""
    if part.tail is None or whole_word:
        return encode_whole(tokenizer, part.text[_last_words(part.text) :]), False
    n, at = len(part.tail.start), int(part.tail.start[0])
    ids = np.frombuffer(part.ids, "<u4")[-n:]
    return Encoded(part.text[at:], ids, part.tail.start - at, part.tail.end - at), 4 * n < len(part.ids)


def _begin_of(tokenizer, part: Part, whole_word: bool) -> tuple[Encoded, bool]:
    if part.head is None or whole_word:
        return encode_whole(tokenizer, part.text[: _first_words(part.text)]), False
    n = len(part.head.start)
    if 4 * n == len(part.ids):
        return Encoded(part.text, np.frombuffer(part.ids, "<u4"), part.head.start, part.head.end), False
    return Encoded(part.text[: int(part.head.end[-1])], np.frombuffer(part.ids, "<u4")[:n], part.head.start, part.head.end), True


def join_parts(tokenizer, left: Part, right: Part) -> Part:
    """The same for long parts, of which only the ends meet.

    Ids restart at white space, so where there is some the words around the join are all that is needed of either side.
    Of longer words the ids at the ends are kept with the code points they cover, and the windows of the join look for
    agreement among them. Only where none of them agrees is the word encoded anew.
    """
    found = None
    for whole_word in (False, True):
        (tail, more_left), (head, more_right) = _end_of(tokenizer, left, whole_word), _begin_of(tokenizer, right, whole_word)
        found = join_at(tokenizer, tail, head, _REACH, more_left, more_right)
        if found:
            break
    text, middle = left.text + right.text, found.whole
    n_left, n_right = len(left.ids) // 4 - len(tail.ids), len(right.ids) // 4 - len(head.ids)
    ids = left.ids[: 4 * n_left] + middle.ids.astype("<u4").tobytes() + right.ids[4 * len(head.ids) :]
    # What the ends of the whole cover: as before, but for ids the join has changed.
    new_head, new_tail = left.head, right.tail
    if n_left == 0 and len(tail.text) == len(left.text):
        new_head = _edge(middle, True) if _first_words(text) > LONG_WORD else None
    elif left.head is not None:
        new_head = Edge(*(x[: n_left + found.left_kept] for x in left.head))
    shift = len(left.text)
    if n_right == 0 and len(head.text) == len(right.text):
        offset = len(left.text) - len(tail.text)
        last = _edge(middle, False)
        new_tail = Edge(last.start + offset, last.end + offset) if len(text) - _last_words(text) > LONG_WORD else None
    elif right.tail is not None:
        same = min(len(right.tail.start), n_right + len(head.ids) - found.right_from)
        new_tail = Edge(*(x[len(x) - same :] + shift for x in right.tail))
    return Part(text, ids, new_head if new_head is None or len(new_head.start) else None, new_tail if new_tail is None or len(new_tail.start) else None)


def join_all(tokenizer, parts: list[Part]) -> Part:
    """Neighbours are joined in pairs, then pairs of pairs, up to the whole text."""
    while len(parts) > 1:
        pairs = range(0, len(parts), 2)
        parts = [join_parts(tokenizer, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in pairs]
    return parts[0]


def encode_tree(encoder: words.WordIds, text: str, leaf_chars: int) -> Part:
    """The same in one process: halves of halves, down to ``leaf_chars``."""
    if len(text) <= leaf_chars:
        return encode_leaf(encoder, text)
    half = len(text) // 2
    return join_parts(
        encoder.tokenizer, encode_tree(encoder, text[:half], leaf_chars), encode_tree(encoder, text[half:], leaf_chars)
    )


def _packed(edge: Edge | None) -> bytes | None:
    return None if edge is None else np.concatenate(edge).astype("<i8").tobytes()


def _unpacked(packed: bytes | None) -> Edge | None:
    return None if packed is None else Edge(*np.frombuffer(packed, "<i8").reshape(2, -1))


def encode(docs: DataFrame, tokenizer_path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, ids) with ids as little-endian unsigned 32-bit integers, as the library encodes each whole text.

    A text of at most ``leaf_chars`` code points is a tree of one leaf and is encoded where it is read. Longer texts
    are cut into leaves anywhere, inside words too; the leaves are dealt out over all tasks and encoded in parallel,
    and the halves are joined by growing windows, see :func:`join`. Only the leaves of one text meet in one task.

    A null text is empty and has no ids; repeated rows and null ids stay as they are; an empty table gives an empty one;
    other columns are ignored.
    """
    path = tokenizer_path or words.default_path()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.char_length("text")

    def short(batches):
        encoder = words.word_ids(path)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                yield doc_id, encoder.encode(text)

    def leaf(batches):
        encoder = words.word_ids(path)
        for batch in batches:
            for key, doc_id, at, text in zip(*(batch[c].to_pylist() for c in ("key", "doc_id", "at", "part"))):
                part = encode_leaf(encoder, text)
                yield key, doc_id, at, text, part.ids, _packed(part.head), _packed(part.tail)

    def whole(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["at"])
        copies = sum(r["at"] == 0 for r in rows)
        parts = [Part(r["part"], r["ids"], _unpacked(r["head"]), _unpacked(r["tail"])) for r in rows[::copies]]
        ids = join_all(words.load(path), parts).ids
        return pa.table(
            {"doc_id": pa.array([rows[0]["doc_id"]] * copies, pa.int64()), "ids": pa.array([ids] * copies, pa.binary())}
        )

    leaves = docs.where(size > leaf_chars).select(
        F.xxhash64("doc_id", "text", F.reverse("text")).alias("key"),
        "doc_id",
        F.posexplode(F.expr(f"regexp_extract_all(text, '(?s).{{1,{leaf_chars}}}', 0)")).alias("at", "part"),
    )
    encoded = common.map_rows(
        leaves.repartition("key", "at"), leaf, "key long, doc_id long, at int, part string, ids binary, head binary, tail binary"
    )
    return common.map_rows(docs.where(size <= leaf_chars), short, "doc_id long, ids binary").unionByName(
        encoded.groupBy("key").applyInArrow(whole, "doc_id long, ids binary")
    )


@lru_cache(maxsize=4)
def tokens(path: str) -> list[str]:
    tokenizer = words.load(path)
    return [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]


def decode(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the library's decoding with special tokens. The vocabulary file names no decoder, so
    that is its tokens with one space between them. Null ids decode to the empty text."""
    path = tokenizer_path or words.default_path()

    def rows(batches):
        token = tokens(path).__getitem__
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist()):
                yield doc_id, ids, " ".join(map(token, array("I", ids or b"")))

    return common.map_rows(encoded.select("doc_id", "ids"), rows, "doc_id long, ids binary, decoded string")
