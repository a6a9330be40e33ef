"""Sum-of-squares online packing of documents into token windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from flowsentry.llm import common, words

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class Windows:
    """Open windows of one task, counted by fill level.

    A piece goes to the level (or a new window) that leaves the least sum of squared counts of partially filled
    windows; ties go to the fullest level. At most ``most_open`` windows stay open: beyond that, and at the end, the
    open windows are emptied into a stream that is cut at window borders, so that nothing is padded but the last
    stretch, which is cut at powers of two.
    """

    def __init__(self, window: int, first_id: int, most_open: int = 2048):
        self.window, self.most_open = window, most_open
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]  # by level: the pieces of each window
        self.n_open = 0
        self.next_id = first_id

    def level_for(self, size: int) -> int:
        """The level to place a piece at; 0 opens a window."""
        counts, top = self.counts, self.window - size
        change = 2 * counts[size : self.window + 1] + 2  # the grown window adds 2 n + 1, the old one gives back 2 n - 1
        change[-1] = 1  # a filled window is no longer counted
        change -= 2 * counts[: top + 1]
        change[counts[: top + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * counts[size] + 1 if size < self.window else 0
        return top - int(np.argmin(change[::-1]))

    def add(self, piece: tuple, size: int) -> Iterator[tuple]:
        """``piece``: (doc_id, ids, start, doc_tokens)."""
        level = self.level_for(size)
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            yield from self.emit(pieces)
            return
        self.open[level + size].append(pieces)
        self.counts[level + size] += 1
        self.n_open += 1
        if self.n_open > self.most_open:
            yield from self.empty(last=False)

    def emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        sequence, offset = self.next_id, 0
        self.next_id += 1
        for doc_id, ids, start, total in pieces:
            n = len(ids) // 4
            yield doc_id, start, n, zlib.crc32(ids), total, sequence, offset
            offset += n

    def empty(self, last: bool) -> Iterator[tuple]:
        stream = [p for level in reversed(self.open) for pieces in level for p in pieces]
        self.open = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        self.n_open = 0
        held, room = [], self.window
        for doc_id, ids, start, total in stream:
            while ids:
                part = ids[: 4 * room]
                held.append((doc_id, part, start, total))
                ids, start, room = ids[len(part) :], start + len(part) // 4, room - len(part) // 4
                if not room:
                    yield from self.emit(held)
                    held, room = [], self.window
        if held and not last:
            fill = self.window - room
            self.open[fill].append(held)
            self.counts[fill] += 1
            self.n_open = 1
        elif held:
            yield from self.cut_at_powers(held)

    def cut_at_powers(self, pieces: list[tuple]) -> Iterator[tuple]:
        """A last stretch shorter than a window, as sequences whose lengths are powers of two."""
        left = sum(len(p[1]) for p in pieces) // 4
        queue = list(reversed(pieces))
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            held = []
            while room:
                doc_id, ids, start, total = queue.pop()
                part, rest = ids[: 4 * room], ids[4 * room :]
                held.append((doc_id, part, start, total))
                room -= len(part) // 4
                if rest:
                    queue.append((doc_id, rest, start + len(part) // 4, total))
            yield from self.emit(held)


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``window`` tokens.

    A document is its ids followed by ``end_id``. Whole windows are cut from its front; what remains is placed by
    sum of squares, see :class:`Windows`. Each task packs the rows it reads, so nothing is shuffled and memory is
    bounded by the open windows; sequence ids carry the task's partition number in their upper bits.

    A null text is empty (one token, the end). Repeated rows are packed as often as they come; a null doc_id is kept.
    Other columns are ignored. An empty table gives no rows.
    """
    path = tokenizer_path or words.default_path()
    end = int(end_id).to_bytes(4, "little")

    def rows(batches):
        encoder = words.word_ids(path)
        windows = Windows(window, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = encoder.encode(text or "") + end
                total = len(ids) // 4
                whole = total - total % window
                for start in range(0, whole, window):
                    yield from windows.emit([(doc_id, ids[4 * start : 4 * (start + window)], start, total)])
                if total > whole:
                    yield from windows.add((doc_id, ids[4 * whole :], whole, total), total - whole)
        yield from windows.empty(last=True)

    return common.map_rows(docs.select("doc_id", "text"), rows, SCHEMA)
