"""Lines that many documents share, found with a sharded minimal perfect hash instead of a join of lines.

    lines    each document's distinct line hashes, pre-aggregated by unit: a unit is the documents of one hash value
    shards   the distinct hashes by their leading bits; a shard is one perfect hash with fingerprints and counts
    answers  each unit asks the shards for its hashes, once for each, and gets back those that are frequent
    kept     the documents of a unit meet its one answer and lose these lines

Lines travel as 128-bit hashes only; texts are shuffled once, in the last step. A line that all documents share is one
row for each unit, and units are at most a 1024th of the documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import common, linehash
from flowsentry.session import materialize

#: Documents of a unit and distinct hashes of a shard, on average.
UNIT_DOCUMENTS, SHARD_KEYS = 1024, 1 << 17
#: What is stripped from a line's ends.
BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """Without blanks at both ends and with ASCII letters in lower case."""
    return line.strip(BLANKS).lower()


def key_hash(line: bytes) -> bytes | None:
    """128 bits of a line's key; None for an empty key."""
    key = line_key(line)
    return xxhash.xxh3_128_digest(key) if key else None


def _long_enough(line: bytes, least_chars: int) -> bool:
    return least_chars <= 1 or len(line_key(line).decode()) >= least_chars


def line_hashes(text: bytes, least_chars: int) -> set[bytes]:
    """Distinct hashes of the lines that may be dropped."""
    found = {key_hash(line) for line in text.split(b"\n") if _long_enough(line, least_chars)}
    found.discard(None)
    return found


def kept_lines(text: bytes, frequent: set[bytes], least_chars: int) -> tuple[int, int, bytes]:
    """(lines, dropped lines, text of the others)."""
    lines = text.split(b"\n")
    if not frequent:
        return len(lines), 0, text
    kept = [line for line in lines if key_hash(line) not in frequent or not _long_enough(line, least_chars)]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def by_unit(docs: DataFrame) -> DataFrame:
    """(unit, doc_id, body): the unit follows from the row's own values, so every pass over the table gives the same."""
    units = max(1, docs.count() // UNIT_DOCUMENTS)
    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(units))
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(unit.alias("unit"), "doc_id", body.alias("body"))


def unit_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(unit, high, low, n): for each distinct line of a unit the number of its documents that have it."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_hashes(body.as_py(), least_chars) for body in batch["body"]]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            halves = np.frombuffer(b"".join(h for hashes in found for h in hashes), ">i8").astype(np.int64).reshape(-1, 2)
            units = np.repeat(batch["unit"].to_numpy(), sizes)
            columns = [units, np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])]
            for at in range(0, len(units), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], ["unit", "high", "low"])

    hashes = docs.select("unit", "body").mapInArrow(rows, "unit long, high long, low long")
    return hashes.groupBy("unit", "high", "low").agg(F.count(F.lit(1)).alias("n"))


def _shard(bits: int) -> Column:
    return F.shiftrightunsigned("high", 64 - bits) if bits else F.lit(0).cast("long")


def _runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Stretches of rows with equal ``key`` of sorted batches; a key may come in several stretches."""
    for batch in batches:
        values = batch[key].to_numpy()
        cuts = np.flatnonzero(np.diff(values)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]):
            if b > a:
                yield int(values[a]), batch.slice(a, b - a)


def build_shards(lines: DataFrame, bits: int, kind: str) -> DataFrame:
    """(shard, sizes, bits, prints, counts): the index over all distinct hashes of ``lines``, 2^bits shards."""

    def index(shard: int, parts: list[np.ndarray]) -> tuple:
        high, low, n = (np.concatenate(c) for c in zip(*parts))
        return shard, *linehash.CountIndex.build(high.view(np.uint64), low.view(np.uint64), n, kind).dump()

    def rows(batches):
        now, parts = None, []
        for shard, run in _runs(batches, "shard"):
            if shard != now and parts:
                yield index(now, parts)
                parts = []
            now = shard
            parts.append([run[c].to_numpy() for c in ("high", "low", "n")])
        if parts:
            yield index(now, parts)

    # Dealt by the shard alone: that also serves the sums by hash, so the hashes move once.
    sums = (
        lines.select(_shard(bits).alias("shard"), "high", "low", "n")
        .repartition("shard")
        .groupBy("shard", "high", "low")
        .agg(F.sum("n").alias("n"))
        .sortWithinPartitions("shard")
    )
    return common.map_rows(sums, rows, "shard long, sizes binary, bits binary, prints binary, counts binary")


def ask_shards(lines: DataFrame, shards: DataFrame, bits: int, kind: str, least: int) -> DataFrame:
    """(unit, hashes): the hashes of a unit that are in at least ``least`` documents, 16 bytes each.

    A shard and its questions lie in one partition, the shard first; the questions stream past it.
    """
    asked = lines.select(_shard(bits).alias("shard"), F.lit(1).alias("turn"), "unit", "high", "low")
    # Several columns, so that the name "bits" of the index does not meet the argument.
    index = shards.select("shard", F.lit(0).alias("turn"), *[F.col(c).alias(f"i_{c}") for c in ("sizes", "bits", "prints", "counts")])
    both = asked.unionByName(index, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "turn")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, known = None, None
        for value, run in _runs(batches, "shard"):
            if value != shard:
                stored = [run[f"i_{c}"][0].as_py() for c in ("sizes", "bits", "prints", "counts")]
                shard, known, run = value, linehash.CountIndex.load(*stored, kind), run.slice(1)
            if not run.num_rows:
                continue
            high, low = run["high"].to_numpy(), run["low"].to_numpy()
            often = known.count(high.view(np.uint64), low.view(np.uint64)) >= least
            columns = [c[often] for c in (run["unit"].to_numpy(), high, low)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["unit", "high", "low"])

    return both.mapInArrow(rows, "unit long, high long, low long")


def drop_lines(docs: DataFrame, answers: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): the documents of a unit without the lines of its answer."""
    both = (
        answers.select("unit", F.lit(0).alias("turn"), "high", "low")
        .unionByName(docs.select("unit", F.lit(1).alias("turn"), "doc_id", "body"), allowMissingColumns=True)
        .repartition("unit")
        .sortWithinPartitions("unit", "turn")
    )

    def rows(batches):
        unit, frequent = None, set()
        for value, run in _runs(batches, "unit"):
            if value != unit:
                unit, frequent = value, set()
            answer = run["turn"].to_numpy() == 0
            size = int(answer.sum())
            halves = np.stack([run[c].slice(0, size).to_numpy(zero_copy_only=False) for c in ("high", "low")], axis=1)
            packed = halves.astype(">i8").tobytes()
            frequent.update(packed[i : i + 16] for i in range(0, len(packed), 16))
            for doc_id, body in zip(run["doc_id"].slice(size).to_pylist(), run["body"].slice(size).to_pylist()):
                lines, dropped, text = kept_lines(body, frequent, least_chars)
                yield doc_id, lines, dropped, text.decode()

    return common.map_rows(both, rows, "doc_id long, n_lines long, n_dropped long, text string")


def dedup_lines(docs: DataFrame, least_documents: int = 10, least_chars: int = 1) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): every document without the lines that at least ``least_documents`` have.

    Lines are compared by their key (blanks at the ends off, ASCII letters in lower case); a key of fewer than
    ``least_chars`` code points, and so an empty one, is never dropped, and a line that stays is left as it is. Each
    row is a document of its own, also with a null or repeated doc_id; a line counts once in it. Rows that are equal in
    doc_id and text share a unit. A null or empty text is one empty line. An empty table gives an empty one. Other
    columns are ignored. Lines are told apart by 128 bits; no table of fingerprints is asked for a line it was not
    built from, so the 32-bit fingerprints reject nothing here.
    """
    docs = by_unit(docs)
    lines = materialize(unit_lines(docs, max(1, least_chars)), "lines")
    rows = lines.count()  # at least the number of distinct hashes
    bits = max(0, (rows // SHARD_KEYS).bit_length())
    kind = linehash.counter_kind(least_documents)
    shards = materialize(build_shards(lines, bits, kind), "line-shards")
    return drop_lines(docs, ask_shards(lines, shards, bits, kind, least_documents), max(1, least_chars))
