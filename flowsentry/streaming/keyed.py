"""Stream jobs that keep state by key and take each key's rows in event-time order.

Rows wait in Spark's own state store until the watermark has passed them; an event-time timeout of their key then
releases them, ordered, to the job's rules, which keep what later rows need in the same state. What is released equals
what the batch operators give for the same rows, however the stream was cut or restarted, and goes to a plain file sink.

A key's rows are all taken by one task. Where there are many they come to it in blocks, packed by the tasks that read them:
that task opens only the columns its rules read, a stretch of time after the other, and hands the texts on as they are, to
be opened by all tasks.

Spark drops a row that is older than the watermark before the job sees it. The watermark is therefore kept on a copy of
the time that lies GRACE later and with a delay that is longer by as much: it reads the same, rows are late by the
job's own test, and none is dropped.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowsentry.operators import flows

GRACE_HOURS = 876_000
#: Time of the mark that ends a stream, in the year 2099; and the time that stands for none, which is always late.
END_US, NO_TIME = 4_100_000_000_000_000, -(1 << 63)
MARK = "end of stream"

#: What a row brings to its key's rules, besides the job's own columns.
ROW = "t_us long, event_id long, row string"
STATE = "waiting binary, blocks binary, memory string"

#: Rows of a block; a task packs a key's rows if it has so many of them in an Arrow batch, and passes the others as they are.
BLOCK_ROWS, LEAST_BLOCK = 16_384, 512
#: Rows that go to a key's rules at once, or those of one moment.
RELEASE_ROWS = 1_000_000
#: First and last time of a block, its rows, and the bytes of its facts.
HEAD = struct.Struct("<4q")
ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}

#: Spark hands a key's state over with every so many of its rows, so few large batches of rows and a small state: else
#: the bytes handed over grow with the square of a key's rows.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 100_000

#: A state partition costs its files and a call of Python in each micro-batch, however little it holds, so a stream has
#: a few for each core of the cluster and not more than the session asks for. Spark keeps the number of the first start.
PARTITION_SETTING, PARTITIONS_PER_CORE, LEAST_PARTITIONS = "spark.sql.shuffle.partitions", 2, 24


class KeyedStream:
    """Base of the stateful stream jobs.

    A job names the key of a row, the columns its rules read (``facts``) and those they add (``results``), and gives
    ``rules(ready, memory, watermark) -> (released, memory, until)``: rows in order and what the key remembers, to the
    same rows with results, what it remembers now, and the event time until which that can matter (None for good).
    """

    facts: dict[str, str] = {}
    results: dict[str, str] = {}

    def __init__(self, spark: SparkSession, path: str, delay_us: int) -> None:
        self.spark, self.path, self.delay_us = spark, path.rstrip("/"), delay_us
        self.events: DataFrame | None = None

    def key(self) -> Column:
        raise NotImplementedError

    def fact_columns(self) -> dict[str, Column]:
        """Columns of ``facts``; none may be null."""
        raise NotImplementedError

    def rules(self) -> Callable:
        raise NotImplementedError

    def prepared(self, events: DataFrame) -> DataFrame:
        """Stateless work before the rows are dealt out by key."""
        return events

    def finished(self, rows: DataFrame) -> DataFrame:
        """Stateless work on the released rows; ``late`` rows have null results."""
        return rows

    def transformed(self, events: DataFrame) -> DataFrame:
        """Released and late rows of a stream: the columns of ``prepared``, results and ``late``."""
        rows = self.prepared(events)
        columns = [c for c in rows.columns if c != "_mark"]
        delay = f"{GRACE_HOURS} hours {max(1, self.delay_us // 1000)} milliseconds"
        is_mark = F.col("_mark")
        keyed = rows.select(
            F.when(is_mark, F.lit(MARK)).otherwise(F.to_json(F.struct(self.key()))).alias("key"),
            F.coalesce(F.col("t_us"), F.lit(NO_TIME)).alias("t_us"),
            F.coalesce(F.col("event_id"), flows.content_id(columns, F.lit(0).cast("long"))).alias("event_id"),
            F.to_json(F.struct(*[c for c in columns if c != "event_id"])).alias("row"),
            *[c.alias(n) for n, c in self.fact_columns().items()],
        )
        facts = "".join(f", {n} {t}" for n, t in self.facts.items())
        dealt = keyed.mapInArrow(in_blocks(self.facts), f"key string, {ROW}{facts}, packed binary, seen_us long")
        seen = F.timestamp_micros("seen_us") + F.expr(f"interval {GRACE_HOURS} hours")
        dealt = dealt.withColumn("_seen", seen).drop("seen_us").withWatermark("_seen", delay)
        added = "".join(f", {n} {t}" for n, t in self.results.items())
        released = dealt.groupBy("key").applyInPandasWithState(
            in_order(self.rules(), self.facts, self.results),
            f"{ROW}, late boolean{added}, texts binary, packed binary", STATE, "append", GroupStateTimeout.EventTimeTimeout,
        )
        schema = T.StructType([f for f in rows.schema if f.name not in ("event_id", "_mark")])
        # The rest needs no key, so a large key's rows go on in all tasks; as rows of a generator a text is parsed once
        # and not once for each use of each column.
        spread = released.drop("t_us").repartition("event_id")
        spread = spread.mapInArrow(opened(self.results), f"event_id long, row string, late boolean{added}")
        parsed = spread.select("event_id", *self.results, "late", F.inline(F.array(F.from_json("row", schema))))
        return parsed.select(*columns, *self.results, "late")

    def start(self, events: DataFrame, **trigger) -> StreamingQuery:
        """Run on a stream of events; by default until all that is there has been read."""
        self.events = events
        marks = f"{self.path}/marks"
        end_mark(self.spark, events.schema, "t_us", marks, False)
        ends = self.spark.readStream.schema(events.schema).parquet(marks).withColumn("_mark", F.lit(True))
        rows = self.finished(self.transformed(events.withColumn("_mark", F.lit(False)).unionByName(ends)))
        writer = rows.writeStream.format("parquet").option("path", f"{self.path}/out")
        writer = writer.option("checkpointLocation", f"{self.path}/checkpoint")
        with stream_settings(self.spark):
            return writer.trigger(**(trigger or {"availableNow": True})).start()

    def finish(self, events: DataFrame | None = None) -> None:
        """End the stream: release all that still waits. What arrives later is late."""
        events = self.events if events is None else events
        end_mark(self.spark, events.schema, "t_us", f"{self.path}/marks", True)
        self.start(events).awaitTermination()

    def written(self) -> DataFrame:
        """All rows that finished batches have written."""
        return self.spark.read.parquet(f"{self.path}/out")

    def late_rows(self) -> DataFrame:
        """Rows that came after the watermark had passed them, and rows without a time."""
        return self.written().where("late")


def state_partitions(spark: SparkSession) -> int:
    wanted = max(LEAST_PARTITIONS, PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism)
    return min(wanted, int(spark.conf.get(PARTITION_SETTING)))


@contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """Settings of a stateful stream while it is started; the running query keeps them, the session has its own again."""
    wanted = {BATCH_SETTING: str(BATCH_ROWS), PARTITION_SETTING: str(state_partitions(spark))}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def end_mark(spark: SparkSession, schema: T.StructType, time: str, path: str, end: bool) -> None:
    """A table of marks beside a stream's input: none, or with ``end`` one more row that has nothing but a late time."""
    late = F.timestamp_micros(F.lit(END_US)) if isinstance(schema[time].dataType, T.TimestampType) else F.lit(END_US)
    columns = [(late if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1 if end else 0).select(*columns).coalesce(1).write.mode("append" if end else "ignore").parquet(path)


class Block:
    """Rows of one key in order of time, packed: facts and texts apart, so that either is read without the other."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.first, self.last, self.rows, self._facts = HEAD.unpack_from(data)

    @classmethod
    def of(cls, facts: pa.Table, texts: pa.Table) -> Block:
        ends = pc.min_max(facts["t_us"]).as_py()
        packed = pack_table(facts)
        return cls(HEAD.pack(ends["min"], ends["max"], len(facts), len(packed)) + packed + pack_table(texts))

    @classmethod
    def of_rows(cls, rows: pd.DataFrame) -> Block:
        table = pa.Table.from_pandas(in_time(rows), preserve_index=False)
        return cls.of(narrow(table), table.select(["row"]))

    def facts(self) -> pa.Table:
        return unpack_table(memoryview(self.data)[HEAD.size : HEAD.size + self._facts])

    def packed_texts(self) -> memoryview:
        return memoryview(self.data)[HEAD.size + self._facts :]

    def texts(self) -> pa.Array:
        return unpack_table(self.packed_texts())["row"]

    def before(self, watermark: int) -> int:
        """How many of its rows the watermark has passed."""
        if self.first >= watermark or self.last < watermark:
            return 0 if self.first >= watermark else self.rows
        return int(np.searchsorted(self.facts()["t_us"].to_numpy(), watermark))

    def since(self, n: int) -> Block:
        return Block.of(self.facts().slice(n), pa.table({"row": self.texts().slice(n)})) if n else self


def narrow(table: pa.Table) -> pa.Table:
    """The facts of rows, each different text of a block once."""
    table = table.drop_columns(["row"])
    for i, field in enumerate(table.schema):
        if pa.types.is_string(field.type) or pa.types.is_large_string(field.type):
            table = table.set_column(i, field.name, table[i].combine_chunks().dictionary_encode())
    return table


def in_blocks(facts: dict[str, str]) -> Callable:
    """The function that packs a task's rows: blocks of the keys that have many, the other rows as they are."""
    brought = ["t_us", "event_id", *facts, "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, t = batch["key"].dictionary_encode().indices.to_numpy(), batch["t_us"].to_numpy()
            order = np.lexsort((t, key))
            key, rows = key[order], pa.Table.from_batches([batch.take(pa.array(order))])
            ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
            starts = np.append(0, ends[:-1])
            many = ends - starts >= LEAST_BLOCK
            cuts = [np.linspace(a, b, -(-(b - a) // BLOCK_ROWS) + 1).astype(int) for a, b in zip(starts[many], ends[many])]
            pieces = [(a, b) for cut in cuts for a, b in zip(cut, cut[1:])]
            packed = []
            for a, b in pieces:
                piece = rows.select(brought).slice(a, b - a)
                packed.append(Block.of(narrow(piece), piece.select(["row"])).data)
            single = np.flatnonzero(np.repeat(~many, ends - starts))
            time = rows["t_us"].to_numpy()
            seen = np.where(time == NO_TIME, 0, time)
            heads = rows.take(pa.array([a for a, _ in pieces], pa.int64()))
            heads = heads.set_column(heads.schema.get_field_index("row"), "row", pa.array([""] * len(pieces), pa.string()))
            yield from shipped(rows.take(pa.array(single)), None, seen[single])
            yield from shipped(heads, packed, np.array([seen[a:b].max() for a, b in pieces], np.int64))

    def shipped(rows: pa.Table, packed: list[bytes] | None, seen: np.ndarray) -> list[pa.RecordBatch]:
        blocks = pa.array(packed, pa.binary()) if packed is not None else pa.nulls(len(rows), pa.binary())
        rows = rows.select(["key", "t_us", "event_id", "row", *facts])
        return rows.append_column("packed", blocks).append_column("seen_us", pa.array(seen)).combine_chunks().to_batches()

    return run


def opened(results: dict[str, str]) -> Callable:
    """The function that makes rows again of the blocks that were released."""
    columns = ["event_id", "row", "late", *results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(batch["packed"].is_null()).select(columns)
            for texts, packed in zip(batch["texts"], batch["packed"]):
                if packed.is_valid:
                    rows = unpack_table(packed.as_buffer())
                    rows = rows.append_column("row", unpack_table(texts.as_buffer())["row"].take(rows["at"]))
                    yield from rows.select(columns).combine_chunks().to_batches()

    return run


def in_order(rules: Callable, facts: dict[str, str], results: dict[str, str]) -> Callable:
    """The function for ``applyInPandasWithState``: what waits, what is late, and what the watermark releases."""
    brought = ["t_us", "event_id", "row", *facts]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] == MARK:
            return
        watermark = state.getCurrentWatermarkMs() * 1000
        packed, packed_blocks, memory = state.get if state.exists else (None, None, None)
        rows = [] if packed is None else [unpack(packed)]
        blocks = [] if packed_blocks is None else [Block(b) for b in unpack_table(packed_blocks)["block"].to_pylist()]
        for part in () if state.hasTimedOut else parts:
            single = part["packed"].isna()
            late = single & (part["t_us"] < watermark)
            if late.any():
                yield shaped(part[late], results, True)
            rows.append(part.loc[single & ~late, brought])
            for block in map(Block, part.loc[~single, "packed"]):
                n = block.before(watermark)
                if n:
                    yield shipped([(block, late_rows(block, n, results))], results)
                if n < block.rows:
                    blocks.append(block.since(n))
        waiting = pd.concat(rows, ignore_index=True) if rows else pd.DataFrame(columns=brought)
        passed = (waiting["t_us"] < watermark).to_numpy(bool)
        taken = [block.before(watermark) for block in blocks]
        ready, waiting = waiting[passed], waiting[~passed]
        memory = None if memory is None else json.loads(memory)
        until = None
        if any(taken):
            released = Release(ready, [(b, n) for b, n in zip(blocks, taken) if n], results)
            memory, until = yield from released.by(rules, memory, watermark)
            blocks = [b.since(n) for b, n in zip(blocks, taken) if n < b.rows]
        # A timeout may come for what the key remembers alone.
        elif len(ready) or memory is not None:
            released, memory, until = rules(one_of_each(ready) if len(ready) else None, memory, watermark)
            if len(ready):
                yield shaped(released, results, False)
        if len(waiting) >= LEAST_BLOCK:
            blocks.append(Block.of_rows(waiting))
            waiting = waiting[:0]
        if len(waiting) or blocks or memory is not None:
            listed = pack_table(pa.table({"block": pa.array([b.data for b in blocks], pa.large_binary())}), None) if blocks else None
            state.update((pack(waiting) if len(waiting) else None, listed, None if memory is None else json.dumps(memory)))
            if len(waiting) or blocks:
                state.setTimeoutTimestamp(max(1, int(min([*waiting["t_us"], *(b.first for b in blocks)])) // 1000))
            elif until is not None:
                state.setTimeoutTimestamp(max(int(until // 1000) + 1, watermark // 1000 + 1))
        elif state.exists:
            state.remove()

    return run


class Release:
    """Rows of a key that the watermark has passed, single ones and the first of each block.

    They go to the rules a stretch of time after the other, each with its end for a watermark, so only the facts of all of
    them are held at once. Results are kept packed until the blocks are handed on.
    """

    def __init__(self, single: pd.DataFrame, blocks: list[tuple[Block, int]], results: dict[str, str]) -> None:
        self.single, self.blocks, self.results = in_time(single), [b for b, _ in blocks], results
        self.frames = [b.facts().slice(0, n).to_pandas() for b, n in blocks]
        if len(single):
            texts = {c: "category" for c in self.frames[0] if isinstance(self.frames[0][c].dtype, pd.CategoricalDtype)}
            self.frames.append(self.single.drop(columns="row").astype(texts))
        self.schema = result_schema(results)
        self.sinks = [pa.BufferOutputStream() for _ in self.blocks]
        self.writers = [packed_writer(sink, self.schema) for sink in self.sinks]

    def by(self, rules: Callable, memory, watermark: int) -> Iterator[pd.DataFrame]:
        """Yields what is released; returns what the key remembers, and until when."""
        times = [f["t_us"].to_numpy() for f in self.frames]
        until, done = None, [0] * len(times)
        for end in [*self.ends(times), watermark]:
            upto = [int(np.searchsorted(t, end)) for t in times]
            ready = one_of_each(self.rows(done, upto), self.texts)
            released, memory, until = rules(ready, memory, end)
            yield from self.keep(released)
            done = upto
        for writer in self.writers:
            writer.close()
        packed = [(block, sink.getvalue()) for block, sink in zip(self.blocks, self.sinks)]
        for i in range(0, len(packed), 64):
            yield shipped(packed[i : i + 64], self.results)
        return memory, until

    @staticmethod
    def ends(times: list[np.ndarray]) -> list[int]:
        """Times that cut the rows into stretches of ``RELEASE_ROWS``; no moment is cut."""
        t = np.concatenate(times)
        at = np.arange(RELEASE_ROWS, len(t), RELEASE_ROWS)
        return [int(x) for x in np.unique(np.partition(t, at)[at]) if x > t.min()] if len(at) else []

    def rows(self, start: list[int], end: list[int]) -> pd.DataFrame:
        frames = []
        for i, (frame, a, b) in enumerate(zip(self.frames, start, end)):
            if a < b:
                frames.append(frame.iloc[a:b].assign(block=np.int32(i), at=np.arange(a, b, dtype=np.int32)))
        joined = {}
        for c in frames[0]:
            columns = [f[c] for f in frames]
            if isinstance(columns[0].dtype, pd.CategoricalDtype):
                joined[c] = pd.api.types.union_categoricals(columns)
            else:
                joined[c] = np.concatenate([x.to_numpy() for x in columns])
        return pd.DataFrame(joined)

    def texts(self, rows: pd.DataFrame) -> np.ndarray:
        """Texts of a few of the rows."""
        out = np.empty(len(rows), object)
        places, at = rows["block"].to_numpy(), rows["at"].to_numpy()
        order = np.argsort(places, kind="stable")
        found, starts = np.unique(places[order], return_index=True)
        for i, here in zip(found, np.split(order, starts[1:])):
            if i == len(self.blocks):
                out[here] = self.single["row"].to_numpy()[at[here]]
            else:
                out[here] = self.blocks[i].texts().take(pa.array(at[here])).to_pylist()
        return out

    def keep(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Results of a stretch, put with their blocks; those of single rows are yielded."""
        rows = rows[["t_us", "event_id", "block", "at", *self.results]].iloc[np.argsort(rows["block"].to_numpy(), kind="stable")]
        places = rows["block"].to_numpy()
        n = int(np.searchsorted(places, len(self.blocks)))
        if n < len(rows):
            alone = rows.iloc[n:]
            yield shaped(alone.assign(row=self.texts(alone)), self.results, False)
        table = pa.Table.from_pandas(rows.iloc[:n].assign(late=False), schema=self.schema, preserve_index=False)
        for i in np.unique(places[:n]):
            a, b = np.searchsorted(places[:n], [i, i + 1])
            self.writers[i].write_table(table.slice(a, b - a))


def result_schema(results: dict[str, str]) -> pa.Schema:
    kept = {"at": pa.int32(), "event_id": pa.int64(), "late": pa.bool_()}
    return pa.schema([*kept.items(), *((name, ARROW[kind]) for name, kind in results.items())])


def late_rows(block: Block, n: int, results: dict[str, str]) -> bytes:
    """The first rows of a block, as late."""
    rows = {"at": pa.array(np.arange(n), pa.int32()), "event_id": block.facts()["event_id"].slice(0, n), "late": pa.array([True] * n)}
    return pack_table(pa.table(rows | {name: pa.nulls(n, ARROW[kind]) for name, kind in results.items()}))


def shipped(blocks: list[tuple[Block, bytes]], results: dict[str, str]) -> pd.DataFrame:
    """Blocks as rows to hand on: their texts as they came, and the results of the rows that are released."""
    out = pd.DataFrame({"t_us": [b.first for b, _ in blocks], "event_id": [hash((b.first, b.last, i)) for i, (b, _) in enumerate(blocks)]})
    out["row"], out["late"] = "", False
    out[[*results]] = None
    out["texts"] = [bytes(b.packed_texts()) for b, _ in blocks]
    out["packed"] = [bytes(p) for _, p in blocks]
    return out


def one_of_each(rows: pd.DataFrame, texts: Callable | None = None) -> pd.DataFrame:
    """Rows in order, each event once: equal ones with an id of their own are one, others get their ranks.

    Texts are compared, and read, of rows that are equal in time and id only; ``texts`` gives them where they are packed.
    """
    rows = in_time(rows)
    t, n = rows["t_us"].to_numpy(), rows["event_id"].to_numpy()
    again = (t[1:] == t[:-1]) & (n[1:] == n[:-1])
    if not again.any():
        return rows
    tied = np.flatnonzero(np.append(again, False) | np.append(False, again))
    equals = rows.iloc[tied]
    equals = equals if texts is None else equals.assign(row=texts(equals))
    equals = equals.sort_values(["t_us", "event_id", "row"], kind="stable")
    place, rank = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    place[tied] = equals.index
    source = equals["row"].map(lambda row: str(json.loads(row).get("src_ip")))
    rank[tied] = equals.groupby([equals["t_us"], equals["event_id"], source]).cumcount()
    rows = rows.iloc[place].reset_index(drop=True)
    named = (rows["event_id"] >= 0).to_numpy(bool)
    rows["event_id"] = np.where(named, rows["event_id"], rows["event_id"] ^ rank)
    return in_time(rows[~(named & (rank > 0))])


def in_time(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.iloc[np.lexsort((rows["event_id"], rows["t_us"]))].reset_index(drop=True)


def shaped(rows: pd.DataFrame, results: dict[str, str], late: bool) -> pd.DataFrame:
    out = rows[["t_us", "event_id", "row"]].copy()
    out["late"] = late
    for name in results:
        out[name] = None if late else rows[name]
    out["texts"] = out["packed"] = None
    return out


def pack(rows: pd.DataFrame) -> bytes:
    return pack_table(pa.Table.from_pandas(rows, preserve_index=False))


def unpack(packed: bytes) -> pd.DataFrame:
    return unpack_table(packed).to_pandas()


def packed_writer(sink: pa.BufferOutputStream, schema: pa.Schema, compression: str | None = "zstd") -> pa.RecordBatchStreamWriter:
    return pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression=compression))


def pack_table(table: pa.Table, compression: str | None = "zstd") -> bytes:
    sink = pa.BufferOutputStream()
    with packed_writer(sink, table.schema, compression) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_table(packed) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()
