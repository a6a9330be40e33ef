"""Readers for stored alerts, events, rules, indicators, feeds, feedback and runs."""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from flowsentry import schemas
from flowsentry.functions import scalars as S
from flowsentry.operators import decisions, flows, rules as rule_ops
from flowsentry.operators.intel import indicators_in_text

def json_lines(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """JSON objects with the columns of ``schema``, one per line or, with ``multi_line``, one per file.

    Whether a row counts is decided on its text alone: it must be a JSON object. Its fields are read as text and then
    converted, so a number in quotes or with a fraction is still a number, and a value that cannot be converted is null
    in its own column only. Blank and malformed rows are left out, see ``rejected_lines``; a missing path is an empty table.
    """
    text = _texts(spark, path, multi_line)
    if text is None:
        return spark.createDataFrame([], schema)
    return parsed(text.where(_is_object(F.col("value"))), schema)


def rejected_lines(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(file, value): what ``json_lines`` leaves out of this path, blank lines apart."""
    text = _texts(spark, path, multi_line)
    if text is None:
        return spark.createDataFrame([], "file string, value string")
    rest = text.where(~_is_object(F.col("value")) & (S.strip(F.col("value")) != ""))
    return rest.select(F.col("_metadata.file_path").alias("file"), "value")


def parsed(text: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` from the JSON text in ``value``; other columns of ``text`` but ``value`` stay in front."""
    others = [c for c in text.columns if c != "value"]
    fields = text.select(*others, F.from_json("value", _as_text(schema)).alias("_json"))
    return fields.select(*others, *[_typed(F.col("_json")[f.name], f.dataType).alias(f.name) for f in schema])


def _texts(spark: SparkSession, path: str, multi_line: bool) -> DataFrame | None:
    return _if_present(lambda: spark.read.text(path, wholetext=multi_line))


def _is_object(text: Column) -> Column:
    return F.json_object_keys(text).isNotNull()


def _as_text(kind: T.DataType) -> T.DataType:
    """The same layout with text in place of numbers, times and booleans."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_text(kind.elementType))
    return kind if isinstance(kind, T.MapType) else T.StringType()


def _typed(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = [_typed(value[f.name], f.dataType).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _typed(x, kind.elementType))
    if isinstance(kind, (T.IntegerType, T.LongType)):
        name = kind.simpleString()
        return F.coalesce(value.try_cast(name), value.try_cast("double").try_cast(name))
    if isinstance(kind, T.TimestampType):
        return S.parse_iso(value)
    return value if isinstance(kind, (T.StringType, T.MapType)) else value.try_cast(kind.simpleString())


def _if_present(read: Callable[[], DataFrame]) -> DataFrame | None:
    """Result of ``read``, or nothing if its path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def read_alerts(spark: SparkSession, path: str, as_of: Column | None = None) -> DataFrame:
    """Stored alerts with ``ts``; bad or missing times become ``as_of`` (null if none is given)."""
    lines = json_lines(spark, path, schemas.ALERT_JSON)
    return lines.withColumn("ts", S.parse_iso(F.col("timestamp"), as_of)).drop("timestamp")


def read_flow_events(spark: SparkSession, path: str) -> DataFrame:
    """Normalised events, each with its own ``event_id``, see ``event_keys``."""
    text = _texts(spark, path, False)
    if text is None:
        return flows.event_fields(spark.createDataFrame([], schemas.EVENT_JSON)).where("t_us is not null")
    rows = parsed(text.where(_is_object(F.col("value"))).select("value"), schemas.EVENT_JSON)
    return flows.event_fields(event_keys(rows.where(flows.event_time().isNotNull())))


def rejected_events(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, reason) of the lines ``read_flow_events`` leaves out: malformed ones and events without a time."""
    text = _texts(spark, path, False)
    if text is None:
        return spark.createDataFrame([], "file string, value string, reason string")
    lines = text.select(F.col("_metadata.file_path").alias("file"), "value", F.col("value").alias("line"))
    timeless = parsed(lines.where(_is_object(F.col("line"))), schemas.EVENT_JSON).where(flows.event_time().isNull())
    return (
        rejected_lines(spark, path)
        .withColumn("reason", F.lit("malformed"))
        .unionByName(timeless.select("file", F.col("line").alias("value"), F.lit("no time").alias("reason")))
    )


#: Equal events without an id that are numbered by one row of a task.
EQUAL_EVENTS = 4096


def event_keys(events: DataFrame) -> DataFrame:
    """One row for each event, with an ``event_id`` that stays the same whatever arrives later.

    An event without an id is named by its content and its rank among the events of equal content. Equal events differ
    in nothing but that rank, so those that arrive later take the higher ranks and no earlier name changes, whichever
    file or split a row comes from. A row with an id that is equal to another in all columns has been delivered twice
    and counts once.

    Rows of equal content are counted before they are shuffled, and many of them are written out again by many tasks.
    """
    copies = F.when(F.col("event_id").isNotNull(), F.lit(1).cast("long")).otherwise(F.count(F.lit(1)))
    ranked = _ranked(events.groupBy(*events.columns).agg(copies.alias("_n")))
    return ranked.withColumn("event_id", F.coalesce("event_id", flows.content_id(events.columns, F.col("_rank")))).drop("_rank")


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``row_no``, the rank of a row among equal ones, from 0: with it in the key a sample spreads over equal rows.

    It follows from the content alone, so neither splits nor the order of a scan change a sample. Equal rows are counted
    before they are shuffled, and many of them are written out again by many tasks.
    """
    return _ranked(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))).withColumnRenamed("_rank", "row_no")


def _ranked(counted: DataFrame) -> DataFrame:
    """Every row ``_n`` times, with ``_rank`` from 0 in place of ``_n``."""
    numbers = lambda first: F.explode(F.sequence(first, F.least(first + (EQUAL_EVENTS - 1), F.col("_n") - 1)))
    few = counted.where(F.col("_n") <= EQUAL_EVENTS).withColumn("_rank", numbers(F.lit(0).cast("long")))
    many = (
        counted.where(F.col("_n") > EQUAL_EVENTS)
        .withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(EQUAL_EVENTS).cast("long"))))
        .repartition("_first")
        .withColumn("_rank", numbers(F.col("_first")))
        .drop("_first")
    )
    return few.unionByName(many).drop("_n")


def stream_flow_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events as a stream; malformed lines are left out. Events without a time stay in, for the table of late rows.

    An event without an id has the name that ``event_keys`` gives to the first event of its content. The stream jobs
    give equal events their ranks, and merge events delivered twice, when the watermark has passed them.
    """
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = parsed(reader.text(path).where(_is_object(F.col("value"))).select("value"), schemas.EVENT_JSON)
    name = flows.content_id(rows.columns, F.lit(0).cast("long"))
    return flows.event_fields(rows.withColumn("event_id", F.coalesce("event_id", name)))


def read_flow_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Flow training rows: only the needed columns, by the header of each file; what is no number becomes 0.

    Files are read in one scan for each order of columns that occurs. Equal rows are told apart by ``numbered``.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    first = reader.text(list(paths)).where("_metadata.file_block_start = 0")
    lines = first.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("header"), F.monotonically_increasing_id().alias("n"))
    # The least number of each file, then its line: an aggregate of the lines themselves would sort all of a split.
    headers = lines.join(F.broadcast(lines.groupBy("file").agg(F.min("n").alias("n")).select("n")), "n").select("file", "header")
    layouts = [r["header"] for r in headers.select("header").distinct().collect()]  # column orders, not files
    if len(layouts) < 2:
        return _flow_csv(reader.option("header", True).csv(list(paths)))
    parts = [
        _flow_csv(spark.read.option("header", True).csv([r["file"] for r in headers.where(F.col("header") == h).collect()]))
        for h in layouts
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _flow_csv(lines: DataFrame) -> DataFrame:
    columns = [F.col(c) if c in lines.columns else F.lit(None).cast("string").alias(c) for c in schemas.FLOW_CSV_COLUMNS]
    rows = lines.select(
        *columns,
        F.col("_metadata.file_path").alias("source_file"),
    )
    return numeric_flows(rows)


def numeric_flows(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: S.safe_double(F.col(c), 0.0) for c in schemas.FLOW_CSV_COLUMNS})


def _is_file(spark: SparkSession, path: str) -> bool:
    """Asked of the file system that holds the path, as Spark's own readers do."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(place) and system.getFileStatus(place).isFile()


def read_rules(
    spark: SparkSession, path: str, engine: str = "snort", tier: int = 2, pattern: str = "*.rules", **options
) -> DataFrame:
    """Rules from any single file or from all ``*.rules`` files below a folder, ordered by file and line.

    A missing path gives no rules.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if not _is_file(spark, path):
        reader = reader.option("pathGlobFilter", pattern)
    text = _if_present(lambda: reader.text(path))
    if text is None:
        lines = spark.createDataFrame([], f"ord {rule_ops.ORDER_TYPE}, line string")
    else:
        lines = text.select(
            F.col("value").alias("line"),
            rule_ops.rule_order(
                tier,
                F.col("_metadata.file_path"),
                F.col("_metadata.file_block_start"),
                # Rows of one split lie in one partition, so this grows with the line within the split.
                F.monotonically_increasing_id(),
            ).alias("ord"),
        )
    return rule_ops.parse_rules(lines, engine, **options)


def read_ioc_text(spark: SparkSession, path: str) -> DataFrame:
    text = _if_present(lambda: spark.read.text(path))
    return indicators_in_text(spark.createDataFrame([], "value string") if text is None else text, "value")


def read_pulses(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Distinct valid IPv4 indicators of stored pulse pages, one per line or one per file."""
    pages = json_lines(spark, path, schemas.PULSE_PAGE, multi_line)
    return (
        pages.select(F.explode("results").alias("r"))
        .select(F.explode("r.indicators").alias("i"))
        .where(F.col("i.type") == "IPv4")
        .select(S.strip(F.col("i.indicator")).alias("ip"))
        .where(S.valid_ipv4(F.col("ip")))
        .distinct()
    )


def read_feed_abuse(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Address reputation feed: field ``data`` holds the entries."""
    entries = json_lines(spark, path, schemas.ABUSE_FEED, multi_line).select(F.explode("data").alias("e"))
    return entries.select(
        S.strip(F.col("e.ipAddress")).alias("ip"),
        F.coalesce("e.abuseConfidenceScore", F.lit(0)).alias("abuse_score"),
        F.coalesce("e.countryCode", F.lit("")).alias("country"),
        F.coalesce("e.isp", F.lit("")).alias("isp"),
        F.coalesce("e.lastReportedAt", F.lit("")).alias("last_report"),
        F.coalesce("e.totalReports", F.lit(0)).alias("total_reports"),
    ).where(F.coalesce("ip", F.lit("")) != "")


def read_feed_c2(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Command-and-control feed: a top-level array (one whole document with ``multi_line``) or JSON lines.

    Entries are converted field by field like other lines. What is no entry is in ``rejected_c2``.
    """
    entries = _c2_entries(spark, path, multi_line)
    if entries is None:
        rows = spark.createDataFrame([], schemas.C2_FEED)
    else:
        rows = parsed(entries.where(_is_object(F.col("value"))).select("value"), schemas.C2_FEED)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select(
        S.strip(F.col("ip_address")).alias("ip"),
        *[text(c) for c in ("malware", "status", "country", "first_seen", "last_online", "port")],
    ).where(F.coalesce("ip", F.lit("")) != "")


def rejected_c2(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(file, value): documents of the feed that are neither array nor object, and elements of arrays that are no object."""
    entries = _c2_entries(spark, path, multi_line)
    if entries is None:
        return spark.createDataFrame([], "file string, value string")
    return entries.where(~F.coalesce(_is_object(F.col("value")), F.lit(False)) & (S.strip(F.col("value")) != ""))


def _c2_entries(spark: SparkSession, path: str, multi_line: bool) -> DataFrame | None:
    """(file, value): the elements of top-level arrays as text, all other lines or documents as they are."""
    text = _texts(spark, path, multi_line)
    if text is None:
        return None
    elements = F.when(F.json_array_length("value").isNotNull(), F.from_json("value", "array<string>"))
    value = F.explode(F.coalesce(elements, F.array("value")))
    return text.select(F.col("_metadata.file_path").alias("file"), value.alias("value"))


def read_block_log(spark: SparkSession, path: str, parts: list[int] | None = None) -> DataFrame:
    """Rows of the block log; with ``parts`` only those folders are read."""
    text = _texts(spark, path, False)
    if text is None:
        rows = spark.createDataFrame([], schemas.BLOCK_LOG)
    else:
        if parts is not None and "part" in text.columns:
            text = text.where(F.col("part").isin(parts))
        rows = parsed(text.where(_is_object(F.col("value"))).select("value"), schemas.BLOCK_LOG)
    return rows.withColumn("ts", S.parse_iso(F.col("timestamp"))).drop("timestamp")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.FEEDBACK_JSON)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Stored analyst decisions; a missing path gives none."""
    rows = _if_present(lambda: spark.read.parquet(path))
    return spark.createDataFrame([], schemas.DECISION) if rows is None else rows


def read_current_alerts(spark: SparkSession, alerts_path: str, decisions_path: str) -> DataFrame:
    """Stored alerts as the stored decisions have left them."""
    return decisions.apply_decisions(read_alerts(spark, alerts_path), read_decisions(spark, decisions_path))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.RUN)
