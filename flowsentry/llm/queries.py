"""The catalogue of this subpackage: one query for each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.llm import align, bpe, common, katz, linededup, packing, pages, permutation, preferences, repair, secrets, simhash, topk, toxicity
from flowsentry.plans.catalog import Catalog


OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)::bigint) as w from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10
"""


OP11_SQL = r"""
with d as (
  select row_number() over () as place, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select place, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from d),
k as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct place) >= 10)
select any_value(k.doc_id) as doc_id, count(*)::bigint as n_lines, count(f.key)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where f.key is null), '')) as kept_sha256
from k left join f on k.key = f.key group by place
"""


def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are the chosen and the rejected side of pair k."""
    conv = F.col("conv_id")
    return preferences.format_preferences(
        common.table(spark, sf_dir, "conversations"), F.floor(conv / 2).cast("long"), F.pmod(conv, F.lit(2))
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(common.table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, best=10)


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return katz.katz_scores(docs, common.remainder("doc_id", 7) == 2).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, best=20)


def op6_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(common.table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "host", "path"
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity_scores(docs, common.table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted", "neighbours", "evidence"
    )


#: Score from which a document counts as toxic.
TOXIC_FROM = 0.3


def toxicity_index(docs: DataFrame, labels: DataFrame) -> toxicity.Index | None:
    return toxicity.fit(docs, labels, common.remainder("doc_id", 4) != 2)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity.score(docs, toxicity_index(docs, labels)).select(
        "doc_id",
        (common.remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
        "neighbours",
        "evidence",
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"), width=4, distance=4)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.decode(bpe.encode(common.table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(common.table(spark, sf_dir, "documents"), least_documents=10, least_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = common.table(spark, sf_dir, "conversations")
    return repair.repair_report(conversations, repair.damage(conversations))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.link_statistics(common.table(spark, sf_dir, "documents"))


def register(catalog: Catalog) -> None:
    catalog.add("op1_preferences", preferences.ORACLE)(op1_preferences)
    catalog.add("op2_secret_scan")(op2_secret_scan)
    catalog.add("op3_exact_top_k", OP3_SQL)(op3_exact_top_k)
    catalog.add("op4_katz")(op4_katz)
    catalog.add("op5_permutation_index")(op5_permutation_index)
    catalog.add("op6_host_paths")(op6_host_paths)
    catalog.add("op7_toxicity")(op7_toxicity)
    catalog.add("op8_packing")(op8_packing)
    catalog.add("op9_simhash")(op9_simhash)
    catalog.add("op10_bpe")(op10_bpe)
    catalog.add("op11_line_dedup", OP11_SQL)(op11_line_dedup)
    catalog.add("op12_conversation_repair")(op12_conversation_repair)
    catalog.add("op13_token_alignment")(op13_token_alignment)
