"""The registered query of each operator, and SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, decontaminate, exact_dedup, fim, minhash, mixing, periodic, span_dedup, suffix_dedup, topk, toxicity, warc
from .common import stage_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_exact_dedup", exact_dedup.ORACLE)
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.classify(table(spark, sf_dir, "documents"), exact_dedup.new_index(spark))


@query("op2_source_mixing", mixing.ORACLE)
def op2_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_chat_format", chat.ORACLE)
def op7_chat_format(spark, sf_dir):
    marks = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(turns))


@query("op8_bpe_codec")
def op8_bpe_codec(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


@query("op9_warc_archive", warc.ORACLE)
def op9_warc_archive(spark, sf_dir):
    uri = stage_path(spark, "warc")
    manifest = warc.write(table(spark, sf_dir, "pages"), uri)
    return warc.read(spark, uri, manifest, payloads=False).drop("url", "payload")


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


@query("op10_sentence_spans")
def op10_sentence_spans(spark, sf_dir):
    return span_dedup.remove_repeated(table(spark, sf_dir, "documents"))


@query("op5_dual_tree_topk", topk.ORACLE)
def op5_dual_tree_topk(spark, sf_dir):
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, 5)


@query("op4_minhash_near_dedup")
def op4_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Options(words=4))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeated(table(spark, sf_dir, "documents"), with_bytes=False)


@query("op11_benchmark_decontamination", decontaminate.ORACLE)
def op11_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    return periodic.digests(periodic.repeated_tails(table(spark, sf_dir, "documents")))


@query("op13_fill_in_middle", fim.ORACLE)
def op13_fill_in_middle(spark, sf_dir):
    return fim.digests(table(spark, sf_dir, "documents"))
