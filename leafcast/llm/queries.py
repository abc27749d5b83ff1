"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafcast.llm import chat_format, merkle, pii, quality_fm
from leafcast.llm.bond import hard_negatives
from leafcast.llm.bpe_count import token_counts
from leafcast.llm.decontaminate import find_contamination
from leafcast.llm.forced_bpe import decode_ids, encode_texts
from leafcast.llm.jaccard_join import jaccard_components
from leafcast.llm.line_dedup import deduplicate
from leafcast.llm.packing import pack_documents
from leafcast.llm.sharding import assign_shards
from leafcast.llm.winnow import edit_neighbours
from leafcast.session import materialize
from leafcast.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: A document with more tokens than this is over the context limit.
TOKEN_LIMIT = 4096


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


#: Text of both turns of the control conversation, number -7.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


@_query
def op1_schema_fingerprint_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    records = rows.union(control).select(F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"))
    turns = chat_format.canonical_turns(records, "record").where(F.col("layout").isNotNull())
    chats = chat_format.format_chats(turns)
    back = chats.withColumn("back", chat_format.read_back(F.col("formatted"), F.col("turns")))
    all_text = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss_text = F.array_join(F.transform(F.filter("back", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id", F.size("back").cast("bigint").alias("n_turns"), F.sha2(all_text, 256).alias("turns_sha256"),
        F.length(loss_text).cast("bigint").alias("loss_chars"), F.sha2(loss_text, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@_query
def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@_query
def op6_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_neighbours(read_table(spark, sf_dir, "documents", "doc_id", "text"))


#: Words of the shortest unit that counts by itself: shorter ones repeat by chance in clean documents.
LEAST_UNIT = 8


@_query
def op7_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(read_table(spark, sf_dir, "documents", "doc_id", "text"), min_words=LEAST_UNIT)
    listed = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.withColumn("removed", listed)


#: Bytes that a shard of the query may hold.
SHARD_BYTES = 1 << 20


@_query
def op8_extendible_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_table(spark, sf_dir, "documents", "doc_id", "text"), SHARD_BYTES)


@_query
def op9_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    counts = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@_query
def op3_vertical_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return jaccard_components(docs, n=3, threshold=(90, 100)).select("doc_id", "n_shingles", "component_id")


@_query
def op4_factorisation_machine_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality_fm.train(docs, labels.where(~quality_fm.held_out(F.col("doc_id"))), metadata=("n_chars",))
    scored = quality_fm.score(docs, model, metadata=("n_chars",))
    return scored.select(
        "doc_id", quality_fm.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@_query
def op5_positional_index_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    items = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    found = find_contamination(docs, items, size=10, slop=2)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "n_near_items",
    )


def _listed(spans):
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in pii.KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"], s["end"])), ",")


@_query
def op10_candidate_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda no: F.size(F.filter("base_spans", lambda s: s["kind_no"] == no)).cast("bigint")
    return found.select(
        "doc_id", *(count(no).alias(f"n_{k}") for no, k in enumerate(pii.KINDS)),
        F.sha2(_listed("base_spans"), 256).alias("base_sha256"), _listed("spans").alias("spans"),
    )


@_query
def op11_bond_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0, n_positives=5, n_negatives=3, low=(50, 100), high=(95, 100))


@_query
def op12_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = decode_ids(encode_texts(read_table(spark, sf_dir, "documents", "doc_id", "text"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op13_incremental_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    docs = read_table(spark, sf_dir, "documents", *fields)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = [F.try_add("n_chars", F.lit(1)) if f == "n_chars" else F.col(f) for f in fields]
    leaves = docs.select(
        F.col("lang").alias("grp"), "doc_id", F.unhex(merkle.leaf_digest(*(F.col(f) for f in fields))).alias("digest"),
        F.when(tampered, F.unhex(merkle.leaf_digest(*more))).alias("claimed"),
    )
    found = merkle.manifest(materialize(leaves, "leaves"))
    claimed = merkle.hexed(F.coalesce("claimed", "digest"))
    proven = found.select(
        "doc_id", merkle.hexed(F.col("digest")).alias("leaf"), merkle.hexed(F.col("subroot")).alias("subroot"), merkle.hexed(F.col("root")).alias("root"),
        F.sha2(F.array_join(merkle.sibling_digests(F.col("steps")), ""), 256).alias("proof_sha256"), merkle.fold(claimed, F.col("steps")).alias("folded_root"),
    )
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))
