"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, embdedup, langid, licenses, merkle, packing, pii, quality, simhash, substring, whitening


def vocabulary() -> str:
    """The public vocabulary file that the token queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.95)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_known", "sequence", F.array_join("licenses", ",").alias("licenses"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=4, shingle=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), vocabulary()), vocabulary())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )


def op7_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(_table(spark, sf_dir, "documents"))
    of_kind = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select(
        "doc_id",
        *counts,
        F.sha2(pii.rendered(F.col("base")), 256).alias("base_sha256"),
        pii.rendered(F.concat("base", "ids")).alias("spans"),
        F.size("ids").cast("long").alias("n_id"),
    )


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary(), window=4096, end_id=2)


def _held_out(remainder: int, modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus == remainder


def op5_quality_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(~_held_out(1, 3)).select("doc_id", F.col("quality").alias("label"))
    out = quality.score(docs, quality.fit(labels, docs))
    return out.select("doc_id", _held_out(1, 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs.where(~_held_out(2, 4)).select("doc_id", "text", "lang")))
    return out.select("doc_id", _held_out(2, 4).alias("held_out"), "lang_pred", "score")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    out = whitening.whiten(rows, whitening.fit(rows)).select("*", F.posexplode("whitened").alias("at", "value"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"), F.get("explained", F.col("at")).alias("explained"), "identity_error")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document (by crc32) is folded from the leaf of its lower-cased text."""
    docs, upper = _table(spark, sf_dir, "documents"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fields = ["doc_id", "source", "lang", "n_chars"]
    tampered = F.when(_held_out(0, 5), merkle.leaf(*[F.col(f) for f in fields], F.translate("text", upper, upper.lower())))
    out = merkle.manifest(docs, [*fields, "text"], carry={"tampered": tampered})
    out = out.withColumns({"proof_sha256": F.sha2(merkle.proof_text(F.col("path")), 256), "folded_root": merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings."""
    probe = spark.range(2).select(
        F.lit(chat.PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.PROBE_TEXT).alias("text")
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = chat.read_back(chat.format_turns(rows, chat.text_parts(F.col("text"))))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_quality_voting": op5_quality_voting,
    "op6_bpe_roundtrip": op6_bpe_roundtrip,
    "op7_pii_bootstrap": op7_pii_bootstrap,
    "op8_retrieval_packing": op8_retrieval_packing,
    "op9_ann_search": op9_ann_search,
    "op10_language_id": op10_language_id,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_chat_parts": op13_chat_parts,
}

ORACLE_SQL: dict[str, str] = {"op3_license_scan": licenses.oracle_sql(), "op12_merkle_manifest": merkle.oracle_sql(), "op13_chat_parts": chat.oracle_sql()}
