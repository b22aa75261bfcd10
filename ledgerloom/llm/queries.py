"""The registered queries of this package, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, langid, licenses, mixing, ngram_join, packing, pieces, quality, secrets, spelling, urls, vectors
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op4_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    site = F.col("rule").isin([r.name for r in urls.SITE_RULES])
    return urls.judge(pages).select("page_id", "host", "path", F.when(site, F.col("rule")).alias("rule"), "verdict", F.when(~site, F.col("rule")).alias("pattern"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: x["name"]), ",").alias("licenses"),
        F.array_max(F.transform("licenses", lambda x: x["percent"])).alias("best_percent"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = chat.format_chats(chat.with_probe(table(spark, sf_dir, "conversations")))
    return chat.read_back(formatted).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        "doc.doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_curve_packing,
        op2_quality_divergence,
        op3_ngram_jaccard,
        op4_embedding_lsh,
        op5_url_rules,
        op6_source_mix,
        op7_license_scan,
        op8_secret_scan,
        op9_chat_format,
        op10_language_id,
        op11_sentencepiece,
        op12_token_alignment,
        op13_spelling_variants,
    )
}
