"""The thin queries over the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, chroma, dialogue, divergence, hmm, html_text, near_dedup, oracles, packing, quality, repeats, secret_scan, token_store, vectors
from .common import table

END_ID = 2
CAPACITY = 1024
REPEAT_BYTES = 400
THRESHOLD = 0.3


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary lies; a parameter of every operator that needs one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"), 3, 85, 100)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID, CAPACITY)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), length=REPEAT_BYTES)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables have no audio: a recording is made of each vector of ``embeddings``."""
    return chroma.report(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", chroma.melody)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, trees, THRESHOLD).drop("text")


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.groups(table(spark, sf_dir, "embeddings"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = token_store.write(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return token_store.read(files)


def op11_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(dialogue.damaged(table(spark, sf_dir, "conversations")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.common_words(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_html": op1_html,
    "op2_hmm": op2_hmm,
    "op3_near_dedup": op3_near_dedup,
    "op4_packing": op4_packing,
    "op5_repeats": op5_repeats,
    "op6_chroma": op6_chroma,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_vectors": op9_vectors,
    "op10_tokens": op10_tokens,
    "op11_dialogue": op11_dialogue,
    "op12_divergence": op12_divergence,
    "op13_secrets": op13_secrets,
    "pipeline": pipeline,
}
ORACLE_SQL: dict[str, str] = {"op11_dialogue": oracles.DIALOGUE, "op12_divergence": oracles.DIVERGENCE}
