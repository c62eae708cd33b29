"""A corpus pipeline: drop what the classifier rejects, keep one of each near-duplicate group, cut repeated passages, pack.

In every stage a null text is empty and stays in its row as it is, texts of any length are read whole, and an empty
table gives an empty one. All columns of the input pass through the first three stages, whatever their names; the
operators' own columns never reach the output. Rows with one id are one document wherever rows go by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import near_dedup, packing, quality, repeats
from spanlake.llm.common import saved, table
from spanlake.llm.queries import CAPACITY, END_ID, THRESHOLD, tokenizer_path

#: Passages that go: runs of fifty words or more, made of strings of 200 bytes that occur elsewhere (fifty words of three letters).
PASSAGE_BYTES, PASSAGE_GRAM, PASSAGE_WORDS = 200, 64, 50


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from this stage's own input.

    Each row is judged by its own text, so repeated rows stay or go together; a null text is judged as the empty one. With
    no labelled row, or one kind of label only, the trees are a constant.
    """
    trees = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, trees, THRESHOLD).filter("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, similarity 0.8 or more.

    The least id of a group stays. Null, empty and blank texts are like nothing and stay, and so do rows without an id. Rows with
    one id go together, if a like document has a lesser id; repeated rows of one id stay as they are.
    """
    found = near_dedup.groups(docs, 5, 80, 100).filter("not kept").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of fifty words or more that occur elsewhere; n_chars is counted anew.

    All places of a passage go, the first one too. Rows that lose nothing keep their text, null texts become empty; a row whose
    whole text goes stays with the empty text. Bytes of a character that a passage cuts go with it.
    """
    cut = repeats.remove(docs, length=PASSAGE_BYTES, out="__left", as_text=True, gram=PASSAGE_GRAM, least_words=PASSAGE_WORDS)
    return cut.withColumn("text", F.col("__left")).withColumn("n_chars", F.length("__left").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences; an empty or null text has its end token alone, and every row its own pieces."""
    return packing.pack(docs, tokenizer_path(), END_ID, CAPACITY)


STAGES = [("quality classifier", quality_filter), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages), ("best-fit packing", packed)]

#: Tree ensembles, suffix order and tokenization are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = saved(docs, f"stage{k}")
    return docs
