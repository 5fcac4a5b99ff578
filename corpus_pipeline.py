"""A corpus on its way to training: five stages over ``documents``, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it again
for the next. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareproof.llm import chosen_path, lang_id, line_runs, mixing, sampling
from wareproof.llm.common import ship, table, written
from wareproof.llm.queries import tokenizer_file

#: Documents whose language is less sure than this go; with four languages chance alone gives a quarter.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, without a text, or of no language that the model is sure of, go. Where there is no labelled row to
    learn from, all documents with a letter stay."""
    ship(spark)
    model = lang_id.fit(lang_id.learning_rows(docs))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = lang_id.predicted(docs, model, names=("__lang", "__score"))
    return found.filter((F.col("__lang") != lang_id.UNKNOWN) & (F.col("__score") >= MIN_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines are cut out of texts; documents that lose all their lines go."""
    ship(spark)
    freed = line_runs.without_repeats(docs, names=("__n_lines", "__n_removed"))
    freed = freed.filter((F.col("__n_removed") == 0) | (F.col("__n_removed") < F.col("__n_lines")))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("__n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        freed = freed.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return freed.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays. Rows that share an id stay or go each by its text;
    rows without one stay."""
    ship(spark)
    dropped = chosen_path.judged_rows(docs).filter("NOT kept").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("doc_id", "text") == F.col("__h"))
    return docs.join(written(dropped, "dropped"), same, "left_anti").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words: of a part of a document a draw, hashed from its id and
    text, makes a whole one or none, in proportion."""
    ship(spark)
    mixed = mixing.mix(docs).filter("size > 0")
    draw = F.pmod(F.xxhash64(F.lit("copy"), "h"), F.lit(1 << 30)) / (1 << 30)
    copies = mixed.select("doc_id", "h", F.floor(F.col("taken") / F.col("size") + draw).alias("copies"))
    copies = copies.groupBy("doc_id", "h").agg(F.max("copies").cast("int").alias("__copies")).filter("__copies > 0")
    copies = written(copies, "copies").withColumnsRenamed({"doc_id": "__id", "h": "__h"})
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("doc_id", "text") == F.col("__h"))
    return docs.join(copies, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``piece_ids``, a sampled segmentation that decodes to the text."""
    ship(spark)
    return sampling.sampled_pieces(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

# Hashed n-grams, seeded draws and sampled pieces have no SQL counterpart; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
