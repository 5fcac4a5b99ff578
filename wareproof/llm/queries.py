"""Registered queries of this package: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from wareproof.llm import (
    chosen_path,
    lang_id,
    line_runs,
    mixing,
    mtree,
    pii,
    prefix_trie,
    quality,
    sampling,
    simple8b,
    token_counts,
    toxicity,
    whitening,
)
from wareproof.llm.common import ship, table
from wareproof.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(run)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = shipped
    return shipped


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    simple8b.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return simple8b.read_digests(spark, path)


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


ORACLES["op6_quality"] = quality.SQL


@query
def op10_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sampled_pieces(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), digests=True)


@query
def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_runs.without_repeats(docs)


ORACLES["op8_line_runs"] = line_runs.SQL


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op7_near_duplicates"] = chosen_path.SQL


@query
def op5_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op5_mtree"] = mtree.SQL


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_id(table(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op11_prefix_trie"] = prefix_trie.SQL


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))
