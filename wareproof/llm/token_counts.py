"""Operator 3: token counts of documents under a unigram model, by dynamic programming over a trie.

The distinct pre-tokens of a batch of documents are put in a trie. The best score of every prefix is computed once,
from those of the prefixes a piece shorter, and with it the number of tokens of the best segmentation;
terminal nodes hold the counts that documents add up. Nothing is shuffled: a batch needs only its own trie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareproof.llm.common import parts, sums_of
from wareproof.llm.pieces import lattice, pretokens, vocabulary

BATCH_BYTES = 6_000_000
SCHEMA = "doc_id bigint, n_pretokens bigint, n_tokens bigint"


def counts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens and tokens of every text."""
    split = [pretokens(text or "") for text in texts]
    held = np.array([len(one) for one in split], dtype=np.int64)
    at, words = pd.factorize(np.array([w for one in split for w in one], dtype=object))
    trie = lattice(list(words), vocabulary(path), best=True)
    per_word = trie.count[trie.terminal] if len(words) else np.zeros(0, dtype=np.int64)
    return held, sums_of(per_word[at], held)


def token_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every row of ``docs``.

    ``model`` is the path of a SentencePiece model. Null and empty texts have no tokens; rows that
    share an id, or a null one, each give a row; other columns are ignored; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", BATCH_BYTES):
            held, tokens = counts(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(held), pa.array(tokens)], ["doc_id", "n_pretokens", "n_tokens"]
            )

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
