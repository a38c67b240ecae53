"""Token counts under a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens.

The best segmentation's score at a character depends only on what stands before it. Distinct pre-tokens are inserted into a
trie that a task keeps from batch to batch: a node holds the forward score of its prefix and the number of pieces on the best
path to it, computed once for all pre-tokens that share the prefix. The number at the end of each pre-token is stored by
itself, and a text's count is the sum over its pre-tokens.

Defined cases: null and empty texts have no tokens; of segmentations with equal scores the one whose last piece is
shortest counts; a character without a piece counts its UTF-8 bytes; rows that repeat are counted alike; a trie that has
grown full is emptied before the next batch, so memory is bounded by it and by the largest batch or text, and results are not
affected; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pricewright.llm.pieces import DEFAULT_MODEL, Pieces, pre_tokens
from pricewright.llm.scratch import blocks

#: Nodes of the trie that a task keeps.
NODES = 1_000_000
#: Bytes of text taken up at once.
BLOCK = 500_000


class Trie:
    """Distinct pre-tokens with the forward scores of their prefixes and the piece counts at their ends."""

    def __init__(self, pieces: Pieces):
        self.tails, self.unknown = pieces.tails, pieces.unknown
        #: the child of a node by one more character, as one number
        self.below: dict[int, int] = {}
        self.best, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def insert(self, token: str) -> None:
        """Walk the token's characters, add the nodes that are missing, and store the count at its end."""
        below, best, count = self.below, self.best, self.count
        path, at = [0], 0
        for end, c in enumerate(token, 1):
            key = at << 21 | ord(c)
            node = below.get(key)
            if node is None:
                node = below[key] = len(best)
                self._score(token, end, path)
            path.append(node)
            at = node
        self.terminal[token] = count[at]

    def _score(self, token: str, end: int, path: list[int]) -> None:
        """Append the forward score of the prefix that ends there, from those of the nodes on the path."""
        tails, best, count = self.tails, self.best, self.count
        top, pieces, start = -1e300, 0, end - 1
        score = tails.get(token[start], False)
        if score is None or score is False:
            top = best[path[start]] + self.unknown
            pieces = count[path[start]] + len(token[start].encode("utf-8", "surrogatepass"))
        while score is not False:
            if score is not None and best[path[start]] + score > top:
                top, pieces = best[path[start]] + score, count[path[start]] + 1
            start -= 1
            if start < 0:
                break
            score = tails.get(token[start:end], False)
        best.append(top)
        count.append(pieces)


def token_counts(docs: DataFrame, model: str = DEFAULT_MODEL, nodes: int = NODES) -> DataFrame:
    """doc_id, n_pretokens and n_tokens for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in blocks(batches, "text", BLOCK):
            if len(trie.best) > nodes:
                trie = Trie(shared.value)
            known, totals, numbers = trie.terminal, [], []
            for text in batch.column(1).to_pylist():
                tokens = pre_tokens(text or "")
                for token in tokens:
                    if token not in known:
                        trie.insert(token)
                numbers.append(len(tokens))
                totals.append(sum(map(known.__getitem__, tokens)))
            columns = [batch.column(0), pa.array(numbers, pa.int64()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
