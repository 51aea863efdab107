"""Token counts of texts under a unigram model, by a trie of distinct pre-tokens.

A pre-token is a run of characters other than white space, with the vocabulary's word mark
before it. Each worker walks its texts, inserts pre-tokens that it has not met into a trie
and computes, for each new node only, the best forward score of the prefix (and the pieces
on that path) from the scores of the nodes above it; a pre-token's terminal node stores its
count. Prefixes that pre-tokens share are thus scored once. The trie is rebuilt when it
exceeds a bound, which costs time but changes no count, so memory is bounded; as every
partition is counted by itself, nothing is shuffled.

The vocabulary is a public SentencePiece file. Its pieces are ordered by rank, not scored by
probability, so a piece's score is a Zipf law of its rank: -log(rank + 10). A character that
no piece covers costs its UTF-8 bytes, one token each.

Defined results: null and empty texts count 0; repeated rows are counted each; extra columns
of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD_MARK = "▁"
RANK_SHIFT = 10.0
#: Score of one byte of a character without a piece; below that of any piece.
BYTE_SCORE = -20.0
#: Most nodes of a task's trie (about 300 bytes each).
MAX_NODES = 1_000_000
#: Deepest node that is kept; the rest of a longer pre-token is scored without being stored.
MAX_DEPTH = 100


def piece_scores(model_path: str) -> dict[str, float]:
    """Piece -> score, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -math.log(rank + RANK_SHIFT) for rank, i in enumerate(usable)}


class Trie:
    """Nodes by prefix; of each, the best score of the prefix and the number of pieces on that path."""

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES):
        self.scores, self.max_nodes = scores, max_nodes
        self.longest = max(map(len, scores), default=0)
        self.clear()

    def clear(self) -> None:
        self.nodes: dict[str, tuple[float, int]] = {"": (0.0, 0)}
        self.terminal: dict[str, int] = {}

    def count(self, token: str) -> int:
        """Pieces of the best segmentation; of equal ones, that with the longest last piece."""
        found = self.terminal.get(token)
        if found is not None:
            return found
        nodes, scores, longest = self.nodes, self.scores, self.longest
        if len(nodes) > self.max_nodes:
            self.clear()
            nodes = self.nodes
        end = min(len(token), MAX_DEPTH)
        while token[:end] not in nodes:
            end -= 1
        path = [nodes[token[:k]] for k in range(max(0, end - longest), end + 1)]  # the last ``longest`` prefixes
        for k in range(end + 1, len(token) + 1):
            first = k - len(path)  # length of the prefix that path[0] stands for
            best, pieces = -math.inf, 0
            for j, (score, n) in enumerate(path, first):
                s = scores.get(token[j:k])
                if s is not None and score + s > best:
                    best, pieces = score + s, n + 1
            score, n = path[-1]
            if token[k - 1] not in scores:  # bytes stand in only where no piece covers the character
                width = len(token[k - 1].encode("utf-8", "surrogatepass"))
                if score + width * BYTE_SCORE > best:
                    best, pieces = score + width * BYTE_SCORE, n + width
            if k <= MAX_DEPTH:
                nodes[token[:k]] = (best, pieces)
            path.append((best, pieces))
            if len(path) > longest:
                path.pop(0)
        n = path[-1][1]
        if len(token) <= MAX_DEPTH:
            self.terminal[token] = n
        return n


def count_tokens(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_pretokens, n_tokens of every row."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = common.worker_state(f"trie of {model_path}", lambda: Trie(piece_scores(model_path)))
        for batch in batches:
            n_words, n_tokens = [], []
            for t in batch["text"]:
                words = t.split() if t else []
                n_words.append(len(words))
                n_tokens.append(sum(trie.count(WORD_MARK + w) for w in words))
            yield pd.DataFrame({"key": batch["key"], "n_pretokens": n_words, "n_tokens": n_tokens})

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    counted = rows.transform(common.in_batches, task, "key string, n_pretokens long, n_tokens long")
    return counted.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "n_pretokens", "n_tokens")
