"""Token counts of a unigram model by dynamic programming over a trie of pre-tokens.

Pre-tokens are the runs of non-space characters, each with the word mark in front. A task inserts each distinct pre-token
into a trie once; a node holds the best score and token count of its prefix, so a shared prefix is scored once and a
terminal's count serves every later occurrence. Nothing is shuffled: a task's trie covers its own partition, and is
dropped when it reaches `most_nodes`, so memory is bounded whatever the number of distinct words.

The vocabulary is a parameter: piece -> log score. `rank_scores` gives a public vocabulary, ordered by rank, Zipf
scores. A character in no piece costs one token a byte, each with the score `unknown`. Equal scores go to fewer tokens.

Null, empty and blank texts have no pre-tokens and no tokens; rows are counted one by one, repeated or not.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._spark import text_batches

MARK = "▁"
#: Place of the public vocabulary unless another is given.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def rank_scores(path: str = VOCABULARY) -> dict[str, float]:
    """log score of every ordinary piece of a sentencepiece file, by the rank of its id (Zipf's law)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(ids))))
    return {sp.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(ids)}


class Trie:
    """Forward scores by prefix.

    Nodes are numbers; `kids` maps (node, character) to the next node.
    """

    #: Beyond this depth a prefix is scored without a node: such words are junk that doesn't recur.
    DEPTH = 64

    def __init__(self, scores: dict[str, float], unknown: float, most_nodes: int):
        self.scores, self.unknown, self.most = scores, unknown, most_nodes
        ends: dict[str, set[int]] = {}
        for piece in scores:
            ends.setdefault(piece[-1], set()).add(len(piece))
        self.ends = {c: sorted(n) for c, n in ends.items()}
        self.clear()

    def clear(self) -> None:
        self.kids: dict[int, int] = {}
        self.score, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def step(self, word: str, i: int, score: list[float], count: list[int]) -> tuple[float, int]:
        """Best score and count of word[: i + 1] from those of the shorter prefixes."""
        get, c = self.scores.get, word[i]
        n = len(c.encode("utf-8", "surrogatepass"))
        best, tokens = score[i] + n * self.unknown, count[i] + n
        for size in self.ends.get(c, ()):
            at = i + 1 - size
            if at < 0:
                break
            s = get(word[at : i + 1])
            if s is not None:
                s += score[at]
                if s > best or (s == best and count[at] + 1 < tokens):
                    best, tokens = s, count[at] + 1
        return best, tokens

    def insert(self, pretoken: str) -> int:
        """The token count of a pre-token (without its mark)."""
        word = MARK + pretoken
        node, score, count = 0, [0.0], [0]
        kids = self.kids
        for i, c in enumerate(word):
            if i < self.DEPTH:
                key = node << 21 | ord(c)
                nxt = kids.get(key)
                if nxt is None:
                    s, n = self.step(word, i, score, count)
                    nxt = kids[key] = len(self.score)
                    self.score.append(s)
                    self.count.append(n)
                node = nxt
                score.append(self.score[node])
                count.append(self.count[node])
            else:
                s, n = self.step(word, i, score, count)
                score.append(s)
                count.append(n)
        if len(word) <= self.DEPTH:
            self.terminal[pretoken] = count[-1]
        return count[-1]

    def total(self, words: list[str]) -> int:
        """The tokens of all words of a text."""
        known = self.terminal
        new = set(words).difference(known)
        if new:
            long = {w: self.insert(w) for w in new}
            out = sum(map(lambda w: known[w] if w in known else long[w], words)) if any(len(w) >= self.DEPTH for w in new) else sum(map(known.__getitem__, words))
        else:
            out = sum(map(known.__getitem__, words))
        if len(self.score) > self.most:
            self.clear()
        return out


def _count(scores: dict[str, float], unknown: float, most_nodes: int):
    def run(batches):
        trie = Trie(scores, unknown, most_nodes)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                words, tokens = [], []
                for text in part.column("text").to_pylist():
                    split = text.split() if text else []
                    words.append(len(split))
                    tokens.append(trie.total(split))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, scores: dict[str, float] | None = None, unknown: float = -20.0, most_nodes: int = 600_000) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every document."""
    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    vocabulary = rank_scores() if scores is None else scores
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary's size

    def run(batches):
        yield from _count(shared.value, unknown, most_nodes)(batches)

    return rows.mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")
