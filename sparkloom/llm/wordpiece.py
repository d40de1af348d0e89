"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie. Each node knows how many whole pieces greedy longest-match has certainly cut off when it can go no further there (popped
tokens) and the node of what is left (failure link). A word then takes one step a character, pieces are counted and never built.

Words are runs without white space, each with the vocabulary's word-start mark in front. A word that the pieces can't make up counts as one unknown token.

Defined cases: a null or blank text has no words and no tokens; repeated rows are rows of their own; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import STEP_BYTES
from sparkloom.llm.tokens import MEMO_LETTERS, MEMO_WORDS, distinct

START = "▁"


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model."""
    import sentencepiece

    known = sentencepiece.SentencePieceProcessor(model_file=path)
    return [known.id_to_piece(i) for i in range(known.get_piece_size()) if not (known.is_control(i) or known.is_unknown(i) or known.is_byte(i) or known.is_unused(i))]


class Automaton:
    """Nodes are numbers: 0 the root of word-inner pieces, ``begin`` the state after the start mark; -1 is nowhere."""

    def __init__(self, pieces: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        piece_at: list[bool] = [False]
        order: list[tuple[int, int, str]] = []  # (node, parent, character), parents first
        for piece in sorted(set(pieces) - {""}):
            node = 0
            for c in piece:
                to = self.next[node].get(c)
                if to is None:
                    to = self.next[node][c] = len(self.next)
                    self.next.append({})
                    piece_at.append(False)
                    order.append((to, node, c))
                node = to
            piece_at[node] = True
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        depth = [0] * len(self.next)
        for node, parent, _ in order:
            depth[node] = depth[parent] + 1
        for node, parent, c in sorted(order, key=lambda x: depth[x[0]]):
            if piece_at[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            at, popped = self.fail[parent], self.popped[parent]
            while at >= 0 and c not in self.next[at]:
                popped += self.popped[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.popped[node] = self.next[at][c], popped
        self.rest: list[int] = [0] * len(self.next)  # pieces still to pop at a word's end; -1: it can't be made up
        for node in sorted(range(1, len(self.next)), key=depth.__getitem__):
            to = self.fail[node]
            self.rest[node] = -1 if to < 0 or self.rest[to] < 0 else self.popped[node] + self.rest[to]

    def count(self, word: str) -> int:
        """Pieces of greedy longest match from the left, or 1 for an unknown word."""
        node = total = 0
        for c in word:
            to = self.next[node].get(c)
            while to is None:
                total += self.popped[node]
                node = self.fail[node]
                if node < 0:
                    return 1
                to = self.next[node].get(c)
                if to is None and node == 0:
                    return 1
            node = to
        return total + self.rest[node] if self.rest[node] >= 0 else 1


_SPACES = np.array([i for i in range(0x3001) if chr(i).isspace()], np.uint32)


class Counter:
    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.memo: dict[str, int] = {}

    def counts(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        words, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        step, size = [], 0
        for i, text in enumerate(texts):
            if text:
                if step and size + len(text) > STEP_BYTES:
                    self._step(texts, step, words, tokens)
                    step, size = [], 0
                step.append(i)
                size += len(text)
        if step:
            self._step(texts, step, words, tokens)
        return words, tokens

    def _step(self, texts: Sequence[str | None], rows: list[int], words: np.ndarray, tokens: np.ndarray) -> None:
        whole = " ".join([*(texts[i] for i in rows), ""])
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        inside = np.zeros(len(points) + 1, bool)
        inside[1:] = ~np.isin(points, _SPACES)
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        ends = np.flatnonzero(inside[:-1] & ~inside[1:])
        where, inverse = distinct(points, starts, ends)
        if len(self.memo) + len(where) > MEMO_WORDS:
            self.memo.clear()
        memo, found = self.memo, np.empty(len(where), np.int64)
        for k, (a, b) in enumerate(zip(starts[where].tolist(), ends[where].tolist(), strict=True)):
            word = whole[a:b]
            n = memo.get(word)
            if n is None:
                n = self.automaton.count(START + word)
                if b - a <= MEMO_LETTERS:
                    memo[word] = n
            found[k] = n
        before = np.concatenate([[0], np.cumsum(found[inverse])])
        cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(texts[i]) + 1 for i in rows])]))
        words[rows], tokens[rows] = np.diff(cuts), np.diff(before[cuts])


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each vocabulary and Python worker."""
    if path not in _counters:
        _counters[path] = Counter(Automaton(vocabulary(path)))
    return _counters[path]


def count(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, n_tokens."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, tokens = counter(path).counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, n_words long, n_tokens long")
