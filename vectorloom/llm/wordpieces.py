"""Token counts by a linear longest-match automaton.

Greedy longest-match-first cuts a word into the longest vocabulary piece at each
place.  The automaton is a trie of the pieces.  A node's failure link leads to
the node of what is left of its string once the greedy cut has taken as many
pieces off its front as it must, and its pop count says how many tokens these
were.  A word then costs one step per character, and its length in tokens is the
sum of the pop counts met; no piece is ever built.

A character that no piece covers is one token per UTF-8 byte.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import binary_text, column_or_null, map_rows, whole_words

TABLE = "piece_bpe_32k.model"
# Fixed value: the mark of a word's beginning in the vocabulary.
BEGIN = "▁"
CACHE_WORDS = 300_000
LONG_WORD = 64


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of a vocabulary file, without its control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(TABLE))
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Automaton:
    """Trie, failure links and pop counts as flat lists; node 0 is the root.

    ``fail[v]`` is -1 where the string of ``v`` cannot lose a piece, which is
    the case for the root alone: every character counts as a piece, of as many
    tokens as it has bytes if the vocabulary has none for it.
    """

    def __init__(self, pieces: Iterable[str], begin: str = BEGIN):
        self.begin = begin
        self.edges: list[dict[str, int]] = [{}]
        # Tokens that the node's string is as one piece; 0 where it is none.
        whole = [0]

        def node(piece: str) -> int:
            at = 0
            for char in piece:
                after = self.edges[at].get(char)
                if after is None:
                    after = self.edges[at][char] = len(self.edges)
                    self.edges.append({})
                    whole.append(0)
                at = after
            return at

        known = [piece for piece in pieces if piece]
        for char in {char for piece in known for char in piece}:
            whole[node(char)] = len(char.encode())
        for piece in known:
            whole[node(piece)] = 1
        self.fail, self.pops = [-1] * len(whole), [0] * len(whole)
        self._link(whole)

    def _link(self, whole: list[int]) -> None:
        """Failure links by breadth: a node's follow from its parent's."""
        waiting = deque([0])
        while waiting:
            parent = waiting.popleft()
            for char, child in self.edges[parent].items():
                if whole[child]:
                    # The whole string is the longest piece at its front.
                    self.fail[child], self.pops[child] = 0, whole[child]
                else:
                    at, count = self.fail[parent], self.pops[parent]
                    while at and char not in self.edges[at]:
                        count += self.pops[at]
                        at = self.fail[at]
                    # At the root a step always exists: all characters of pieces are pieces.
                    self.fail[child], self.pops[child] = self.edges[at][char], count
                waiting.append(child)

    def length(self, word: str) -> int:
        """Tokens of one word with its begin mark, by the greedy cut."""
        edges, fail, pops = self.edges, self.fail, self.pops
        at, count = 0, 0
        for char in self.begin + word:
            after = edges[at].get(char)
            while after is None and at:
                count += pops[at]
                at = fail[at]
                after = edges[at].get(char)
            if after is None:
                count += len(char.encode())
            else:
                at = after
        while at:
            count += pops[at]
            at = fail[at]
        return count


class WordLengths(dict):
    """Lengths of words met, kept for the first so many."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        length = self.automaton.length(word.decode())
        if len(self) < CACHE_WORDS and len(word) <= LONG_WORD:
            self[word] = length
        return length


_LOADED: dict[str | None, WordLengths] = {}


def word_lengths(path: str | None) -> WordLengths:
    """The table of this worker, made once for each vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = WordLengths(Automaton(vocabulary(path)))
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens, longest_word`` for every row.

    ``longest_word`` is the largest number of tokens in one word.  A null or
    empty text has zeros.  Null ids and repeated rows stay as they are.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = word_lengths(path)
        for batch in batches:
            words, tokens, longest = [], [], []
            for text in batch.column(1):
                found = whole_words(text.as_py())
                counts = [lengths[word] for word in found]
                words.append(len(found))
                tokens.append(sum(counts))
                longest.append(max(counts, default=0))
            yield pa.record_batch(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(longest, pa.int64())],
                names=["doc_id", "n_words", "n_tokens", "longest_word"],
            )

    rows = docs.select(column_or_null(docs, "doc_id", "bigint"), binary_text())
    return map_rows(rows, work, "doc_id bigint, n_words bigint, n_tokens bigint, longest_word bigint")
