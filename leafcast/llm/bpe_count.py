"""Token counts by byte-pair merging: a heap of adjacent pairs over a linked list of symbols.

The count of a text is its initial symbols minus the merges made; no ids are looked up.
Initial symbols are the characters of the normalised text, a character outside the
vocabulary counting as its UTF-8 bytes (byte fallback). Repeatedly the adjacent pair whose
joined piece ranks best (ties: leftmost) is merged, by a heap with lazily dropped entries.
No piece of the vocabulary holds the word mark after another character (checked on
loading), so a merge never crosses into the next word: a text's count is the sum over its
words, and a bounded memo keeps the counts of words seen, which is a cache only.

Cases: a null or empty text has 0 tokens and 0 bytes; very long texts and words are counted
whole; equal rows are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from leafcast.session import bound_batches

COUNT_SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"
MARK = "▁"  # stands for a space, and begins every text
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_MODELS: dict[str, BpeCounter] = {}


class _Memo(dict):
    """Counts of words without a space inside, the mark before them understood; emptied when it holds ``limit`` words."""

    def __init__(self, counter: BpeCounter, limit: int):
        super().__init__()
        self.counter, self.limit = counter, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self.counter.count_word(MARK + word)
        if len(word) <= 64:
            self[word] = n
        return n


class BpeCounter:
    def __init__(self, path: str, memo_words: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = (model.is_byte, model.is_control, model.is_unknown, model.is_unused)
        plain = [i for i in range(model.get_piece_size()) if not any(kind(i) for kind in kinds)]
        ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
        score, self.rank = None, {}
        for i in ranked:  # pieces of one score share a rank, so that the leftmost goes first
            if score != model.get_score(i):
                score, place = model.get_score(i), len(self.rank)
            self.rank[model.id_to_piece(i)] = place
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece of this vocabulary crosses words; their counts do not add up")
        probe = "  a \t①\n b  "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("only vocabularies that mark spaces and change nothing else are supported")
        self.memo = _Memo(self, memo_words)

    def count_word(self, word: str) -> int:
        rank = self.rank
        pieces = list(word)
        n = len(pieces)
        fallback = sum(len(c.encode()) - 1 for c in pieces if c not in rank)
        if n == 1:
            return 1 + fallback
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            joined = pieces[i] + pieces[i + 1]
            if joined in rank:
                heap.append((rank[joined], i, joined))
        heapify(heap)
        merges = 0
        while heap:
            _, i, joined = heappop(heap)
            left = pieces[i]
            if left is None or len(left) >= len(joined):
                continue
            j = after[i]
            if j >= n or left + pieces[j] != joined:
                continue  # one of the two has been merged meanwhile
            pieces[i], pieces[j] = joined, None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = joined + pieces[k]
                if new in rank:
                    heappush(heap, (rank[new], i, new))
            h = before[i]
            if h >= 0:
                new = pieces[h] + joined
                if new in rank:
                    heappush(heap, (rank[new], h, new))
        return n + fallback - merges

    def count(self, text: str) -> int:
        if not text:
            return 0
        memo = self.memo
        if text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
            return sum(map(memo.__getitem__, text.split(" ")))
        total = 0
        for word in _WORDS.findall(MARK + text.replace(" ", MARK)):
            total += memo[word[1:]] if word[0] == MARK and word[1:2] != MARK else self.count_word(word)
        return total


def counter(path: str, memo_words: int = 1_000_000) -> BpeCounter:
    if path not in _MODELS:
        _MODELS[path] = BpeCounter(path, memo_words)
    return _MODELS[path]


def token_counts(docs: DataFrame, model_path: str, memo_words: int = 1_000_000,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, UTF-8 bytes and tokens of every whole text; ``memo_words`` bounds the memo of each worker."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = counter(model_path, memo_words)
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(1))
            sizes = [(len(t.encode()), bpe.count(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s[0] for s in sizes], pa.int64()), pa.array([s[1] for s in sizes], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return bound_batches(rows).mapInArrow(count, COUNT_SCHEMA)
