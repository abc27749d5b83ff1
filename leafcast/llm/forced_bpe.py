"""Byte-level BPE encoding by forced boundaries, and decoding.

Two bytes that stand side by side in no token of the vocabulary are never merged, so a cut between them is certain.
The table of such byte pairs is read off the vocabulary. A text is cut twice by it: first where the splitter of words
always cuts too (a visible character before a space or line feed), so that the fragments can be encoded
each for itself, the splitter included; then each word at all certain cuts, and what is between two cuts is merged
by rank alone. The ids of the fragments put one after another are the ids of the text. Fragments repeat, so the ids of
those seen are kept in a memo of bounded size, which is a cache only.

Where words begin and end depends on Unicode classes, which the library's own splitter knows; it sees the fragments that
are neither in the memo nor plain ASCII letters and marks. Special tokens in a text are taken as such, as the library does by default; they hold no white
space, so a fragment has them whole.

Cases: a null or empty text has no ids and decodes to the empty text; long texts and words are encoded whole; equal rows are
encoded each; an empty table gives no rows; other columns are ignored; a null id is carried as null.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafcast.session import bound_batches

ENCODED = "doc_id bigint, n_tokens bigint, ids binary"
DECODED = "doc_id bigint, n_tokens bigint, ids binary, decoded string"
ID_BITS = 24
#: Last bytes of white space beyond ASCII, in UTF-8 (fixed values).
ENDS_OF_SPACES = {c.encode()[-1] for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"}
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
_CODERS: dict[str, ForcedBpe] = {}


#: Fragments that every splitter cuts alike: perhaps a line feed, ASCII and Latin-1 letters with a space before or not, then marks without an apostrophe.
PLAIN = re.compile(rb"(\n?)( ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


class _Memo(dict):
    """Ids of byte strings, as bytes, by a function; when it holds ``limit`` of them they become the old ones, from which what is asked for again returns."""

    def __init__(self, ids_of: Callable[[bytes], bytes], limit: int):
        super().__init__()
        self.ids_of, self.limit, self.old = ids_of, limit, {}

    def __missing__(self, data: bytes) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(data) or self.ids_of(data)
        if len(data) <= 64:
            self[data] = ids
        return ids


class ForcedBpe:
    def __init__(self, path: str, memo_size: int):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        splitter = spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only byte-level BPE without a normaliser or prefix is supported")
        if any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError("options of this BPE model are not supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in added):
            raise ValueError("special tokens that take in white space are not supported")
        self.byte_of = _bytes_of_letters()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in added}
        self.bytes_of: dict[int, bytes] = {i: self.raw(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.first_ids = [vocab[letter] for letter in sorted(self.byte_of, key=self.byte_of.get)]
        self.merges: dict[int, int] = {}  # rank of a pair of ids
        self.joined: list[int] = []  # by rank, the id that a pair becomes
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << ID_BITS | vocab[b]] = rank
            self.joined.append(vocab[a + b])
        self.certain = certain_cuts(b for i, b in self.bytes_of.items() if i not in self.special.values())
        # Before a space or line feed, after a visible character: after one of Latin-1 whatever its second byte is.
        free = self.certain.reshape(256, 256).copy()
        free[:0x21] = free[0x7F] = free[:, [b for b in range(256) if b not in b" \n"]] = False
        self.after_latin = free.reshape(-1).copy()
        free[[*ENDS_OF_SPACES]] = False
        self.free = free.reshape(-1)
        self.certain_pairs = {(int(i) >> 8, int(i) & 255) for i in np.flatnonzero(self.certain)}
        self.split_words = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        names = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.split_special = re.compile(f"({names})") if names else None
        self.memo, self.words = _Memo(self.fragment, memo_size), _Memo(self.word, memo_size)

    def raw(self, letters: str) -> bytes:
        return bytes(map(self.byte_of.__getitem__, letters))

    def encode(self, data: bytes) -> bytes:
        """Ids of a UTF-8 text, little-endian unsigned 32-bit."""
        if not data:
            return b""
        free = _cuts(data, self.free)
        if not data.isascii():
            free[1:] |= (np.frombuffer(data, np.uint8)[:-2] == 0xC3) & _cuts(data[1:], self.after_latin)
        at = [0, *(np.flatnonzero(free) + 1).tolist(), len(data)]
        return b"".join(map(self.memo.__getitem__, [data[a:b] for a, b in zip(at, at[1:], strict=False)]))

    def fragment(self, data: bytes) -> bytes:
        """Ids of a text that begins and ends at boundaries of words."""
        if plain := PLAIN.fullmatch(data):
            return b"".join([self.words[part] for part in plain.groups() if part])
        text, out = data.decode("utf-8", "replace"), []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out += [self.words[self.raw(letters)] for letters, _ in self.split_words(part)]
        return b"".join(out)

    def word(self, data: bytes) -> bytes:
        """Ids of a word: merged between two certain cuts at a time."""
        if self.certain_pairs.isdisjoint(zip(data, data[1:], strict=False)):
            ids = self.merged(data)
        else:
            at = [0, *(np.flatnonzero(_cuts(data, self.certain)) + 1).tolist(), len(data)]
            ids = [i for a, b in zip(at, at[1:], strict=False) for i in self.merged(data[a:b])]
        return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()

    def merged(self, data: bytes) -> list[int]:
        """Ids of bytes by rank: a heap of adjacent pairs (rank, then place) over a linked list; ties go to the leftmost."""
        ids = list(map(self.first_ids.__getitem__, data))
        rank_of = self.merges.get
        heap = [rank << 32 | i for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (rank := rank_of(a << ID_BITS | b)) is not None]
        if not heap:
            return ids
        heapify(heap)
        n, joined = len(ids), self.joined
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if j >= n or ids[i] < 0 or rank_of(ids[i] << ID_BITS | ids[j]) != rank:
                continue  # one of the two has been merged meanwhile
            new = ids[i] = joined[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(new << ID_BITS | ids[k])) is not None:
                    heappush(heap, rank << 32 | i)
            h = before[i]
            if h >= 0 and (rank := rank_of(ids[h] << ID_BITS | new)) is not None:
                heappush(heap, rank << 32 | h)
        return [i for i in ids if i >= 0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each printable letter of a byte-level vocabulary stands for (a fixed rule of the format)."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def certain_cuts(tokens: Iterator[bytes]) -> np.ndarray:
    """256 * 256 flags, at 256 * a + b: whether byte b never follows byte a inside a token."""
    certain = np.ones(1 << 16, dtype=bool)
    for token in tokens:
        raw = np.frombuffer(token, np.uint8).astype(np.uint16)
        certain[(raw[:-1] << 8) | raw[1:]] = False
    return certain


def _cuts(data: bytes, table: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.uint16)
    return table[(raw[:-1] << 8) | raw[1:]]


def coder(path: str, memo_size: int = 300_000) -> ForcedBpe:
    if path not in _CODERS:
        _CODERS[path] = ForcedBpe(path, memo_size)
    return _CODERS[path]


def encode_texts(docs: DataFrame, path: str, memo_size: int = 300_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every whole text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, memo_size)
        for batch in batches:
            ids = [bpe.encode(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]
            columns = [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids"])

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return bound_batches(rows).mapInArrow(encode, ENCODED)


def decode_ids(encoded: DataFrame, path: str, memo_size: int = 300_000) -> DataFrame:
    """Rows of ``encode_texts`` with the text that their ids stand for."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, memo_size)
        for batch in batches:
            texts = [bpe.decode(i or b"") for i in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return bound_batches(encoded.select("doc_id", "n_tokens", "ids")).mapInArrow(decode, DECODED)
