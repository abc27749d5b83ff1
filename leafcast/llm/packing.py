"""Packing of token sequences into fixed windows by the sum-of-squares rule.

Every document is tokenised, ended by one separator id and cut into full windows; the rest
of it, shorter than a window, is placed online: with ``count[l]`` partially filled windows
at level ``l`` (the level array), a piece of ``n`` ids goes to the level whose choice gives
the smallest sum of squared counts, a new window being level 0 and a full window leaving
the array. Each task packs the rows of its own split in order, so there is no shuffle, and
the plan does the same after a lost executor. At the end of a split, or when more than
``max_open`` windows are partially filled, the windows left over are topped up: pieces of
the emptiest are cut to fill the fullest, until at most one stays partially filled. No id
is lost, and memory is bounded by ``max_open`` windows.

Cases: a null or empty text is the separator alone; a text longer than a window is cut; equal
rows are packed each for itself; an empty table gives no rows; further columns are ignored;
a null id is carried as null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from leafcast.session import bound_batches

PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

#: Letters below this code point have had the same classes in every release of Unicode that
#: the two libraries use, so their splits, and with the one vocabulary their ids, agree.
STABLE_BELOW = 0x250

_ENCODERS: dict[str, object] = {}


class _Encoder:
    """Ids of texts as ``tokenizers`` gives them for a byte-level BPE file.

    For texts within Latin letters the same vocabulary and merges run in ``tiktoken``, which is
    several times faster; others go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path, self.whole = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        code = {c: b for b, c in _byte_letters().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(code[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if text.isascii() or max(text) < chr(STABLE_BELOW):
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        if self.whole is None:  # loaded where a text asks for it
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary (a fixed rule of the format)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


class SumOfSquares:
    """Open windows by level, and the online rule over the level array."""

    def __init__(self, window: int, first_id: int = 0, step: int = 1):
        self.window, self.next_id, self.step = window, first_id, step
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def new(self) -> list:
        self.next_id += self.step
        return [self.next_id - self.step, 0, []]

    def level_for(self, n: int) -> int:
        """Level whose window takes the piece: smallest change of the sum of squares, ties to the fullest."""
        count, top = self.count, self.window - n
        # Moving a window from l to l+n changes the sum by (c[l+n]+1)^2-c[l+n]^2 + (c[l]-1)^2-c[l]^2.
        gain = 2 * count[n:self.window + 1] + 1
        gain[top] = 0  # a window that gets full leaves the array
        loss = np.where(count[:top + 1] > 0, 1 - 2 * count[:top + 1], 1 << 40)
        loss[0] = 0
        change = gain + loss
        return top - int(np.argmin(change[::-1]))

    def place(self, piece: tuple) -> list | None:
        """Puts (doc, start, ids, total) into a window; the window if it is full now."""
        n = len(piece[2])
        level = self.level_for(n)
        if level:
            box = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        else:
            box = self.new()
        box[2].append(piece)
        box[1] += n
        return self.keep(box)

    def keep(self, box: list) -> list | None:
        if box[1] == self.window:
            return box
        self.open.setdefault(box[1], []).append(box)
        self.count[box[1]] += 1
        self.n_open += 1
        return None

    def top_up(self) -> Iterator[list]:
        """Fills the fullest windows with cuts of the emptiest; yields full ones, keeps one partial window at most."""
        boxes = sorted((b for bs in self.open.values() for b in bs), key=lambda b: (b[1], b[0]))
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        low, high = 0, len(boxes) - 1
        while low < high:
            taker, giver = boxes[high], boxes[low]
            while taker[1] < self.window and giver[2]:
                doc, start, ids, total = giver[2].pop()
                room = self.window - taker[1]
                cut = max(0, len(ids) - room)
                taker[2].append((doc, start + cut, ids[cut:], total))
                taker[1] += len(ids) - cut
                giver[1] -= len(ids) - cut
                if cut:
                    giver[2].append((doc, start, ids[:cut], total))
            if taker[1] == self.window:
                yield taker
                high -= 1
            if not giver[2]:
                low += 1
        if low == high and boxes[low][2]:
            self.keep(boxes[low])

    def rest(self) -> Iterator[list]:
        yield from self.top_up()
        yield from (b for bs in self.open.values() for b in bs)


def _packer(path: str, window: int, end_id: int, max_open: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        bins = SumOfSquares(window, first_id=task << 40)
        end = np.array([end_id], dtype="<u4")
        full: list[list] = []

        def flush() -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(7)]
            for seq, _, pieces in full:
                offset = 0
                for doc, start, ids, total in pieces:
                    for c, v in zip(cols, (doc, start, len(ids), ids.tobytes(), total, seq, offset), strict=True):
                        c.append(v)
                    offset += len(ids)
            full.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc, ids = doc.as_py(), np.concatenate([encode.ids(text.as_py() or ""), end])
                total = len(ids)
                cuts = total - total % window
                for start in range(0, cuts, window):
                    box = bins.new()
                    box[1], box[2] = window, [(doc, start, ids[start:start + window], total)]
                    full.append(box)
                if cuts < total:
                    done = bins.place((doc, cuts, ids[cuts:].copy(), total))
                    if done:
                        full.append(done)
                    if bins.n_open > max_open:
                        full.extend(bins.top_up())
                if len(full) >= 512:
                    yield flush()
        full.extend(bins.rest())
        if full:
            yield flush()

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, max_open: int = 4096,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the document's ids ``start .. start+length`` (``ids``: little-endian unsigned 32-bit) at ``offset`` of a sequence."""
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return bound_batches(rows).mapInArrow(_packer(tokenizer_path, window, end_id, max_open), PIECE_SCHEMA)
