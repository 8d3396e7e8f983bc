"""Packing token sequences into training windows: best-fit decreasing, block by block.

Each text becomes token ids and an end id.  Overlong documents are first cut into full windows;
what is left of each goes into the open window with the least room that still takes it, longest first.
A segment tree over remaining capacities finds that window in log2(window) steps.  A task packs the pieces
that it cuts itself, a block of some thousand at a time: ids are neither written nor shuffled before they are packed,
equal rows and hot sources fill blocks like any others, and a lost task packs its part again the same way.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from tokenizers import Tokenizer

WINDOW = 1024
END_ID = 0
#: Pieces packed together: enough that the few windows left open at a block's end are below 1 %; their ids take some MB.
BLOCK_PIECES = 4_000
#: Words a worker remembers the ids of, and characters it splits at a time.
KEPT_WORDS, SPLIT_CHARS = 1_200_000, 1 << 20
_OPEN_SPACE = re.compile(r" (?:\s|\Z)")


class TextIds:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    Byte-level BPE never merges across the start of a blank followed by a non-blank, so such
    text is split there and each distinct word is encoded once; other text is encoded as it is.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        blank = self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][0]
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(blank)]] = True
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        for low in range(0, len(words), 512):
            some = words[low : low + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.begins[ids])
            blob, at = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            if len(starts) != len(some):
                raise ValueError("the vocabulary starts a token with a blank inside a word")
            self.known.update(zip(some, (blob[s:e] for s, e in zip(at[:-1], at[1:], strict=True)), strict=True))

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text (texts of about SPLIT_CHARS at most)."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        parts = [None if _OPEN_SPACE.search(t) else t.split(" ") for t in texts]
        new = set()
        for p in parts:
            new.update(p[1:] if p else ())
        self._learn([w for w in new if w not in self.known])
        get = self.known.__getitem__
        return [self.encode(t) if p is None else (self.encode(p[0]) if p[0] else b"") + b"".join(map(get, p[1:])) for t, p in zip(texts, parts, strict=True)]


def _segments(text: str) -> Iterator[str]:
    low = 0
    while len(text) - low > SPLIT_CHARS:
        cut = low + SPLIT_CHARS
        while (cut := text.find(" ", cut)) >= 0 and cut + 1 < len(text) and text[cut + 1].isspace():
            cut += 1
        if cut < 0:
            break
        yield text[low:cut]
        low = cut
    yield text[low:]


def _ids_of(encoder: TextIds, texts: list[str]) -> Iterator[bytes]:
    """Ids of each text, about SPLIT_CHARS of text at a time."""
    low = 0
    while low < len(texts):
        if len(texts[low]) > SPLIT_CHARS:
            yield b"".join(encoder.batch([s])[0] for s in _segments(texts[low]))
            low += 1
            continue
        high, total = low, 0
        while high < len(texts) and total + len(texts[high]) <= SPLIT_CHARS:
            total += len(texts[high])
            high += 1
        yield from encoder.batch(texts[low:high])
        low = high


def _cut(batches: Iterator[pa.RecordBatch], path: str, window: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder, end, step = TextIds(path), np.array([END_ID], "<u4").tobytes(), 4 * window
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        out: list[tuple] = []
        for doc, blob in zip(ids, _ids_of(encoder, texts), strict=True):
            blob += end
            n = len(blob) // 4
            for at in range(0, len(blob), step):
                piece = blob[at : at + step]
                out.append((doc, at // 4, len(piece) // 4, zlib.crc32(piece), n, piece if with_ids else None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECE, strict=True)], schema=_PIECE)


class OpenWindows:
    """Open windows by remaining capacity; a segment tree finds the least capacity that is enough."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.by_room: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, room: int, which: int) -> None:
        self.by_room[room].append(which)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) with the least room >= need, or None; the window is no longer open."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.by_room[room].pop()

    def _add(self, room: int, n: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += n
            node >>= 1


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece (lengths descending)."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_, used = OpenWindows(window), 0
    for i, n in enumerate(lengths.tolist()):
        found = open_.take(n) if n < window else None
        if found is None:
            found = window, used
            used += 1
        room, which = found
        where[i], offset[i] = which, window - room
        if room > n:
            open_.put(room - n, which)
    return where, offset


_PIECE = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [("ids", pa.binary())])
_PACKED = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def packed_blocks(pieces: Iterator[pa.RecordBatch], window: int, first: int = 0) -> Iterator[pa.RecordBatch]:
    """Pieces with sequence_id, counted from ``first``, and offset; a block of ``BLOCK_PIECES`` is held at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def block(table: pa.Table) -> pa.Table:
        nonlocal first
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        where, offset = best_fit(table.column("length").to_numpy(), window)
        out = table.append_column("sequence_id", pa.array(first + where)).append_column("offset", pa.array(offset))
        first += int(where.max()) + 1
        return out

    for batch in pieces:
        while batch.num_rows:
            part = batch.slice(0, BLOCK_PIECES - rows)
            batch = batch.slice(len(part))
            held.append(part)
            rows += len(part)
            if rows == BLOCK_PIECES:
                yield from block(pa.Table.from_batches(held, _PIECE)).to_batches()
                held, rows = [], 0
    if rows:
        yield from block(pa.Table.from_batches(held, _PIECE)).to_batches()


def token_pieces(documents: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and ids (binary) of each document's full windows and rest."""
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: _cut(b, tokenizer, window, with_ids), from_arrow_schema(_PIECE))


def pack_documents(documents: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Every token of every row of ``documents`` in exactly one piece of one sequence, pieces without gaps from 0.

    Sequences hold pieces of one input partition; their numbers begin with that of the partition.  Null and empty texts are the end id alone; a null doc_id stays null; equal rows are packed as often as they come;
    an empty table gives no rows; columns other than doc_id and text are not read.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed_blocks(_cut(batches, tokenizer, window, with_ids), window, TaskContext.get().partitionId() << 32)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(packed, from_arrow_schema(_PACKED))
