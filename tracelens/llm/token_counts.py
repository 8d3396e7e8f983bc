"""Token counts of whole texts with a whole-token shortcut.

Before the job, every string of the vocabulary is put through the library's own merges, alone; those that come out as one
token are proved whole, for byte-level BPE merges a pre-token without looking beyond it.  Tasks cut texts into pre-tokens,
count proved ones as 1 by a lookup, and merge only the rest.  No rows are shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

#: How the byte-level pre-tokenizer cuts text. Fixed value.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pre-tokens that a worker remembers, their greatest length, and characters that it cuts at a time.
KEPT, KEPT_LENGTH, SPLIT_CHARS = 300_000, 64, 1 << 18


def _library(path: str) -> tuple[Tokenizer, str | None]:
    """The tokenizer and its special string; ValueError unless it is byte-level BPE with plain special strings."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    pre, model, added = told.get("pre_tokenizer") or {}, told["model"], told.get("added_tokens") or []
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in added)
    if told.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("type") != "BPE" or model.get("dropout") or not plain:
        raise ValueError(f"{path}: not a byte-level BPE vocabulary without normalizer and prefix blank")
    strings = sorted((regex.escape(t["content"]) for t in added), key=len, reverse=True)
    return Tokenizer.from_file(path), "|".join(strings) or None


def _pieces(tokenizer: Tokenizer, text: str) -> list[str]:
    return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


class Alphabet:
    """Pre-tokens as the model sees them: each byte one printable character."""

    def __init__(self, tokenizer: Tokenizer):
        self.byte = {}
        # every first and every inner byte of UTF-8 occurs in one of these
        starts = (range(0x100), range(0x100, 0x800, 0x40), [0x800], range(0x1000, 0x10000, 0x1000), range(0x10000, 0x110000, 0x10000))
        for c in (chr(x) for some in starts for x in some):
            shown = "".join(p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(c))
            self.byte |= dict(zip(c.encode(), shown, strict=True))
        self.back = {s: b for b, s in self.byte.items()}

    def shown(self, text: str) -> str:
        return "".join(map(self.byte.__getitem__, text.encode()))

    def text(self, token: str) -> str | None:
        """The text of a vocabulary string; None if it is no whole UTF-8."""
        try:
            return bytes(map(self.back.__getitem__, token)).decode()
        except (KeyError, UnicodeDecodeError):
            return None


@lru_cache(maxsize=4)
def prove_whole(path: str) -> tuple[frozenset[str], str]:
    """(strings that encode alone as one token, characters at which the pattern and the library part ways).

    Every vocabulary string is tested by the library itself: it must be one pre-token and merge to one token.  Characters are
    tested one by one up to U+FFFF in the contexts that the pattern tells apart; those beyond count as unproved.
    """
    tokenizer, _ = _library(path)
    alphabet, pattern = Alphabet(tokenizer), regex.compile(PRE_TOKEN)
    whole = set()
    for token in tokenizer.get_vocab(with_added_tokens=False):
        text = alphabet.text(token)
        if text and pattern.findall(text) == [text] and len(tokenizer.model.tokenize(token)) == 1:
            whole.add(text)
    unproved = []
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]):
        probe = f"a{c}1{c}!{c} {c}."
        if _pieces(tokenizer, probe) != pattern.findall(probe):
            unproved.append(c)
    return frozenset(whole), "".join(unproved)


class TokenCounts(dict):
    """Pre-token -> number of tokens; proved strings are there from the start, others are merged when first met."""

    def __init__(self, path: str, whole: frozenset[str], unproved: str):
        self.tokenizer, special = _library(path)
        self.alphabet, self.whole = Alphabet(self.tokenizer), whole
        self.pattern, self.special = regex.compile(PRE_TOKEN), special and regex.compile(special)
        self.unproved = regex.compile("[" + regex.escape(unproved) + "\U00010000-\U0010ffff]")
        self.merged = 0
        self.update(dict.fromkeys(whole, 1))

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.model.tokenize(self.alphabet.shown(piece)))
        if len(piece) <= KEPT_LENGTH:
            if len(self) > len(self.whole) + KEPT:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = n
        self.merged += 1
        return n

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings, a stretch at a time; a pre-token begins at each blank before a non-blank."""
        total, low = 0, 0
        while low < len(text):
            cut = len(text)
            if cut - low > SPLIT_CHARS:
                cut = low + SPLIT_CHARS
                while (cut := text.find(" ", cut)) >= 0 and (cut + 1 == len(text) or text[cut + 1].isspace()):
                    cut += 1
                cut = len(text) if cut < 0 else cut
            part = text[low:cut]
            pieces = _pieces(self.tokenizer, part) if self.unproved.search(part) else self.pattern.findall(part)
            total += sum(map(self.__getitem__, pieces))
            low = cut
        return total

    def count(self, text: str) -> int:
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def _counted(batches: Iterator[pa.RecordBatch], path: str, whole: frozenset[str], unproved: str) -> Iterator[pa.RecordBatch]:
    counts = TokenCounts(path, whole, unproved)
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        sizes, tokens = pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([counts.count(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, tokens], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row: UTF-8 bytes, and tokens as the library counts them.

    ``tokenizer`` is the path of a byte-level BPE file that driver and tasks can read; its special strings inside a text are one
    token each, as is the library's default.  Null and empty texts have no tokens; a null doc_id stays null; equal rows are
    counted each; an empty table gives no rows; a very long text is cut where pre-tokens begin; other columns are not read.
    """
    whole, unproved = prove_whole(tokenizer)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda b: _counted(b, tokenizer, whole, unproved), "doc_id long, n_bytes long, n_tokens long")
