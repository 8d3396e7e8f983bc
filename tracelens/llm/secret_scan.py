"""Secret scans: fixed credential forms, and probabilistic automata learned from the credentials they find.

Grammar inference: the labelled credentials of a kind make a prefix tree; its states are
merged where their outgoing frequencies are statistically compatible (Hoeffding bound, with folding of
subtrees), which gives a probabilistic automaton of the kind's format.  Every long run of credential
characters in every text is then scored by each automaton; those as likely as the kind's own held-back credentials,
and likelier than ordinary words make them, are added to the fixed forms' spans, which always stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Fixed forms, in the order in which kinds are listed: pattern, group that must be long enough, least length.
FORMS = {
    "assign": (re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),
}
_KEYS = re.compile(r"(?ai:passw|secret|token|api_?key)")
KINDS = [*FORMS, "format"]
#: Credentials of each kind in the training sample, and how many of them set the threshold instead.
SAMPLE, HELD_BACK = 400, 100
#: Confidence of a merge, least length and alphabet of a candidate.
ALPHA, LEAST = 0.05, 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_END = ""


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, secret's start, secret's end) of the fixed forms, by start and then kind as listed."""
    out = []
    if _KEYS.search(text):
        out += [(m.start(), m.end(), "assign", m.start(2), m.end(2)) for m in FORMS["assign"][0].finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start(), m.end()) for m in FORMS["access"][0].finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex", m.start(), m.end()) for m in FORMS["hex"][0].finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


@dataclass
class State:
    """A state of the tree or automaton: how many strings came, where they went on, how often."""

    total: int = 0
    count: Counter = field(default_factory=Counter)
    to: dict[str, State] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton, by merging compatible states of the prefix tree of some strings."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.symbols = len({c for s in strings for c in s}) + 1
        self.slack = math.sqrt(0.5 * math.log(2 / alpha))
        self.start = State()
        for s in strings:
            state = self.start
            for c in s:
                state.total += 1
                state.count[c] += 1
                state = state.to.setdefault(c, State())
            state.total += 1
            state.count[_END] += 1
        self._merge()

    def _differ(self, n: int, of: int, m: int, of2: int) -> bool:
        return abs(n / of - m / of2) > self.slack * (1 / math.sqrt(of) + 1 / math.sqrt(of2))

    def _compatible(self, a: State, b: State) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if not a.total or not b.total:
                continue
            if any(self._differ(a.count[c], a.total, b.count[c], b.total) for c in a.count.keys() | b.count.keys()):
                return False
            stack += [(a.to[c], t) for c, t in b.to.items() if c in a.to]
        return True

    def _fold(self, a: State, b: State) -> None:
        """Add the subtree of b to the automaton at a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            a.total += b.total
            a.count.update(b.count)
            for c, t in b.to.items():
                if c in a.to:
                    stack.append((a.to[c], t))
                else:
                    a.to[c] = t

    def _merge(self) -> None:
        kept, seen = [self.start], {id(self.start)}
        while True:
            edge = max(((s.to[c].total, -i, c) for i, s in enumerate(kept) for c in s.to if id(s.to[c]) not in seen), default=None)
            if edge is None:
                break
            source, c = kept[-edge[1]], edge[2]
            new = source.to[c]
            partner = next((k for k in kept if self._compatible(k, new)), None)
            if partner is None:
                kept.append(new)
                seen.add(id(new))
            else:
                source.to[c] = partner
                self._fold(partner, new)
        self.states = kept

    def score(self, text: str) -> float:
        """Mean log-likelihood of a symbol, the end included; unseen moves have a small probability."""
        state: State | None = self.start
        total = 0.0
        for c in [*text, _END]:
            if state is None:
                total += math.log(1e-4)
                continue
            total += math.log((state.count[c] + 0.01) / (state.total + 0.01 * self.symbols))
            state = state.to.get(c)
        return total / (len(text) + 1)


@dataclass
class Grammars:
    """An automaton and a threshold for each kind; ``words`` is the automaton of ordinary candidates."""

    by_kind: dict[str, tuple[Automaton, float]]
    words: Automaton | None

    def accepts(self, text: str) -> bool:
        other = self.words.score(text) if self.words else -math.inf
        return any((s := a.score(text)) >= least and s > other for a, least in self.by_kind.values())


def learn(credentials: dict[str, list[str]], words: list[str]) -> Grammars:
    """Automata from all but the last HELD_BACK credentials of a kind; these set the threshold (the lowest score in twenty)."""
    found = {}
    for kind, strings in credentials.items():
        back = min(HELD_BACK, len(strings) // 4)
        if len(strings) < 8:
            continue
        model = Automaton(strings[back:])
        scores = sorted(map(model.score, strings[:back]))
        found[kind] = model, scores[len(scores) // 20]
    return Grammars(found, Automaton(words) if words else None)


def _candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for m in _CANDIDATE.finditer(text):
        if not any(s < m.end() and m.start() < e for s, e in taken):
            yield m.span()


def _rests(text: str, taken: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Of each run that reaches out of the taken spans it meets: the whole run, then its parts of LEAST characters outside of them."""
    for m in _CANDIDATE.finditer(text):
        met = sorted(x for x in taken if x[0] < m.end() and m.start() < x[1])
        if met:
            gaps, at = [], m.start()
            for s, e in [*met, (m.end(), m.end())]:
                if s > at:
                    gaps.append((at, s))
                at = max(at, e)
            if gaps:
                yield [m.span(), *(g for g in gaps if g[1] - g[0] >= LEAST)]


def all_spans(text: str, grammars: Grammars | None, known: dict[str, bool] | None = None) -> list[tuple[int, int, str]]:
    """Base spans and added ones (kind ``format``), by start and then kind."""
    base = base_spans(text)
    out = [(s, e, kind) for s, e, kind, _, _ in base]
    if grammars:
        for s, e in _candidates(text, [x[:2] for x in base]):
            if grammars.accepts(text[s:e]):
                out.append((s, e, "format"))
        for whole, *parts in _rests(text, [x[:2] for x in base]):
            if grammars.accepts(text[slice(*whole)]):
                out.append((*whole, "format"))
            else:
                out += [(*part, "format") for part in parts if grammars.accepts(text[slice(*part)])]
        out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: set[tuple[str, str]] = set()
        for text in batch.column("text").to_pylist():
            if text:
                base = base_spans(text)
                out.update((kind, text[s:e]) for _, _, kind, s, e in base if e - s <= 512)
                out.update(("", text[s:e]) for s, e in _candidates(text, [x[:2] for x in base]) if e - s <= 512)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*sorted(out), strict=True) if out else ([], []))], ["kind", "secret"])


def fit_grammars(documents: DataFrame, sample: int = SAMPLE) -> Grammars:
    """Automata of the fixed kinds, from credentials that the fixed forms label in all documents.

    Of each kind the ``sample`` distinct credentials (up to 512 characters) with the smallest hashes are used, and as many
    ordinary candidates; repeats count once, so a hot credential weighs no more than another.
    """
    found = documents.select("text").mapInArrow(_labelled, "kind string, secret string")
    rank = F.xxhash64("secret", F.lit(3))
    slots = found.groupBy("kind", F.pmod(rank, F.lit(sample)).alias("slot")).agg(F.min_by("secret", F.struct(rank, "secret")).alias("secret"))
    rows = slots.orderBy("kind", "slot").collect()  # at most (kinds + 1) * sample rows
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r["kind"], []).append(r["secret"])
    words = by.pop("", [])
    return learn(by, words)


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch], grammars: Grammars | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"kind": k, "start": s, "end": e} for s, e, k in all_spans(t or "", grammars)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPAN)], ["doc_id", "spans"])


def _redact(batches: Iterator[pa.RecordBatch], grammars: Grammars | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        at = batch.schema.get_field_index("text")
        new = [redacted(t, grammars) if t else t for t in texts]
        columns = list(batch.columns)
        columns[at] = pa.array(new, batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def redacted(text: str, grammars: Grammars | None) -> str:
    """The text with each run of overlapping spans as ``[kind]`` of the first."""
    out, at = [], 0
    for s, e, kind in all_spans(text, grammars):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def secret_spans(documents: DataFrame, grammars: Grammars | None) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) for every row; null texts are empty; other columns are not read."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(lambda b: _scan(b, grammars), f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>")


def without_secrets(documents: DataFrame, grammars: Grammars | None) -> DataFrame:
    """All rows and columns, with the secrets in ``text`` replaced by their kinds."""
    return documents.mapInArrow(lambda b: _redact(b, grammars), documents.schema)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
