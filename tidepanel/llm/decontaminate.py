"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every word sequence of the benchmark's items. A document's words are
streamed through it; at each word it gives the length of the longest sequence ending there
that some item contains. Where that length reaches the window (ten words, or a whole
shorter item) the words are hit. Only runs of words whose neighbours occur side by side in
the benchmark are streamed, as no window can reach outside such a run.

The automaton is as large as the benchmark, not the corpus, and goes along with the tasks'
code. A benchmark of more than ``AUTOMATON_WORDS`` words is dealt over several automata,
each applied to all documents, and their spans are joined.

Defined results: null and wordless texts have no words and no hits; items without words
hit nothing; items with equal texts are all reported; a null item_id is reported as
"null"; rows that repeat a doc_id keep a row each; an empty benchmark hits nothing; other
columns are left as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import bounded, fresh_name, numbered, utf8_of, with_text
from tidepanel.session import stage

WINDOW = 10
AUTOMATON_WORDS = 2_000_000
PAIR_BITS = 22

# Bytes that are no part of a word: all ASCII but digits and letters. A-Z become a-z.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD_AT = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class SuffixAutomaton:
    """Of the word sequences of several items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.words.setdefault(w, len(self.words) + 1) for w in words]) for name, words in items if words]
        for _, sequence in coded:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self.shortest = min((min(len(s), window) for _, s in coded), default=window)
        self._name_items(coded)
        size = 1 << PAIR_BITS
        self._pairs = np.zeros(size, bool)
        for _, sequence in coded:
            s = np.array(sequence, np.int64)
            self._pairs[self._pair_slots(s)] = True

    @staticmethod
    def _pair_slots(s: np.ndarray) -> np.ndarray:
        return (s[:-1] * 0x9E3779B1 + s[1:] * 0x85EBCA77) >> 7 & (1 << PAIR_BITS) - 1

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.length) - 1

    def _split(self, source: int, word: int, target: int) -> int:
        """A copy of ``target`` for its suffixes that are one word longer than ``source``."""
        copy = self._state(self.length[source] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while source >= 0 and self.next[source].get(word) == target:
            self.next[source][word] = copy
            source = self.link[source]
        return copy

    def _extend(self, last: int, word: int) -> int:
        """State of the sequence of ``last`` followed by ``word``."""
        target = self.next[last].get(word)
        if target is not None:
            fits = self.length[target] == self.length[last] + 1
            return target if fits else self._split(last, word, target)
        new, source = self._state(self.length[last] + 1, 0, {}), last
        while source >= 0 and word not in self.next[source]:
            self.next[source][word] = new
            source = self.link[source]
        if source >= 0:
            target = self.next[source][word]
            fits = self.length[target] == self.length[source] + 1
            self.link[new] = target if fits else self._split(source, word, target)
        return new

    def _name_items(self, coded: list[tuple[str, list[int]]]) -> None:
        """Items by the state that stands for a window of theirs."""
        self.items: dict[int, list[int]] = {}
        self.names = [name for name, _ in coded]
        self.short: dict[int, list[int]] = {}
        for k, (_, sequence) in enumerate(coded):
            state, seen = 0, set()
            for at, word in enumerate(sequence, 1):
                state = self.next[state][word]
                if at >= self.window and (home := self.home(state, self.window)) not in seen:
                    seen.add(home)
                    self.items.setdefault(home, []).append(k)
            if len(sequence) < self.window:
                self.short.setdefault(self.home(state, len(sequence)), []).append(k)
        self._short_length = {state: len(coded[ks[0]][1]) for state, ks in self.short.items()}
        # nearest state with a short item on the way to the root, itself included
        self._short_from = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self._short_from[state] = state if state in self.short else self._short_from[self.link[state]]

    def home(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a state's sequences."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (first word, word after the last), merged, and the items' places."""
        get = self.words.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        if not len(ids):
            return [], set()
        known = ids > 0
        # run: words that may follow one another inside an item
        linked = np.zeros(len(ids) + 1, bool)
        linked[1:-1] = self._pairs[self._pair_slots(ids)] & known[:-1] & known[1:]
        opens = np.flatnonzero(known & ~linked[:-1])
        closes = np.flatnonzero(known & ~linked[1:]) + 1
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for a, b in zip(opens.tolist(), closes.tolist(), strict=True):
            if b - a >= self.shortest:
                self._stream(ids[a:b].tolist(), a, spans, items)
        return merged(spans), items

    def _stream(self, ids: list[int], first: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        state = matched = 0
        for at, word in enumerate(ids, first + 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            if matched >= self.window:
                spans.append((at - self.window, at))
                items.update(self.items[self.home(state, self.window)])
            near = self._short_from[state]
            while near > 0:
                length = self._short_length[near]
                if length <= matched:
                    spans.append((at - length, at))
                    items.update(self.short[near])
                near = self._short_from[self.link[near]]


def shard_count(benchmark: DataFrame, text_col: str = "text") -> int:
    """Automata of bounded size that a benchmark needs."""
    # a word takes two bytes at least, with what separates it
    size = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-size // (2 * AUTOMATON_WORDS)))


def automaton_of(
    benchmark: DataFrame, shard: int, shards: int, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text"
) -> SuffixAutomaton:
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard)
    rows = own.collect()  # bounded by the size of a shard
    return SuffixAutomaton([("null" if r[0] is None else r[0], words_of(bytes(r[1] or b""))) for r in rows], window)


SPANS = "array<struct<first:int,end:int>>"
_SPAN_LIST = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    found: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


def _scan(rows: DataFrame, text_col: str, keep: list[str], names: tuple[str, str, str], automaton: SuffixAutomaton) -> DataFrame:
    """The kept columns with words, spans and items of each row, so named, in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast(automaton)
    kept = rows.select(*[F.col(f"`{c}`") for c in keep])
    rows, spot = with_text(rows, keep, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in bounded(batches, spot):
            n, spans, items = [], [], []
            for text in utf8_of(batch.column(spot)):
                words = words_of(text)
                found, hit = automaton.scan(words)
                n.append(len(words))
                spans.append([{"first": a, "end": b} for a, b in found])
                items.append([automaton.names[k] for k in sorted(hit)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(spans, _SPAN_LIST), pa.array(items, pa.list_(pa.string()))],
                [*keep, *names],
            )

    return rows.mapInArrow(scan, _schema(kept, names))


def _schema(kept: DataFrame, names: tuple[str, str, str]) -> str:
    """The columns of ``kept``, then words, spans and items."""
    own = zip(names, ("long", SPANS, "array<string>"), strict=True)
    return ", ".join(f"`{c}` {t}" for c, t in [*[(f.name, f.dataType.simpleString()) for f in kept.schema], *own])


def _merge_spans(rows: DataFrame, row: str, names: tuple[str, str, str]) -> DataFrame:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"first": a, "end": b} for a, b in merged([(s["first"], s["end"]) for s in row])]
                for row in batch.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(spans, _SPAN_LIST), batch.column(3)], batch.schema.names)

    return rows.mapInArrow(merge, _schema(rows.select(row), names))


def with_hits(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, text_col: str = "text", item_col: str = "item_id"
) -> tuple[DataFrame, tuple[str, str, str]]:
    """The columns of ``keep`` and three more, with their names: the number of words, the
    hit words (spans of first and end, merged) and the ids of the items with windows in
    the text. The names differ from all of ``keep``."""
    names = fresh_name(keep, "_words"), fresh_name(keep, "_spans"), fresh_name(keep, "_items")
    shards = shard_count(benchmark)
    if shards == 1:
        return _scan(docs, text_col, keep, names, automaton_of(benchmark, 0, 1, window, item_col)), names
    # numbered rows, so that each finds its spans of all automata
    rows, row = numbered(docs, "decontaminate-rows")
    found = [
        stage(_scan(rows, text_col, [row], names, automaton_of(benchmark, k, shards, window, item_col)), "decontaminate-spans")
        for k in range(shards)
    ]
    every = reduce(DataFrame.unionByName, found)
    words, spans, items = names
    joined = every.groupBy(row).agg(
        F.max(words).alias(words), F.flatten(F.collect_list(spans)).alias(spans), F.array_distinct(F.flatten(F.collect_list(items))).alias(items)
    )
    together = rows.join(_merge_spans(joined, row, names), row)
    return together.select(*[F.col(f"`{c}`") for c in (*keep, *names)]), names


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """Per row: doc_id, n_words, spans, items."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found, (words, spans, items) = with_hits(rows, benchmark, ["doc_id"], window, "text", item_col)
    return found.select("doc_id", F.col(words).alias("n_words"), F.col(spans).alias("spans"), F.array_distinct(items).alias("items"))


def hit_words(spans: str):
    """Number of words in merged spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["first"]).cast("long"))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what stands around them stays."""
    raw = text.encode("utf-8")
    places = [m.span() for m in _WORD_AT.finditer(raw.translate(_WORDS))]
    kept, at = [], 0
    for first, end in spans:
        kept.append(raw[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    max_span: int = 0,
    max_coverage: float = 0.2,
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """Documents with more than ``max_coverage`` of their words hit go; from the others,
    hit spans longer than ``max_span`` words are cut out. All columns stay as they are."""
    columns = docs.columns
    spot = columns.index(text_col)
    found, (words, hit, _) = with_hits(docs, benchmark, columns, window, text_col, item_col)
    kept = found.where(hit_words(hit) <= max_coverage * F.col(words)).select(*[F.col(f"`{c}`") for c in columns], hit)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, spot):
            spans = batch.column(len(columns)).to_pylist()
            texts = batch.column(spot)
            if any(spans):
                long = [[(s["first"], s["end"]) for s in row if s["end"] - s["first"] > max_span] for row in spans]
                texts = pa.array([cut_spans(t, own) if own else t for t, own in zip(texts.to_pylist(), long, strict=True)], texts.type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:spot], texts, *batch.columns[spot + 1 : len(columns)]], columns)

    # with no coverage allowed nothing is left to cut
    return kept.drop(hit) if max_coverage <= 0 else kept.mapInArrow(cut, docs.schema)
