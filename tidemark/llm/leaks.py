"""Passages of evaluation items in a corpus, by a generalised suffix automaton over words.

The automaton of all items accepts exactly the word sequences that occur in some item. Document words
are streamed through it: the state is the longest sequence that ends at the current word and occurs in
an item, its length the matching length. Where the length reaches ``min_words`` the state is led back
to the one that holds the last ``min_words`` words, which knows all items with that passage.

A word that is in no item, and a pair of neighbours that no item has, drop the matching length to 0 or
1 whatever came before. These places are found for a whole batch of documents at once by array
operations, and only stretches between them that are long enough are streamed.

The automaton has at most two states and three transitions per word of the items. Items are divided into
groups of at most ``words_per_automaton`` words, each one automaton; once built it is packed into sorted
arrays of about 90 bytes a word. ``automata_per_pass`` of them are sent to the tasks for one pass over the
corpus, further ones in further passes. So what is broadcast has a bound (about 160 MB with the defaults)
however many items there are.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable

WORD = re.compile("[a-z0-9]+")
WORDS_PER_AUTOMATON = 250_000
AUTOMATA_PER_PASS = 8
FOUND = "item_id long, doc_id long, covered_words long, doc_words long"
SPANS = "doc_id long, text string, longest long, spans array<long>"
MARKED = "doc_id long, doc_words long, leaked_words long, longest long, n_spans long, clean_text string"


@dataclass
class Automaton:
    """Transitions, suffix links and lengths by state; ``items_at[s]`` are the items that contain the
    ``min_words`` words that state ``home[s]`` stands for."""

    min_words: int
    vocabulary: dict[str, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    home: list[int] = field(default_factory=list)
    items_at: dict[int, list[int]] = field(default_factory=dict)
    neighbours: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the sequence p + c where q also stands for longer ones."""
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def build(self, items: list[tuple[int, str]]) -> Automaton:
        coded = []
        pairs: set[tuple[int, int]] = set()
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in WORD.findall(text.lower())]
            coded.append((item, words))
            pairs.update(zip(words, words[1:]))
            last = 0
            for c in words:
                last = self._extend(last, c)
        size = len(self.vocabulary)
        self.neighbours = np.array(sorted(a * size + b for a, b in pairs), dtype=np.int64)
        n = self.min_words
        self.home = [-1] * len(self.step)
        # links lead to shorter sequences: in order of length each state can ask its link
        for s in sorted(range(len(self.step)), key=self.length.__getitem__):
            if self.length[s] >= n:
                up = self.link[s]
                self.home[s] = self.home[up] if self.length[up] >= n else s
        at: dict[int, set[int]] = {}
        for item, words in coded:
            s = 0
            for c in words:
                s = self.step[s][c]
                if self.length[s] >= n:
                    at.setdefault(self.home[s], set()).add(item)
        self.items_at = {s: sorted(found) for s, found in at.items()}
        return self

    def packed(self) -> Matcher:
        size = len(self.vocabulary)
        moves = np.array(sorted((state * size + c, to) for state, step in enumerate(self.step) for c, to in step.items()), dtype=np.int64).reshape(-1, 2)
        at = sorted(self.items_at)
        starts = np.cumsum([0, *(len(self.items_at[s]) for s in at)])
        ints = lambda xs, kind="i": array(kind, np.asarray(xs, dtype=np.int64 if kind == "q" else np.int32).tobytes())
        return Matcher(
            self.min_words, pa.array(list(self.vocabulary), pa.large_string()), self.neighbours, ints(moves[:, 0], "q"), ints(moves[:, 1]), ints(self.link), ints(self.length), ints(self.home),
            ints(at), ints(starts), ints([i for s in at for i in self.items_at[s]], "q"),
        )


@dataclass
class Matcher:
    """An automaton in arrays: the transition of a state by a word stands at state * words + word in ``moves``."""

    min_words: int
    words: pa.Array
    neighbours: np.ndarray
    moves: array
    targets: array
    link: array
    length: array
    home: array
    ends: array
    item_starts: array
    item_ids: array

    def stream(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and matching length after each word; a word that is in no item is -1."""
        moves, targets, link, length, size, n = self.moves, self.targets, self.link, self.length, len(self.words), len(self.moves)
        s = matched = 0
        for c in words:
            while True:
                key = s * size + c
                k = bisect_left(moves, key) if c >= 0 else n
                if k < n and moves[k] == key:
                    s = targets[k]
                    matched += 1
                    break
                if not s:
                    matched = 0
                    break
                s = link[s]
                matched = length[s]
            yield s, matched

    def items(self, state: int) -> array:
        """Items with the ``min_words`` words that end where the state was reached."""
        k = bisect_left(self.ends, self.home[state])
        return self.item_ids[self.item_starts[k] : self.item_starts[k + 1]]


def _words(texts: list[str | None]) -> pa.ListArray:
    lowered = pa.array([t.lower() if t else "" for t in texts], pa.large_string())
    return pc.split_pattern_regex(lowered, pattern="[^a-z0-9]+")


def _batches(batch: pa.RecordBatch, most: int = 16_000_000) -> Iterator[tuple[list, list]]:
    """Ids and texts of a batch in pieces of bounded size; a single text is never cut."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield ids[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(ids):
        yield ids[start:], texts[start:]


def matches(automaton: Matcher, texts: list[str | None]) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """Of each text with a passage: its row, its words, and (end, length, state) of every match.

    ``end`` is the place of the passage's last word, from 0.
    """
    n, size = automaton.min_words, len(automaton.words)
    lists = _words(texts)
    flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(flat), 0)
    flat, row = flat.filter(real), row[real.to_numpy(zero_copy_only=False)]
    if not len(flat) or not size:
        return
    known = pc.index_in(flat, value_set=automaton.words)
    codes = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    start_of = np.searchsorted(row, np.arange(len(texts)))
    words_of = np.diff(np.r_[start_of, len(row)])
    pair = codes[:-1] * size + codes[1:]
    place = np.searchsorted(automaton.neighbours, pair)
    place[place == len(automaton.neighbours)] = 0
    ok = (row[1:] == row[:-1]) & (codes[:-1] >= 0) & (codes[1:] >= 0)
    ok &= automaton.neighbours[place] == pair if len(automaton.neighbours) else False
    edge = np.flatnonzero(np.diff(np.r_[0, ok.view(np.int8), 0]))
    begins, ends = edge[::2], edge[1::2]
    stretches = np.flatnonzero(ends - begins + 1 >= n)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k in stretches.tolist():
        lo, hi = int(begins[k]), int(ends[k])
        doc = int(row[lo])
        for i, (state, length) in enumerate(automaton.stream(codes[lo : hi + 1].tolist())):
            if length >= n:
                found.setdefault(doc, []).append((lo + i - int(start_of[doc]), length, state))
    for doc, hits in found.items():
        yield doc, int(words_of[doc]), hits


def _covered(ends: list[int], n: int) -> int:
    """Words covered by passages of ``n`` words that end at ``ends`` (ascending)."""
    total, upto = 0, -1
    for e in ends:
        total += e - max(upto, e - n)
        upto = e
    return total


def _find(automata_: list, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in _batches(batch):
            out: list[tuple[int, int, int, int]] = []
            for automaton in automata_:
                for doc, n_words, hits in matches(automaton, texts):
                    by_item: dict[int, list[int]] = {}
                    for end, _, state in hits:
                        for item in automaton.items(state):
                            by_item.setdefault(item, []).append(end)
                    out += [(i, ids[doc], _covered(ends, automaton.min_words), n_words) for i, ends in by_item.items()]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["item_id", "doc_id", "covered_words", "doc_words"])


def automata(items: DataFrame, item: str, text: str, min_words: int, words_per_automaton: int) -> Iterator[Matcher]:
    """Automata of the items, read part by part; a part has at most ``words_per_automaton`` words, or one item."""
    part: list[tuple[int, str]] = []
    words = 0
    for r in items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(item, text).toLocalIterator():
        n = len(WORD.findall(r[1].lower()))
        if part and words + n > words_per_automaton:
            yield Automaton(min_words).build(part).packed()
            part, words = [], 0
        part.append((r[0], r[1]))
        words += n
    if part:
        yield Automaton(min_words).build(part).packed()


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    min_words: int = 13,
    words_per_automaton: int = WORDS_PER_AUTOMATON,
    automata_per_pass: int = AUTOMATA_PER_PASS,
) -> DataFrame:
    """``item_id, doc_id, covered_words, doc_words``: documents with ``min_words`` or more consecutive words of an item.

    A word is a longest run of a-z and 0-9 after lower-casing. ``covered_words`` are the document's
    words within such passages of the item. Null and empty texts match nothing, items of fewer words
    neither. Equal items are all reported; a document id on several rows is reported per row. Ids are
    long. An empty table on either side gives no row. ``min_words`` is at least 2.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    spark = documents.sparkSession
    corpus = documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    parts = None
    for group in batched(automata(items, item, item_text, min_words, words_per_automaton), automata_per_pass):
        sent = spark.sparkContext.broadcast(list(group))
        part = corpus.mapInArrow(lambda batches, sent=sent: _find(sent.value, batches), FOUND)
        parts = part if parts is None else parts.unionByName(part)
    return spark.createDataFrame([], FOUND) if parts is None else parts


def _places(text: str) -> list[tuple[int, int]]:
    """Where each word begins and ends in the text as it is, also where lower-casing changes its length."""
    lowered = text.lower()
    spans = [m.span() for m in WORD.finditer(lowered)]
    if len(lowered) == len(text):
        return spans
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[a], origin[b - 1] + 1) for a, b in spans]


def _mark(automata_: list, rows: tuple[list, list, list, list]) -> None:
    """Add the spans of the automata to rows of ids, texts, longest match and spans (first and last word in turn)."""
    _, texts, longest, spans = rows
    for automaton in automata_:
        for doc, _, hits in matches(automaton, texts):
            spans[doc] = [*(spans[doc] or []), *(x for end, length, _ in hits for x in (end - length + 1, end))]
            longest[doc] = max(longest[doc] or 0, max(length for _, length, _ in hits))


def _cut(id_: int, text: str | None, longest: int | None, spans: list[int] | None) -> tuple:
    """A row of MARKED: the text without its spans."""
    if not spans:
        return id_, None, 0, 0, 0, text
    merged: list[list[int]] = []
    for lo, hi in sorted(zip(spans[::2], spans[1::2])):
        if merged and lo <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    places = _places(text)
    kept, at = [], 0
    for lo, hi in merged:
        kept.append(text[at : places[lo][0]])
        at = places[hi][1]
    kept.append(text[at:])
    return id_, len(places), sum(hi - lo + 1 for lo, hi in merged), longest, len(merged), "".join(kept)


def _clean(automata_: list, last: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass: mark spans, and cut them out if it is the last."""
    for batch in batches:
        start = 0
        for ids, texts in _batches(batch):
            part = batch.slice(start, len(ids))
            start += len(ids)
            rows = (ids, texts, part.column(2).to_pylist(), part.column(3).to_pylist())
            _mark(automata_, rows)
            if last:
                kinds, names = [pa.int64()] * 5 + [pa.string()], ["doc_id", "doc_words", "leaked_words", "longest", "n_spans", "clean_text"]
                rows = tuple(zip(*(_cut(*r) for r in zip(*rows))))
            else:
                kinds, names = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())], ["doc_id", "text", "longest", "spans"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)


def remove_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    min_words: int = 13,
    coverage_limit: float = 0.5,
    words_per_automaton: int = WORDS_PER_AUTOMATON,
    automata_per_pass: int = AUTOMATA_PER_PASS,
) -> DataFrame:
    """Every document without its leaked spans: ``doc_id, doc_words, leaked_words, longest, n_spans, clean_text, dropped``.

    A span is a stretch in which the matching length reaches ``min_words``; overlapping and adjoining
    spans count once. A document whose leaked words are more than ``coverage_limit`` of its words is
    ``dropped`` and its clean text null. ``doc_words`` is null for documents without a span. Null texts
    stay null; what is kept of a text is kept as it is. Items beyond ``automata_per_pass`` automata go
    through further passes, each written, and spans of all passes are cut together.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(None).cast("long").alias("longest"), F.lit(None).cast("array<long>").alias("spans"))
    groups = batched(automata(items, item, item_text, min_words, words_per_automaton), automata_per_pass)
    group = next(groups, ())
    while True:
        after = next(groups, None)
        sent = spark.sparkContext.broadcast(list(group))
        marked = rows.mapInArrow(lambda batches, sent=sent, last=after is None: _clean(sent.value, last, batches), MARKED if after is None else SPANS)
        if after is None:
            break
        rows, group = durable(marked), after
        sent.unpersist()
    over = F.coalesce(F.col("leaked_words") > F.col("doc_words") * coverage_limit, F.lit(False))
    return marked.withColumn("dropped", over).withColumn("clean_text", F.when(~over, F.col("clean_text")))
