"""Evaluation passages inside training text, by a generalised suffix automaton of the test items."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import letters_and_digits, texts_of
from ..session import cut, map_arrow, ship, spread

#: Share of an item's letters and digits that must stand in a document as one stretch.
COVERAGE = 0.4
#: Characters of items one automaton may hold; more items are handled in blocks, one pass over the documents each.
BLOCK_CHARS = 4_000_000


class SuffixAutomaton:
    """Suffix automaton of several strings. The occurrences of a state's substrings are a run of one array, in the order of the tree of
    suffix links, so its size is that of the strings."""

    def __init__(self, strings: list[str], need: list[int]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[int] = []
        for s in strings:
            last = 0
            for c in s:
                last = self._extend(last, c)
                ends.append(last)
        self._list_occurrences(np.array(ends, np.int64), np.repeat(np.arange(len(strings)), [len(s) for s in strings]), np.array(need, np.int64))

    def _state(self, length: int, link: int, moves: dict[str, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, c: str) -> int:
        known = self.next[last].get(c)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, c, known)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: str, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _list_occurrences(self, ends: np.ndarray, owner: np.ndarray, need: np.ndarray) -> None:
        """low, high: each state's run of `holders`; least: the smallest need among its strings."""
        n = len(self.link)
        counts = np.bincount(ends, minlength=n)
        shortest = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(shortest, ends, need[owner])
        by_length = sorted(range(1, n), key=self.length.__getitem__, reverse=True)
        total = counts.tolist()
        least = shortest.tolist()
        for v in by_length:
            u = self.link[v]
            total[u] += total[v]
            if least[v] < least[u]:
                least[u] = least[v]
        low = [0] * n
        free = counts.tolist()  # where the next child of a state begins: behind the state's own occurrences
        for v in reversed(by_length):
            u = self.link[v]
            low[v] = low[u] + free[u]
            free[u] += total[v]
        order = np.argsort(np.asarray(low)[ends], kind="stable") if len(ends) else np.zeros(0, np.int64)
        self.holders = owner[order]
        self.low, self.high, self.least, self.need = low, [a + t for a, t in zip(low, total)], least, need
        self._strings: dict[int, list[tuple[int, int]]] = {}

    def strings_of(self, state: int) -> list[tuple[int, int]]:
        """(need, string) of the strings that hold a state's substrings, by need."""
        known = self._strings.get(state)
        if known is None:
            own = np.unique(self.holders[self.low[state] : self.high[state]])
            known = self._strings[state] = sorted(zip(self.need[own].tolist(), own.tolist()))
        return known

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(end, state, length) of the longest match that ends at each place of the text."""
        state = length = 0
        moves, link, lengths = self.next, self.link, self.length
        for end, c in enumerate(text, 1):
            while state and c not in moves[state]:
                state = link[state]
                length = lengths[state]
            to = moves[state].get(c)
            if to is None:
                state = length = 0
            else:
                state, length = to, length + 1
            yield end, state, length


class _Group:
    """Items of which alike many letters must recur, with their automaton and the short blocks that admit a text."""

    def __init__(self, ids: list[int], strings: list[str], need: list[int]):
        self.ids, self.least = ids, min(need)
        # a stretch of 2q-1 characters holds a whole block of q characters that starts at a multiple of q
        self.q = max(1, (self.least + 1) // 2)
        self.grams = {n[k : k + self.q] for n in strings for k in range(len(n) - self.q + 1)}
        self.automaton = SuffixAutomaton(strings, need)

    def found(self, norm: str) -> dict[int, list[list[int]]]:
        q, grams = self.q, self.grams
        out: dict[int, list[list[int]]] = {}
        if grams.isdisjoint([norm[k : k + q] for k in range(0, len(norm) - q + 1, q)]):
            return out
        automaton = self.automaton
        for end, state, length in automaton.matches(norm):
            v, size = state, length
            while size >= self.least:
                if size >= automaton.least[v]:
                    for need, k in automaton.strings_of(v):
                        if need > size:
                            break
                        spans = out.setdefault(k, [])
                        if spans and end - size <= spans[-1][1]:  # goes on, or overlaps: one stretch to take out; the longest match counts
                            last = spans[-1]
                            last[0], last[1] = min(last[0], end - size), end
                            if size > last[2]:
                                last[2], last[3] = size, end
                        else:
                            spans.append([end - size, end, size, end])
                v = automaton.link[v]
                size = automaton.length[v]
        return {self.ids[k]: spans for k, spans in out.items()}


class Items:
    """Normalised test items, kept apart by how many of their letters must recur: a short item slows nothing down for long ones."""

    def __init__(self, rows: Iterable[tuple[int, str]], coverage: float = COVERAGE):
        groups: dict[int, list[tuple[int, str, int]]] = {}
        self.sizes: dict[int, int] = {}
        for i, t in rows:
            if n := letters_and_digits(t or ""):
                need = max(1, math.ceil(coverage * len(n) - 1e-9))
                groups.setdefault(need.bit_length(), []).append((i, n, need))
                self.sizes[i] = len(n)
        self.groups = [_Group(*map(list, zip(*own))) for _, own in sorted(groups.items())]

    def found(self, text: str) -> dict[int, list[list[int]]]:
        """Item id -> stretches [start, end, longest match, its end] in the normalised text, of the items the text leaks."""
        norm = letters_and_digits(text)
        out: dict[int, list[list[int]]] = {}
        for group in self.groups:
            for i, spans in group.found(norm).items():
                out.setdefault(i, []).extend(spans)
        return out


class Places:
    """Where the letters and digits of a normalised text stand in the text itself: signs that normalise together have one place."""

    def __init__(self, text: str):
        clusters = regex.findall(r"\X", text)
        self.ends = np.cumsum([len(c) for c in clusters])
        self.letters = np.cumsum([_letters(c) for c in clusters])
        if len(clusters) and self.letters[-1] != len(letters_and_digits(text)):  # signs of different clusters went together: grow the text sign by sign
            self.ends = np.arange(1, len(text) + 1)
            self.letters = np.maximum.accumulate([len(letters_and_digits(text[:k])) for k in self.ends])

    def span(self, start: int, end: int) -> tuple[int, int]:
        """From the place of the first letter of a stretch to that of its last."""
        first, last = np.searchsorted(self.letters, (start, end - 1), side="right")
        return int(self.ends[first - 1]) if first else 0, int(self.ends[last])


@lru_cache(1 << 16)
def _letters(cluster: str) -> int:
    return len(letters_and_digits(cluster))


_BUILT: dict[str, Items] = {}


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most so many characters, one at a time."""
    block, room = [], block_chars
    for row in items.select("item_id", "text").distinct().orderBy("item_id").toLocalIterator():
        n = len(row.text or "")
        if n > room and block:
            yield block
            block, room = [], block_chars
        block.append((row.item_id, row.text))
        room -= n
    yield block


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def passages(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, item_id, matched, span_start, span_end, item_chars, spans: each item of which a document holds an unbroken stretch of at least
    `coverage` of the item's letters and digits; where its longest stretch stands in the document's text; and all such stretches, those that overlap
    as one. matched and item_chars count letters and digits.

    Items come to the driver in blocks of at most block_chars characters; each block is one pass over the documents without a shuffle, and where
    there are several, its passages are written before the next one comes. Null, empty and punctuation-only texts and items leak nothing;
    repeated documents yield one row; equal items are all reported. Other columns of either table are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id bigint, item_id bigint, matched int, span_start int, span_end int, item_chars int, spans array<struct<start:int,end:int>>"
    source = spread(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")))

    def pass_of(block: list[tuple[int, str]]) -> tuple[DataFrame, object]:
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def make():
            known = _BUILT.get(name)
            if known is None:  # once for each Python worker, which keeps it for its next tasks
                _BUILT.clear()
                known = _BUILT[name] = Items(sent.value, coverage)

            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                rows = []
                for d, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                    found = known.found(t)
                    places = Places(t) if found else None
                    for i, spans in found.items():
                        best = max(spans, key=lambda s: s[2])
                        rows.append((d, i, best[2], *places.span(best[3] - best[2], best[3]), known.sizes[i], [dict(zip(("start", "end"), places.span(a, b))) for a, b, *_ in spans]))
                columns = list(zip(*rows)) if rows else [[]] * 7
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, _SPAN]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema=pa.schema(list(zip(("doc_id", "item_id", "matched", "span_start", "span_end", "item_chars", "spans"), kinds))))

            return work

        return map_arrow(source, make, schema), sent

    found: list[DataFrame] = []
    held = None
    for block in _blocks(items, block_chars):
        if held:  # there are several: what the last block found is written, then its items go
            found[-1] = cut(found[-1])
            held.destroy()
        part, held = pass_of(block)
        found.append(part)
    return reduce(DataFrame.unionByName, found).dropDuplicates(["doc_id", "item_id"])


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The passages without the list of all stretches."""
    return passages(docs, items, coverage, block_chars).drop("spans")


def cleaned(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, text, removed: every document without the stretches of test items it holds, and how many characters that took out.

    Overlapping stretches of several items go as one. What stands before and after a stretch stays as it is. A null text stays null. Repeated
    documents repeat.
    """
    ship(docs.sparkSession)
    spans = passages(docs, items, coverage).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, removed = [], []
        for t, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            out, at = [], 0
            for a, b in sorted((s["start"], s["end"]) for s in own or ()):
                if b > at:
                    out.append(t[at : max(at, a)])
                    at = b
            kept = t if not own else "".join([*out, t[at:]])
            texts.append(kept)
            removed.append(len(t or "") - len(kept or ""))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["doc_id", "text", "removed"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(spans, "doc_id", "left"), lambda: work, "doc_id bigint, text string, removed int")
