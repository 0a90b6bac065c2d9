"""Splitting long documents at natural boundaries: valleys of lexical cohesion chosen inside each size window, with overlap."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_points, texts_of
from ..session import map_arrow, ship, spread

#: Fixed values of the data: longest window and context on either side, in characters.
LIMIT, OVERLAP = 800, 100
#: Units on either side of a gap whose terms are compared, and buckets terms are hashed into.
BLOCK, BUCKETS = 6, 1 << 20
#: Share of the limit that a window has at least where a boundary lies beyond it, so that windows aren't cut into crumbs; 0 allows any.
LEAST = 0.25
#: A pause, the places after which a text may be cut: line breaks, marks with what white space follows them.
_PAUSE = re.compile(r"\n|[。！？]\s*|[.!?]\s+")


def boundaries(text: str) -> list[int]:
    """All natural boundaries in (0, len(text)], ascending.

    The text's end; right after a line break; right after 。！？ and after each white space directly following these; after . ! ? that
    white space follows, before, within and after that white space.
    """
    out = {len(text)} if text else set()
    for m in _PAUSE.finditer(text):
        a, b = m.span()
        out.update(range(a + 1, b + 1))
        # a line break inside the white space is itself in the range; one that starts the match is its only character
    return sorted(out)


@cache
def _kinds() -> np.ndarray:
    """For every code point: 0 for signs, blanks and digits, 1 for letters of scripts with words, 2 for Han, Kana and Thai."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x30000):
        if not 0xD800 <= cp < 0xE000 and (chr(cp).isalpha() or 0xE01 <= cp <= 0xE4E):
            out[cp] = 2 if 0xE01 <= cp <= 0xE4E or 0x3040 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF or cp >= 0x20000 else 1
    return out


@cache
def _folded() -> np.ndarray:
    """For every code point, the one it has in lower case."""
    return np.array([cp if 0xD800 <= cp < 0xE000 else ord(chr(cp).lower()[0]) for cp in range(0x110000)], np.uint32)


def terms_at(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the last sign, bucket) of each term: a word, or in scripts without blanks between words, two neighbouring signs."""
    kind = _kinds()[points]
    low = _folded()[points].astype(np.uint64)
    m = np.uint64(0x9E3779B97F4A7C15)
    mixed = (low + np.uint64(1)) * m
    mixed ^= mixed >> np.uint64(29)
    word = kind == 1
    first = word & ~np.concatenate([[False], word[:-1]])
    last = word & ~np.concatenate([word[1:], [False]])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    # the place of a sign in its word is part of its share of the word's number
    place = np.arange(len(points)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(points)]])))
    share = np.where(word, mixed * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)), np.uint64(0))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(share, dtype=np.uint64)])
    words = sums[ends + 1] - sums[starts]
    pairs = np.flatnonzero((kind[:-1] == 2) & (kind[1:] == 2)) if len(points) > 1 else np.zeros(0, np.int64)
    numbers = np.concatenate([words, mixed[pairs] * np.uint64(31) + mixed[pairs + 1]])
    return np.concatenate([ends, pairs + 1]), ((numbers * m) >> np.uint64(64 - 20)).astype(np.int64)


def _similarities(texts: list[str], cuts: list[list[int]]) -> list[np.ndarray]:
    """For each text, the cosine of the root counts of terms in the BLOCK units before and after each of its boundaries but the last.

    The products of two blocks are sums over pairs of units that hold the same term, each of which counts at a run of boundaries.
    """
    if not texts:
        return []
    points, starts = code_points([t + "\0" for t in texts])  # no term reaches from one text into another
    span = 2 * BLOCK
    ends = np.concatenate([np.asarray(c, np.int64) + s for c, s in zip(cuts, starts)])
    sizes = np.array([len(c) for c in cuts])
    first = np.cumsum([0, *(sizes + span)])  # texts stand so far apart that no block reaches from one into another
    number = np.arange(len(ends)) + np.repeat(first[:-1] - np.cumsum([0, *sizes[:-1]]), sizes)
    every = int(first[-1])
    at, term = terms_at(points)
    unit = number[np.searchsorted(ends, at, side="right")]
    key, n = np.unique(term * (every + span) + unit, return_counts=True)
    unit, n = key % (every + span), np.sqrt(n)
    before, after, both = (np.zeros(every + span + 1) for _ in range(3))

    def add(total: np.ndarray, low: np.ndarray, high: np.ndarray, w: np.ndarray) -> None:
        some = low <= high
        total += np.bincount(np.maximum(low[some], 0), w[some], len(total)) - np.bincount(np.maximum(high[some], -1) + 1, w[some], len(total))

    a, lag = np.arange(len(key)), 0
    while len(a):
        u, v = unit[a], unit[a + lag]
        w = n[a] * n[a + lag]
        near = v - u < BLOCK
        x, y, z = u[near], v[near], w[near] * (2 if lag else 1)
        add(before, y + 1, x + BLOCK, z)  # both units in the block before boundary g: v < g <= u + BLOCK
        add(after, y - BLOCK + 1, x, z)
        if lag:  # one on either side: u < g <= v, and both within BLOCK of it
            add(both, np.maximum(u + 1, v - BLOCK + 1), np.minimum(v, u + BLOCK), w)
        lag += 1
        a = a[a + lag < len(key)]
        a = a[key[a + lag] - key[a] < span]
    before, after, both = (np.cumsum(x) for x in (before, after, both))
    out = both / np.sqrt(np.maximum(before * after, 1e-12))
    return [out[f + 1 : f + k] for f, k in zip(first, sizes)]


def _depths(similarity: np.ndarray) -> np.ndarray:
    """How far each gap lies below the nearest peak on its left and on its right."""
    n, s = len(similarity), similarity.tolist()
    left, right = [0.0] * n, [0.0] * n
    peak = 0.0
    for k in range(n):
        peak = max(peak, s[k]) if k and s[k - 1] >= s[k] else s[k]
        left[k] = peak - s[k]
    for k in range(n - 1, -1, -1):
        peak = max(peak, s[k]) if k + 1 < n and s[k + 1] >= s[k] else s[k]
        right[k] = peak - s[k]
    return np.array(left) + np.array(right)


def windows(length: int, cuts: list[int], depth: list[float], limit: int = LIMIT, least: float = LEAST) -> list[tuple[int, int]]:
    """Consecutive windows of at most `limit` characters over [0, length).

    Each ends at the deepest valley among the boundaries of its size window that lie at least `least` of the limit away, the last of equal
    ones; where there are none, at the last boundary; without any, after exactly `limit` characters. A rest that fits is the last window.
    """
    out, start, k, n = [], 0, 0, len(cuts)
    while start < length:
        if length - start <= limit:
            out.append((start, length))
            break
        while k < n and cuts[k] <= start:
            k += 1
        best, last, j = -1, -1, k
        while j < n and cuts[j] <= start + limit:
            if cuts[j] >= start + least * limit and (best < 0 or depth[j] >= depth[best]):
                best = j
            last = j
            j += 1
        end = cuts[best] if best >= 0 else cuts[last] if last >= 0 else start + limit
        out.append((start, end))
        start = end
    return out


def segment(texts: list[str], limit: int = LIMIT) -> list[tuple[list[int], list[tuple[int, int]]]]:
    """(boundaries, chosen windows) of each text; one within the limit is one window."""
    cuts = [boundaries(t) for t in texts]
    long = [k for k, t in enumerate(texts) if len(t) > limit]
    out = [(c, [(0, len(t))] if t else []) for t, c in zip(texts, cuts)]
    for k, s in zip(long, _similarities([texts[k] for k in long], [cuts[k] for k in long])):
        out[k] = (cuts[k], windows(len(texts[k]), cuts[k], [*_depths(s).tolist(), 0.0], limit))
    return out


def cohesion_windows(docs: DataFrame, limit: int = LIMIT, longer_than: int = LIMIT) -> DataFrame:
    """doc_id, n_chars, boundaries, windows of each document of more than `longer_than` characters; null texts have none.

    One narrow pass; only positions leave it.
    """
    ship(docs.sparkSession)
    schema = "doc_id bigint, n_chars int, boundaries array<int>, windows array<struct<start:int,end:int>>"
    window = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(1))
            done = [x for k in range(0, len(texts), 256) for x in segment(texts[k : k + 256], limit)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int32()), pa.array([c for c, _ in done], pa.list_(pa.int32())), pa.array([[{"start": a, "end": b} for a, b in w] for _, w in done], window)],
                names=["doc_id", "n_chars", "boundaries", "windows"],
            )

        return work

    return map_arrow(spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).where(F.length("text") > longer_than), make, schema)


def chunks(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, longer_than: int = LIMIT) -> DataFrame:
    """doc_id, chunk_id, chunk_start, chunk_end, context_start, context_end: the windows, with `overlap` characters of context on both sides.

    The windows of a document are consecutive, cover it, and hold at most `limit` characters. Repeated rows repeat their windows.
    """
    spans = cohesion_windows(docs, limit, longer_than).select("doc_id", "n_chars", F.posexplode("windows").alias("chunk_id", "w"))
    return spans.select(
        "doc_id", "chunk_id", F.col("w.start").alias("chunk_start"), F.col("w.end").alias("chunk_end"),
        F.greatest(F.lit(0), F.col("w.start") - overlap).alias("context_start"), F.least("n_chars", F.col("w.end") + overlap).alias("context_end"),
    )


def admits(cuts: list[int], start: int, end: int, limit: int = LIMIT) -> bool:
    """Whether a window may end there: at one of the boundaries among which the segmentation chooses, or after `limit` characters where it has none."""
    low = bisect_right(cuts, start)
    high = bisect_right(cuts, start + limit, low)
    at = bisect_left(cuts, end, low, high)
    return at < high and cuts[at] == end if high > low else end - start == limit


def wrong_chunks(docs: DataFrame, recorded: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_id of the recorded chunks that break a rule of the windows.

    Each is held against the segmentation of its text: a window that this chooses is right; of another, the end must be one of the boundaries that
    the segmentation chooses among. Only positions are joined. Repeated rows count once. A chunk after one whose chunk_end is null does not start
    at a recorded end and is reported. Chunks of unknown documents, or of those without a text, have no valid extent and are reported; those of a text
    within the limit must end with it. A null chunk_id sorts first and is reported; chunks of a null doc_id are reported as well, without being brought
    together.
    """
    ship(docs.sparkSession)
    fields = ["doc_id", "chunk_id", "chunk_start", "chunk_end", "context_start", "context_end"]
    rows = recorded.select(*[F.col(c).cast("bigint" if c == "doc_id" else "int").alias(c) for c in fields])
    nameless = rows.where("doc_id is null").select("doc_id", "chunk_id").distinct()
    lists = rows.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set(F.struct(*fields[1:])).alias("own"))
    known = cohesion_windows(docs, limit, -1)

    def judged(size: int | None, cuts: list[int], chosen: list[dict], own: list[dict]) -> set[int | None]:
        order = sorted((tuple(x[c] for c in fields[1:]) for x in own), key=lambda x: tuple((v is not None, v or 0) for v in x))
        right = {(x["start"], x["end"]) for x in chosen or ()}
        wrong, before = set(), 0
        for k, (no, start, end, low, high) in enumerate(order):
            fine = size is not None and None not in (no, start, end, low, high) and start == before and start < end <= size and end - start <= limit
            fine = fine and low == max(0, start - overlap) and high == min(size, end + overlap) and (k + 1 < len(order) or end == size)
            if not (fine and ((start, end) in right or admits(cuts, start, end, limit))):
                wrong.add(no)
            before = end
        return wrong

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(d, no) for d, *x in zip(*(batch.column(k).to_pylist() for k in range(5))) for no in judged(*x)]
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([no for _, no in found], pa.int32())], names=["doc_id", "chunk_id"])

    joined = lists.join(known, "doc_id", "left").select("doc_id", "n_chars", "boundaries", "windows", "own")
    return map_arrow(joined, lambda: work, "doc_id bigint, chunk_id int").unionByName(nameless)
