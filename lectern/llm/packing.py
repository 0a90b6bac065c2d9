"""Filling containers of fixed capacity with documents: length patterns fitted to the length histogram by non-negative least squares."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut, map_arrow, ship, small_rows

#: Length classes per capacity. The histogram, the patterns and the plan are bounded by it, whatever the number of documents.
BINS = 96
#: Shares of each length class that are ranked apart, so that no class is numbered by one task.
SALTS = 64
#: Scenario of documents that name none.
DEFAULT_SCENARIO = "general"
#: Capacity from which a container holds any character and its end token; specifications below it don't count. And rows of specifications at most.
LEAST_CAPACITY, MOST_SPECS = 5, 10_000


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """min |ax - b| over x >= 0, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    scale = max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds or 3 * n):
        slope = target - gram @ x
        slope[active] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= 1e-9 * scale:
            break
        active[j] = True
        while True:
            idx = np.flatnonzero(active)
            z = np.linalg.lstsq(gram[np.ix_(idx, idx)], target[idx], rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[idx] = z
                break
            low = z <= 1e-12
            step = np.min(x[idx][low] / np.maximum(x[idx][low] - z[low], 1e-300))
            x[idx] += step * (z - x[idx])
            gone = idx[(x[idx] <= 1e-12) & low]
            if not len(gone):
                gone = idx[low][:1]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
    return x


def patterns(sizes: list[int], capacity: int) -> np.ndarray:
    """Columns of counts per length class: for every class, and pair of classes, the fullest filling that a greedy completion finds."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    ascending = sorted(sizes)
    by_size = {sizes[k]: k for k in order}
    seen: dict[tuple[int, ...], None] = {}
    for i in order:
        for j in [None, *order]:
            counts, room = [0] * len(sizes), capacity - sizes[i]
            counts[i] += 1
            if j is not None:
                if sizes[j] > room:
                    continue
                counts[j] += 1
                room -= sizes[j]
            while (k := bisect_right(ascending, room)) and ascending[0] <= room:
                size = ascending[k - 1]
                counts[by_size[size]] += room // size
                room -= room // size * size
            seen[tuple(counts)] = None
    return np.array(list(seen), dtype=float).T if seen else np.zeros((len(sizes), 0))


def plan(histogram: list[tuple[int, int]], capacity: int) -> list[tuple[dict[int, int], int, bool]]:
    """(pattern as {class: count}, repeats, fitted) that together use up the histogram [(largest size of the class, documents)] exactly.

    Repeats of the fitted patterns are rounded down. What is left, and what only patterns with much room would hold, is packed by patterns of
    the largest classes that fit, made anew whenever a class is used up.
    """
    sizes, left = [s for s, _ in histogram], np.array([n for _, n in histogram], dtype=np.int64)
    if not len(sizes):
        return []
    a = patterns(sizes, capacity)
    fill = (a * np.array(sizes)[:, None]).sum(0) / capacity
    good = fill >= min(0.98, np.sort(fill)[-min(len(fill), 4 * len(sizes))])
    good |= a.sum(0) == a.max(0)  # single classes keep the fit feasible
    a, fill = a[:, good], fill[good]
    weight = 1 / np.sqrt(np.maximum(left, 1))
    x = nnls(a * weight[:, None], left * weight)
    out: list[tuple[dict[int, int], int, bool]] = []
    for k in sorted(np.flatnonzero(x >= 1), key=lambda k: -fill[k]):
        used = np.flatnonzero(a[:, k])
        counts = a[used, k].astype(np.int64)
        n = int(min(np.floor(x[k]), (left[used] // counts).min()))
        if n > 0 and fill[k] >= 0.9:
            left[used] -= n * counts
            out.append((dict(zip(used.tolist(), counts.tolist())), n, True))
    by_size = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    while left.any():
        room, pattern = capacity, {}
        for k in by_size:
            n = int(min(left[k] - pattern.get(k, 0), room // sizes[k]))
            if n > 0:
                pattern[k] = n
                room -= n * sizes[k]
        n = int(min(left[k] // c for k, c in pattern.items()))
        for k, c in pattern.items():
            left[k] -= n * c
        out.append((pattern, n, False))
    return out


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Pieces of a batch of texts: (doc_id, scenario, capacity, piece, start, end, size)."""
    rows = []
    for doc_id, scenario, capacity, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
        data, room = text.encode("utf-8", "surrogatepass"), capacity - 1
        at = start = piece = 0
        while at < len(data):
            to = min(len(data), at + room)
            while to < len(data) and data[to] & 0xC0 == 0x80:
                to -= 1
            end = start + len(data[at:to].decode("utf-8", "surrogatepass"))
            rows.append((doc_id, scenario, capacity, piece, start, end, to - at + 1))
            at, start, piece = to, end, piece + 1
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    columns = list(zip(*rows)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "scenario", "capacity", "piece", "piece_start", "piece_end", "size"])


def capacities(specs: DataFrame) -> dict[str, int]:
    """The capacity of each scenario, the largest of several; rows with a null, or with one too small for a character, don't count."""
    rows = small_rows(specs.select("scenario", F.col("capacity").cast("int").alias("capacity")).where("scenario is not null").where(F.col("capacity") >= LEAST_CAPACITY).groupBy("scenario").agg(F.max("capacity").alias("capacity")), MOST_SPECS, "the table of capacities")
    return {r.scenario: r.capacity for r in rows}


def measured(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """doc_id, scenario, capacity, size, oversize and text of every document with a text.

    size is that of the ByT5 tokenizer: a token per UTF-8 byte and one end token. A null or unlisted scenario counts as `general`; where
    that has no capacity either, the document is left out, as is a null text. An empty text has size 1.
    """
    known = capacities(specs)
    name = F.coalesce("scenario", F.lit(DEFAULT_SCENARIO))
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.expr("cast(map() as map<string,int>)")
    own = F.element_at(table, name)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(own.isNull(), F.lit(DEFAULT_SCENARIO)).otherwise(name).alias("scenario"), F.coalesce(own, F.lit(known.get(DEFAULT_SCENARIO)).cast("int")).alias("capacity"), "text")
    return base.where("text is not null and capacity is not null").withColumn("size", F.octet_length("text").cast("bigint") + 1).withColumn("oversize", F.col("size") > F.col("capacity"))


def items(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """The things to pack: a document each, and the pieces of documents above the capacity (cut between characters, each with an end token).

    doc_id, scenario, capacity, piece, piece_start, piece_end (characters), size.
    """
    ship(docs.sparkSession)
    sized = measured(docs, specs)
    uncut = sized.where(~F.col("oversize")).select("doc_id", "scenario", "capacity", F.lit(0).alias("piece"), F.lit(0).alias("piece_start"), F.length("text").cast("int").alias("piece_end"), "size")
    schema = "doc_id bigint, scenario string, capacity int, piece int, piece_start int, piece_end int, size bigint"
    parts = map_arrow(sized.where("oversize").select("doc_id", "scenario", "capacity", "text"), lambda: _cut, schema)
    return uncut.unionByName(parts)


def pack(docs: DataFrame, specs: DataFrame, bins: int = BINS) -> DataFrame:
    """doc_id, piece, piece_start, piece_end, scenario, capacity, size, container, fitted: every item in a container of its scenario, and
    whether that is of a fitted pattern.

    The histogram of length classes (at most `bins` per scenario) goes to the driver, which plans in it; documents find their container by
    their rank in their class, which is a sum of a rank in one of SALTS shares and an offset. Each row of `docs` is an item, and repeated
    rows are items too; doc_id breaks ties. No document is dropped, and none is cut that fits.
    """
    spark = docs.sparkSession
    packed = cut(items(docs, specs))  # places and sizes only; the texts are read once
    binned = packed.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("size") - 1) * bins / F.col("capacity"))).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = binned.groupBy("scenario", "capacity", "bin", "salt").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("largest"))
    rows = counts.toPandas()  # scenarios x bins x salts rows
    where, offsets = [], []
    for (scenario, capacity), part in rows.groupby(["scenario", "capacity"], sort=True):
        per_bin = part.groupby("bin").agg(n=("n", "sum"), largest=("largest", "max")).sort_index()
        taken, base = dict.fromkeys(range(len(per_bin)), 0), 0
        for pattern, n, fitted in plan(list(zip(per_bin.largest.tolist(), per_bin.n.tolist())), int(capacity)):
            for k, c in pattern.items():
                where.append((scenario, int(per_bin.index[k]), taken[k], taken[k] + n * c, c, base, fitted))
                taken[k] += n * c
            base += n
        for bin_, own in part.sort_values(["bin", "salt"]).groupby("bin"):
            for salt, start in zip(own.salt, own.n.cumsum() - own.n):
                offsets.append((scenario, int(bin_), int(salt), int(start)))
    places = spark.createDataFrame(pd.DataFrame(where, columns=["p_scenario", "p_bin", "low", "high", "each", "base", "fitted"]) if where else [], T.StructType.fromDDL("p_scenario string, p_bin int, low bigint, high bigint, each bigint, base bigint, fitted boolean"))
    starts = spark.createDataFrame(pd.DataFrame(offsets, columns=["o_scenario", "o_bin", "o_salt", "offset"]) if offsets else [], T.StructType.fromDDL("o_scenario string, o_bin int, o_salt int, offset bigint"))
    ranked = binned.withColumn("place", F.row_number().over(Window.partitionBy("scenario", "bin", "salt").orderBy("doc_id", "piece", "size")) - 1)
    # both tables have at most scenarios x bins x max(bins, salts) rows, whatever the input
    ranked = ranked.join(F.broadcast(starts), (F.col("scenario") == F.col("o_scenario")) & (F.col("bin") == F.col("o_bin")) & (F.col("salt") == F.col("o_salt"))).withColumn("rank", F.col("place") + F.col("offset"))
    placed = ranked.join(F.broadcast(places), (F.col("scenario") == F.col("p_scenario")) & (F.col("bin") == F.col("p_bin")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("doc_id", "piece", "piece_start", "piece_end", "scenario", "capacity", "size", (F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("bigint").alias("container"), "fitted")


def cut_documents(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """doc_id of the documents that the packing puts into containers in several pieces, since they exceed the capacity of their scenario."""
    return pack(docs, specs).where("piece > 0").select("doc_id").distinct()


def account(packed: DataFrame) -> DataFrame:
    """scenario, documents, characters, overfull: what the containers of each scenario hold, and how many hold more than their capacity."""
    held = packed.groupBy("scenario").agg(F.count_distinct("doc_id").alias("documents"), F.sum(F.col("piece_end") - F.col("piece_start")).cast("bigint").alias("characters"))
    over = packed.groupBy("scenario", "capacity", "container").agg(F.sum("size").alias("used")).groupBy("scenario").agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"))
    return held.join(over, "scenario")


def fill_report(packed: DataFrame) -> DataFrame:
    """scenario, capacity, items, containers, used, fitted, fill: how full the containers of each scenario are, and the share of items in fitted patterns."""
    boxes = packed.groupBy("scenario", "capacity", "container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("items"), F.count_if("fitted").alias("fitted"))
    return boxes.groupBy("scenario", "capacity").agg(F.sum("items").alias("items"), F.count(F.lit(1)).alias("containers"), F.sum("used").alias("used"), F.round(F.sum("fitted") / F.sum("items"), 4).alias("fitted")).withColumn("fill", F.round(F.col("used") / (F.col("containers") * F.col("capacity")), 4))
