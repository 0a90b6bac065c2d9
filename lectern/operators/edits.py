"""Edits of texts: validation, conflicts, application, tracked form, search and bounded differences."""

from __future__ import annotations

import difflib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import map_arrow, ship
from .issues import issues_of, located
from .rules import Options

#: Bounds of a difference: work units and edits.
MAX_WORK, MAX_EDITS = 1_000_000, 10_000


def conflicts(edits: DataFrame) -> DataFrame:
    """The edits with conflict: whether one overlaps another of its document.

    A window over the starts compares each with the furthest end before it, and with the next start; no pairs are formed. Insertions at the
    same place conflict.
    """
    order = Window.partitionBy("doc_id").orderBy("start", "end", "edit_id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("start").over(order)
    same = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "start", "end"))
    return edits.withColumn("conflict", F.coalesce((reach > F.col("start")) | (after < F.col("end")), F.lit(False)) | (same > 1))


def valid(edits: DataFrame, docs: DataFrame) -> DataFrame:
    """The edits whose span lies in their text and holds `original`."""
    met = edits.join(docs.select("doc_id", "text"), "doc_id")
    return met.where((F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.length("text")) & (F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")) == F.col("original"))).select(*edits.columns)


def _shown(original: str, replacement: str) -> str:
    return f"【删除:{original}→修改为:{replacement}】" if replacement else f"【删除:{original}】"


def spliced(text: str, edits: list[tuple[int, int, str, str]], tracked: bool = False) -> tuple[str, int]:
    """(text with its edits, how many): those whose span holds what they replace, unless two of them overlap; then the text is left as it is.

    edits are (start, end, original, replacement), sorted. Two insertions at one place overlap.
    """
    fitting = [e for e in edits if 0 <= e[0] <= e[1] <= len(text) and text[e[0] : e[1]] == e[2]]
    reach = 0
    for k, (a, b, *_) in enumerate(fitting):
        if k and (a < reach or fitting[k - 1][:2] == (a, b)):
            return text, 0
        reach = max(reach, b)
    out, at = [], 0
    for a, b, old, new in fitting:
        out += [text[at:a], _shown(old, new) if tracked else new]
        at = b
    return "".join([*out, text[at:]]), len(fitting)


def apply_edits(docs: DataFrame, edits: DataFrame, tracked: bool = False) -> DataFrame:
    """doc_id, text, edits: the texts with their edits put in; tracked shows what was and what is.

    Edits that don't fit their text are left out. Documents with conflicting edits keep their text, with edits 0, as do those without edits; a null
    text stays null. Each text is joined once with the list of its edits, and rebuilt in one pass over the gaps between them.
    """
    ship(docs.sparkSession)
    lists = edits.where("start is not null and end is not null and original is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "original", F.coalesce("replacement", F.lit("")).alias("replacement")))).alias("own"))
    joined = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(lists, "doc_id", "left")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [(t, 0) if t is None or not own else spliced(t, [tuple(e.values()) for e in own], tracked) for t, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], names=["doc_id", "text", "edits"])

    return map_arrow(joined, lambda: work, "doc_id bigint, text string, edits int")


def plan(edits: DataFrame) -> DataFrame:
    """doc_id, accepted, conflicting, status: of each document how many edits it has and the ids of those that conflict, in order; ready where there are none."""
    marked = conflicts(edits)
    ids = F.sort_array(F.collect_list(F.when(F.col("conflict"), F.col("edit_id"))))
    return marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("accepted"), ids.alias("conflicting")).withColumn("status", F.when(F.size("conflicting") > 0, "conflict").otherwise("ready"))


def replaced(docs: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """doc_id, text: the texts with each literal replaced everywhere, one pair after the other, each in what the one before left. An empty literal changes nothing."""
    text = F.col("text")
    for old, new in pairs:
        if old:
            text = F.replace(text, F.lit(old), F.lit(new))
    return docs.select("doc_id", text.alias("text"))


def replaced_at(docs: DataFrame, needle: str, replacement: str, nth: int = 0) -> DataFrame:
    """doc_id, text: the texts with the nth place of a literal replaced; a text with fewer places is left as it is."""
    parts = F.split("text", "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    one = F.concat(F.array_join(F.slice(parts, 1, nth + 1), needle), F.lit(replacement), F.array_join(F.slice(parts, nth + 2, F.greatest(F.lit(1), F.size(parts))), needle))
    return docs.select("doc_id", F.when(F.lit(bool(needle)) & (F.size(parts) > nth + 1), one).otherwise(F.col("text")).alias("text"))


#: Bounds of the search for a derivation: places reached, and signs compared.
MOST_STATES, MOST_STEPS = 100_000, 5_000_000


def derivable(source: str, target: str, changes: list[tuple[int, int, str]]) -> bool | None:
    """Whether a text comes from another by some of its changes (start, end, replacement), each put in or not; None beyond the bounds.

    States are pairs of places up to which both texts agree; from each, a change that begins there is taken, or what stands up to the next change is kept.
    """
    if source == target:
        return True
    by_start: dict[int, set[tuple[int, str]]] = {}
    for a, b, new in changes:
        if 0 <= a <= b <= len(source):
            by_start.setdefault(a, set()).add((b, new))
    starts = sorted(by_start)
    seen, todo, steps = {(0, 0)}, [(0, 0)], 0
    while todo:
        i, j = todo.pop()
        if i == len(source) and j == len(target):
            return True
        k = bisect_right(starts, i)
        following = starts[k] if k < len(starts) else len(source)
        ways = [(b, new) for b, new in by_start.get(i, ())]
        if following > i:
            ways.append((following, source[i:following]))
        for to, part in ways:
            steps += len(part) + 1
            state = (to, j + len(part))
            if target.startswith(part, j) and state not in seen and state != (i, j):
                seen.add(state)
                todo.append(state)
        if len(seen) > MOST_STATES or steps > MOST_STEPS:
            return None
    return False


def derivations(docs: DataFrame, revised: DataFrame, changes: DataFrame) -> DataFrame:
    """doc_id, derived: whether each revised text comes from its document's by some of its changes; null beyond the bounds, or without a text.

    revised: doc_id, text; changes: doc_id, start, end, replacement.
    """
    ship(docs.sparkSession)
    lists = changes.where("replacement is not null").groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "replacement")).alias("own"))
    joined = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(revised.select("doc_id", F.col("text").alias("revised")), "doc_id").join(lists, "doc_id", "left")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = [None if t is None or r is None else derivable(t, r, [tuple(e.values()) for e in own or ()]) for t, r, own in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.bool_())], names=["doc_id", "derived"])

    return map_arrow(joined.select("doc_id", "text", "revised", "own"), lambda: work, "doc_id bigint, derived boolean")


def chain_faults(revisions: DataFrame) -> DataFrame:
    """doc_id, number, fault: revisions that don't go on from the one before: their number is not the next one, or their parent not the last revision.

    revisions: doc_id, number, revision_id, parent_id. A revision sent again, equal in all columns, counts once.
    """
    order = Window.partitionBy("doc_id").orderBy("number", "revision_id")
    rows = revisions.select("doc_id", "number", "revision_id", "parent_id").distinct().withColumn("last", F.lag("number").over(order)).withColumn("last_id", F.lag("revision_id").over(order))
    fault = F.when(F.col("number") != F.coalesce("last", F.lit(0)) + 1, "number").when(~F.col("parent_id").eqNullSafe(F.col("last_id")), "parent")
    return rows.withColumn("fault", fault).where("fault is not null").select("doc_id", "number", "fault")


def on_blocks(edits: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, edit_id, block_index, block_start, block_end, status: the block that owns each edit, with its place in there.

    status is owned, or `separator` where an edit reaches out of every block: what stands between blocks can't be changed. An insertion where one block
    ends and another begins belongs to the first. Repeated blocks count once; edits meet blocks as issues do.
    """
    met = located(edits.select("doc_id", "edit_id", "start", "end"), blocks)
    return met.select("doc_id", "edit_id", "block_index", "block_start", "block_end", F.when(F.col("block_index").isNull(), "separator").otherwise("owned").alias("status"))


def moved_blocks(edits: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, block_index, new_start, new_end: where each block stands once its text has the edits it owns; all others after it move along.

    edits: doc_id, edit_id, start, end, replacement, without conflicts. Repeated blocks count once.
    """
    grown = on_blocks(edits, blocks).where("status = 'owned'").join(edits.select("doc_id", "edit_id", (F.length(F.coalesce("replacement", F.lit(""))) - (F.col("end") - F.col("start"))).alias("more")), ["doc_id", "edit_id"]).groupBy("doc_id", "block_index").agg(F.sum("more").alias("more"))
    own = blocks.select("doc_id", "block_index", "global_start", "global_end").distinct().join(grown, ["doc_id", "block_index"], "left").withColumn("more", F.coalesce("more", F.lit(0)))
    before = F.coalesce(F.sum("more").over(Window.partitionBy("doc_id").orderBy("global_start", "global_end", "block_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.select("doc_id", "block_index", (F.col("global_start") + before).cast("bigint").alias("new_start"), (F.col("global_end") + before + F.col("more")).cast("bigint").alias("new_end"))


def rechecked(docs: DataFrame, edits: DataFrame, options: Options = Options()) -> DataFrame:
    """The issues of the texts once they have their edits."""
    return issues_of(apply_edits(docs, edits), options)


def _folded(text: str) -> tuple[str, dict[int, int], dict[int, int]]:
    """(a text without case and width, where in the text the signs begin that begin at a place of it, and end that end there).

    Signs that are read as one, such as a letter and its accent, are folded as one, so that no match begins or ends in the middle of them.
    """
    out: list[str] = []
    starts, ends = {}, {}
    at = size = 0
    for sign in regex.findall(r"\X", text):
        part = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", sign).upper().lower())
        starts[size] = at
        size += len(part)
        at += len(sign)
        ends[size] = at
        out.append(part)
    return "".join(out), starts, ends


def folded_places(text: str, key: str) -> list[tuple[int, int]]:
    """Where a folded literal stands in a text, one place after the other."""
    hay, starts, ends = _folded(text)
    found = []
    k = hay.find(key) if key else -1
    while k >= 0:
        if k in starts and k + len(key) in ends:
            found.append((starts[k], ends[k + len(key)]))
            k = hay.find(key, k + len(key))
        else:
            k = hay.find(key, k + 1)
    return found


def search(docs: DataFrame, needle: str, fold: bool = False) -> DataFrame:
    """doc_id, start, end of the non-overlapping places of a literal; with fold, whatever its case and width. An empty literal stands nowhere."""
    ship(docs.sparkSession)
    key = _folded(needle)[0] if fold else needle

    def plain(t: str) -> list[tuple[int, int]]:
        return [(m.start(), m.end()) for m in re.finditer(re.escape(key), t)] if key else []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(d, a, b) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b in (folded_places(t, key) if fold else plain(t))]
        columns = list(zip(*rows)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "start", "end"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    if not fold and key:
        source = source.where(F.contains("text", F.lit(key)))
    return map_arrow(source, lambda: work, "doc_id bigint, start int, end int")


def difference(original: str, modified: str, max_work: int = MAX_WORK, max_edits: int = MAX_EDITS) -> list[tuple[int, int, str]] | None:
    """(start, end, replacement) that turn one text into the other, or None beyond the bounds."""
    head = 0
    while head < min(len(original), len(modified)) and original[head] == modified[head]:
        head += 1
    tail = 0
    while tail < min(len(original), len(modified)) - head and original[-1 - tail] == modified[-1 - tail]:
        tail += 1
    a, b = original[head : len(original) - tail], modified[head : len(modified) - tail]
    if len(a) * len(b) + len(a) + len(b) > max_work:
        return None
    out = [(head + i, head + j, b[x:y]) for kind, i, j, x, y in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if kind != "equal"] if a or b else []
    return out if len(out) <= max_edits else None


def differences(pairs: DataFrame, max_work: int = MAX_WORK, max_edits: int = MAX_EDITS) -> DataFrame:
    """doc_id, status (ok, or too_large beyond the bounds), edits (start, end, replacement) that turn each original into its modified text. pairs: doc_id, original, modified; nulls count as empty."""
    ship(pairs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = [difference(a or "", b or "", max_work, max_edits) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        lists = [[dict(zip(("start", "end", "replacement"), e)) for e in x or ()] for x in told]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(["too_large" if x is None else "ok" for x in told]), pa.array(lists, kind)], names=["doc_id", "status", "edits"])

    return map_arrow(pairs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "original", "modified"), lambda: work, "doc_id bigint, status string, edits array<struct<start:int,end:int,replacement:string>>")


def artifact_faults(events: DataFrame) -> DataFrame:
    """artifact_id, version, fault: reservations and results of exports that don't go on from what there is.

    events: artifact_id, version, state (pending or ready). Versions begin at one and grow by one with each reservation; a result of another version than the last
    reserved one is stale, and one that was ready already is a double. Repeated rows count once.
    """
    order = Window.partitionBy("artifact_id").orderBy("nth")
    rows = events.select("artifact_id", "version", "state", "nth").distinct().withColumn("reserved", F.coalesce(F.max(F.when(F.col("state") == "pending", F.col("version"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    done = F.coalesce(F.max(F.when(F.col("state") == "ready", F.col("version"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fault = F.when((F.col("state") == "pending") & (F.col("version") != F.col("reserved") + 1), "gap").when((F.col("state") == "ready") & (F.col("version") != F.col("reserved")), "stale").when((F.col("state") == "ready") & (done == F.col("version")), "double")
    return rows.withColumn("fault", fault).where("fault is not null").select("artifact_id", "version", "fault")
