"""Collapse runs of identical or near-identical consecutive events.

Adjacent agglomeration. The events of an entity, in order, are a linked list of runs, at first of one event each. A
priority queue holds the boundaries between neighbouring runs that meet the limits: least similarity and greatest gap. The most
similar neighbours are merged, ties going by a hash of the boundary, the boundaries beside the merged run are valued anew,
and so on until the queue is empty.

The similarity of two runs is 0 with different tools or when only one of them is an error, 1 if all events of both are equal,
and else the share that the words common to all their events have in the words of any. It can only fall as runs grow, so no
run drifts: every event of a run shares that much with every other. The gap is the time between the two events that touch.
The limits decide which boundaries are merged, not how: with a least similarity of 1 equal events come through the same queue.

As no merge makes another boundary better, a boundary that is better than both beside it is merged whatever happens
elsewhere, and one that once misses a limit stays. So an entity may be cut anywhere: the log is range-partitioned by
(entity, order), each task merges what can't depend on its neighbours, and the runs that hang on the two open ends, a few a
task, are merged afterwards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.jsonx import outcome_message, outcome_tag, raw
from mnemolake.session import materialize, tasks

#: Columns of a run: start and end are the clocks of its first and last event, low and high the extremes; tool and outcome are
#: the last event's; common and every hold words of its outcomes, and aren't read while the run is uniform, as they are the
#: outcome's then; nothing can join behind a sealed run.
_RUN = (
    "agent_id string, stream_id string, first_seq bigint, last_seq bigint, n bigint, start_ts bigint, end_ts bigint, low_ts bigint, high_ts bigint, "
    "tool string, outcome string, uniform boolean, common string, every string, sealed boolean"
)
_NAMES = [c.split()[0] for c in _RUN.split(", ")]
#: Runs that a task agglomerates at once.
CHUNK = 50_000


def tool_key(tool: Column) -> Column:
    """One name for all spellings of a tool: case, outer space and the separators space, dot, dash, underscore and slash don't matter."""
    words = F.regexp_replace(F.lower(F.trim(tool)), r"[\s._\-/:]+", ".")
    return F.regexp_replace(words, r"^\.+|\.+$", "")


def message_key(message: Column) -> Column:
    """An error message without the values it carries and without how it is written.

    Case, spaces and closing marks don't matter; quoted texts, paths, values after `=` and words with a digit become `#`.
    """
    m = F.regexp_replace(F.lower(message), r"\s+", " ")
    m = F.regexp_replace(m, r"'[^']*'|\"[^\"]*\"|`[^`]*`", "#")
    m = F.regexp_replace(m, r"=\s*[^\s,;)\]}]+", "=#")
    m = F.regexp_replace(m, r"(?:[a-z]:)?(?:/[\w.\-]+)+/?", "#")
    m = F.regexp_replace(m, r"\b[0-9a-f]{4,}(?:-[0-9a-f]{2,})+\b", "#")
    m = F.regexp_replace(m, r"[\w.+\-:]*\d[\w.+\-:%]*", "#")
    return F.regexp_replace(F.trim(m), r"^[\s.!?…]+|[\s.!?…]+$", "")


def outcome_key(payload: str = "payload") -> Column:
    tag = outcome_tag(payload)
    return F.when(tag == "Err", F.concat(F.lit("Err: "), message_key(outcome_message(payload)))).otherwise(tag)


def similarity(a: tuple, b: tuple) -> float:
    """Of two runs of one tool, each (outcome, uniform, common words, words of any)."""
    if a[1] and b[1] and a[0] == b[0]:
        return 1.0
    if not (a[0].startswith("Err: ") and b[0].startswith("Err: ")):
        return 0.0
    return min(1 - 1e-9, len(a[2] & b[2]) / max(1, len(a[3] | b[3])))


def _states(runs: pd.DataFrame) -> list[tuple]:
    """What similarity takes of each run; runs of one outcome share its set of words."""
    words: dict[str, frozenset] = {}
    out = []
    for o, uniform, common, every in zip(*(runs[c].tolist() for c in ("outcome", "uniform", "common", "every"))):
        if uniform:
            w = words.get(o)
            if w is None:
                w = words[o] = frozenset(o.split())
            out.append((o, True, w, w))
        else:
            out.append((o, False, frozenset(common.split()), frozenset(every.split())))
    return out


def _tie(first_seq: np.ndarray) -> np.ndarray:
    """A number of the boundary before an event, the same wherever the events are cut."""
    with np.errstate(over="ignore"):
        h = first_seq.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _touching(runs: pd.DataFrame, gap_ms: int | None) -> np.ndarray:
    """Which neighbouring rows could be merged, whatever their outcomes."""
    ok = ~runs["sealed"].to_numpy(bool)[:-1]
    for c in ("agent_id", "stream_id", "tool"):
        v = runs[c].fillna("\x00").to_numpy(object)
        ok &= v[:-1] == v[1:]
    if gap_ms is not None:
        ok &= runs["start_ts"].to_numpy()[1:] - runs["end_ts"].to_numpy()[:-1] <= gap_ms
    return ok


def _merge(runs: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
    """Runs from groups of neighbouring rows, given by their first rows; words are those of the first row."""
    last = np.append(first[1:], len(runs)) - 1
    out = runs.iloc[first][["agent_id", "stream_id", "first_seq", "start_ts", "uniform", "common", "every"]].reset_index(drop=True)
    for c in ("last_seq", "end_ts", "tool", "outcome", "sealed"):
        out[c] = runs[c].to_numpy()[last]
    for c, f in (("n", np.add), ("low_ts", np.minimum), ("high_ts", np.maximum)):
        out[c] = f.reduceat(runs[c].to_numpy(), first)
    return out[_NAMES]


def agglomerate(runs: pd.DataFrame, least: float, gap_ms: int | None, open_left: bool = False, open_right: bool = False) -> tuple[pd.DataFrame, np.ndarray]:
    """(merged runs, whether the boundary behind each is final); rows are neighbouring runs in order of (agent, stream, seq).

    At an open end there may be more rows of the same entity: what can depend on them stays unmerged.
    """
    if not len(runs):
        return runs, np.zeros(0, bool)
    n = len(runs)
    touching = _touching(runs, gap_ms)
    may = touching.tolist()
    state = _states(runs)
    value = [0.0] * (n + 1)  # of the boundary behind each row; the last one is the one before the first row
    for i in np.flatnonzero(touching).tolist():
        value[i] = similarity(state[i], state[i + 1])
    tie = _tie(runs["first_seq"].to_numpy()[1:]).tolist()
    queue = [(-value[i], tie[i], i) for i in range(n - 1) if may[i] and value[i] >= least]
    heapq.heapify(queue)
    begins, ends = list(range(n)), list(range(n))  # the linked list: a run's first row by its last, its last row by its first
    waits = [False] * (n + 1)
    waits[n], waits[n - 1] = open_left, open_right
    joined = [False] * n
    while queue:
        s, _, i = heapq.heappop(queue)
        if joined[i] or waits[i] or -s != value[i]:
            continue
        a, e = begins[i], ends[i + 1]
        before, after = (a - 1 if a else n), e
        # a better boundary beside it isn't decided, so neither is this one; but none is better than one between equal runs,
        # and merging these changes the value of no other
        if s > -1 and (waits[before] or waits[after]):
            waits[i] = True
            continue
        joined[i] = True
        ends[a], begins[e] = e, a
        x, y = state[a], state[i + 1]
        state[a] = (y[0], x[1] and y[1] and x[0] == y[0], x[2] & y[2], x[3] | y[3])
        for b, left, right in ((before, begins[a - 1] if a else None, a), (after, a, e + 1)):
            if b < n - 1 and value[b] >= least and may[b]:
                v = similarity(state[left], state[right])
                if v != value[b]:
                    value[b] = v
                    if v >= least:
                        heapq.heappush(queue, (-v, tie[b], b))
    first = np.flatnonzero(np.concatenate([[True], ~np.array(joined[: n - 1], bool)]))
    if len(first) < n:
        runs = _merge(runs, first)
        kept = [state[i] for i in first.tolist()]
        runs["uniform"] = [x[1] for x in kept]
        for k, c in ((2, "common"), (3, "every")):
            runs[c] = ["" if x[1] else " ".join(sorted(x[k])) for x in kept]
    stay = ~(touching & (np.array(value[: n - 1]) >= least))
    last = np.append(first[1:], n) - 1
    final = np.append(stay, not open_right)[last]
    return runs, final


def _stretch(least: float, gap_ms: int | None, again: bool):
    """Agglomerate a task's sorted rows, CHUNK at a time; what isn't final yet is carried on.

    The first time, part is the task's number for the runs that hang on the ends of its stretch, null for the others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        held: pd.DataFrame | None = None
        open_left = not again

        def out(runs: pd.DataFrame, final: np.ndarray, edge: bool) -> pd.DataFrame:
            runs = runs.assign(sealed=final)
            return runs if again else runs.assign(part=pd.array([task if edge else None] * len(runs), "Int32"))

        for whole in batches:
            for at in range(0, len(whole), CHUNK):
                pdf = whole.iloc[at : at + CHUNK]
                pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
                merged, final = agglomerate(pdf[_NAMES], least, gap_ms, open_left, True)
                ends = np.flatnonzero(final) + 1
                p = 0
                if len(ends) and open_left:
                    p, open_left = int(ends[0]), False
                    yield out(merged.iloc[:p], final[:p], True)
                if len(ends):
                    yield out(merged.iloc[p : ends[-1]], final[p : ends[-1]], False)
                held = merged.iloc[ends[-1] :] if len(ends) else merged
        if held is not None and len(held):
            if again:
                held, final = agglomerate(held, least, gap_ms)
            else:
                final = np.zeros(len(held), bool)
            yield out(held, final, True)

    return run


def collapse_runs(events: DataFrame, least: float = 1.0, gap_ms: int | None = None) -> DataFrame:
    """Runs of calls: (agent_id, stream_id, tool, outcome, first_seq, last_seq, n, duration_ms).

    events: (agent_id, stream_id, seq, ts_ms, tool, outcome), one row a seq. tool and outcome are the last event's. Events
    without a tool are never like another. Null agents and streams are entities of their own. The duration is the
    distance of the earliest and latest clock in the run, as clocks may run off the order. An empty table has no runs.
    """
    spark = events.sparkSession
    ts = F.coalesce("ts_ms", F.lit(0))
    text = F.coalesce("outcome", F.lit("Ok"))
    runs = events.select(
        "agent_id",
        "stream_id",
        F.col("seq").alias("first_seq"),
        F.col("seq").alias("last_seq"),
        F.lit(1).cast("bigint").alias("n"),
        *[ts.alias(c) for c in ("start_ts", "end_ts", "low_ts", "high_ts")],
        F.coalesce("tool", F.concat(F.lit("\u0001"), F.col("seq").cast("string"))).alias("tool"),
        text.alias("outcome"),
        F.lit(True).alias("uniform"),
        F.lit("").alias("common"),
        F.lit("").alias("every"),
        F.lit(False).alias("sealed"),
    )
    runs = materialize(runs, "calls")
    by = ["agent_id", "stream_id", "first_seq"]
    parts = runs.repartitionByRange(tasks(spark), *by).sortWithinPartitions(*by)
    parts = materialize(parts.mapInPandas(_stretch(least, gap_ms, False), _RUN + ", part int"), "stretches")
    # the runs at the ends of the tasks' stretches: a few a task, as a chain of boundaries that wait for each other is short
    edges = parts.where("part is not null").drop("part").repartition(1).sortWithinPartitions(*by)
    all_ = parts.where("part is null").drop("part").unionByName(edges.mapInPandas(_stretch(least, gap_ms, True), _RUN))
    tool = F.when(~F.col("tool").startswith("\u0001"), F.col("tool"))
    return all_.select("agent_id", "stream_id", tool.alias("tool"), "outcome", "first_seq", "last_seq", "n", (F.col("high_ts") - F.col("low_ts")).alias("duration_ms"))


def tool_calls(current: DataFrame) -> DataFrame:
    """The ToolCall records of the log with the keys of their tool and outcome. current: one row a seq."""
    calls = current.where("kind_tag = 'ToolCall'")
    return calls.select("agent_id", "stream_id", "seq", "ts_ms", tool_key(raw("payload", "$.tool")).alias("tool"), outcome_key("payload").alias("outcome"))
