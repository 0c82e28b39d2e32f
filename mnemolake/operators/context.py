"""Context windows under a token budget: for one stream as an object, for all streams as a plan."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Bytes that an item costs besides its text, and how items are worded.
OVERHEAD = {"decision": 20, "toolCall": 20, "episode": 20, "anomaly": 10, "phaseSummary": 10, "timelineEntry": 10}

LOOP_TEXT = "Error loop: tool {tool} failed {n} times"
DRIFT_TEXT = "Objective drift: {n} decisions diverged from intent 'unknown intent'"
PHASE_TEXT = "Phase {name} completed with {n} decisions"
EPISODE_TEXT = "Episode {id}"
# Words of a state that speak of success, and of failure.
GOOD, BAD = ("success", "done", "ok"), ("error", "fail")


def token_cost(text: str | Column, overhead: int) -> Column:
    """Estimated tokens of an item: a quarter of its UTF-8 bytes and overhead, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.octet_length(text) + F.lit(overhead)) / 4)).cast("bigint")


def budget_prefix(items: DataFrame, by: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """The items of each group up to the first that overflows the budget. Exact as a running sum, since every cost is at least 1.

    For the same reason only a group's first `budget` items can be among them: the others stay behind in their tasks, so
    that a group with most of the rows moves no more than that from each.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    first = items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= budget).drop("_n")
    return first.withColumn("used", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)


def context_items(nodes: DataFrame, phase: str) -> DataFrame:
    """(stream_id, sect, k1, k2, k3, type, text, seq, cost) of every stream: what a context of it holds, in order of sect and keys.

    Error loops, drift, then phases by name, a decision without one being of the current phase: this phase's decisions in full, of
    the others the first decision and how many there were.
    """
    from mnemolake.operators import causal

    none, no = F.lit(""), F.lit(None).cast("bigint")

    def items(df: DataFrame, sect: int, kind: str, text: Column, k1: Column = none, k2: Column = none, k3: Column = F.lit(0), seq: Column = no) -> DataFrame:
        row = df.select("stream_id", F.lit(sect).alias("sect"), k1.alias("k1"), k2.alias("k2"), k3.cast("bigint").alias("k3"), F.lit(kind).alias("type"), text.alias("text"), seq.alias("seq"))
        return row.withColumn("cost", token_cost("text", OVERHEAD[kind]))

    def worded(pattern: str, **parts: Column) -> Column:
        """A wording with columns in the places of its names."""
        return F.concat(*[parts[p[1:-1]].cast("string") if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", pattern) if p])

    quoted = F.concat(F.lit('Some("'), F.replace(F.replace("tool", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('")'))
    loops = items(causal.error_loops(nodes), 0, "anomaly", worded(LOOP_TEXT, tool=quoted, n=F.col("repetitions")), F.col("tool"), F.col("message"))
    drift = items(causal.objective_drift(nodes), 1, "anomaly", worded(DRIFT_TEXT, n=F.col("repetitions")))
    d = nodes.where("node = 'decision'").withColumn("name", F.coalesce("phase", F.lit(phase)))
    now, past = d.where(F.col("name") == phase), d.where(F.col("name") != phase)
    past = past.groupBy("stream_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), F.min_by("text", "seq").alias("text"))
    now = items(now, 2, "decision", F.col("text"), F.col("name"), k3=F.col("seq"), seq=F.col("seq"))
    first = items(past, 2, "decision", F.col("text"), F.col("name"), k3=F.col("seq"), seq=F.col("seq"))
    summed = items(past, 2, "phaseSummary", worded(PHASE_TEXT, name=F.col("name"), n=F.col("n")), F.col("name"), k3=F.lit(2**63 - 1))
    return loops.unionByName(drift).unionByName(now).unionByName(first).unionByName(summed)


def context_windows(nodes: DataFrame, phase: str, max_tokens: int) -> DataFrame:
    """context_items of each stream up to the first that overflows the budget, with the tokens used so far."""
    return budget_prefix(context_items(nodes, phase), ["stream_id"], ["sect", "k1", "k2", "k3"], "cost", max_tokens)


def current_objective(nodes: DataFrame, objective: str) -> DataFrame:
    """(stream_id, seq) of each stream's latest decision whose text holds the objective, in any case."""
    fits = nodes.where("node = 'decision'").where(F.contains(F.lower("text"), F.lit(objective.lower())))
    return fits.groupBy("stream_id").agg(F.max("seq").alias("seq"))


def trailing_counts(events: DataFrame, key: str, at: str, span_ms: int) -> DataFrame:
    """events with in_span: how many records of the key lie in the span up to each record, itself and its ties included.

    A key is cut into spans of its clock, and each record also goes to the next span, as what lies before: a key with most
    of the rows spreads over many tasks. Records without a clock count among themselves.
    """
    slot = F.floor(F.col(at) / F.lit(span_ms))
    both = events.withColumn("_slot", F.explode(F.when(F.col(at).isNull(), F.array(slot)).otherwise(F.array(slot, slot + 1)))).withColumn("_own", F.coalesce(F.col("_slot") == slot, F.lit(True)))
    w = Window.partitionBy(key, "_slot").orderBy(at).rangeBetween(-span_ms, 0)
    return both.withColumn("in_span", F.count(F.lit(1)).over(w)).where("_own").drop("_slot", "_own")


def one_line(text: str | Column, most: int) -> Column:
    """White space as single spaces, cut to `most` characters with an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, max(0, most - 1)), F.lit("…")))


def overlap_words(text: str | Column) -> Column:
    """The distinct words of more than two characters, small."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.char_length(w) > 2))


@dataclass
class Item:
    type: str
    text: str
    seq: int | None = None
    phase: str | None = None
    key_decisions: list[int] = field(default_factory=list)

    def tokens(self) -> int:
        return max(1, (len(self.text.encode()) + OVERHEAD[self.type]) // 4)


@dataclass
class AgentContext:
    items: list[Item]
    episodes: list[str] = field(default_factory=list)

    @property
    def anomalies(self) -> list[Item]:
        return [i for i in self.items if i.type == "anomaly"]

    def estimated_tokens(self) -> int:
        return sum(i.tokens() for i in self.items)

    def contains_seq(self, seq: int) -> bool:
        return any(i.seq == seq for i in self.items)

    def content_hash(self) -> int:
        """The same for contexts with the same content, in any process."""
        text = json.dumps([[asdict(i) for i in self.items], self.episodes], sort_keys=True, ensure_ascii=False)
        return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")

    def phase_summary(self, phase: str) -> tuple[bool, list[int]] | None:
        """(whether the phase is summed up, the seqs of its key decisions), or None where nothing of it is here."""
        of = [i for i in self.items if i.phase == phase]
        short = next((i for i in of if i.type == "phaseSummary"), None)
        seqs = [i.seq for i in of if i.type in ("decision", "toolCall") and i.seq is not None]
        return (True, short.key_decisions) if short else (False, seqs) if seqs else None

    def has_content_from_phase(self, phase: str) -> bool:
        return self.phase_summary(phase) is not None

    def spans_sessions(self, sessions: list[str]) -> bool:
        """Whether each name is a phase with content here, or is spoken of by a decision or call."""
        texts = [i.text for i in self.items if i.type in ("decision", "toolCall")]
        return all(self.has_content_from_phase(s) or any(s in t for t in texts) for s in sessions)

    def phases(self) -> set[str]:
        return {i.phase for i in self.items if i.phase is not None}


def _clip(text: str, most: int) -> str:
    t = " ".join(text.split())
    return t if len(t) <= most else t[: max(0, most - 1)] + "…"


def _words(text: str) -> set[str]:
    return {w for w in re.findall(r"[^\W_]+", text.lower()) if len(w) > 2}


def _label(value: str | None) -> str:
    return "None" if value is None else 'Some("' + value.replace("\\", "\\\\").replace('"', '\\"') + '")'


@dataclass
class Thread:
    """One stream's nodes, in order of seq, as rows of thread_nodes, with its anomalies."""

    nodes: list
    loops: list = field(default_factory=list)
    drift: list = field(default_factory=list)

    def anomaly_items(self) -> list[Item]:
        out = [Item("anomaly", LOOP_TEXT.format(tool=_label(r["tool"]), n=r["repetitions"])) for r in self.loops]
        return out + [Item("anomaly", DRIFT_TEXT.format(n=r["repetitions"])) for r in self.drift]

    def decisions(self) -> list:
        return [n for n in self.nodes if n["node"] == "decision"]


def _shown(n, detail: bool) -> str:
    err = n["message"] or ""
    if detail:
        return f"{n['text']} -> " + (f'Err("{err}")' if n["outcome"] == "Err" else n["outcome"])
    return f"tool {n['text']} -> " + {"Ok": "ok", "Timeout": "timeout"}.get(n["outcome"], f"error: {err}")


def build_context(thread: Thread, phase: str, objective: str, max_tokens: int, anchors: bool = True, compress: bool = True, episodes: list[str] | None = None) -> AgentContext:
    """Anomalies, the causes of the current objective, phases, episodes; cut at the first item that overflows the budget."""
    items = thread.anomaly_items()
    seen: set[int] = set()
    by_seq = {n["seq"]: n for n in thread.nodes if n["node"] != "intent"}
    decisions = thread.decisions()
    at = next((d["seq"] for d in reversed(decisions) if objective.lower() in d["text"].lower()), None)
    walked: set[int] = set()
    while anchors and at is not None and at in by_seq and at not in walked:
        n = by_seq[at]
        walked.add(at)
        seen.add(at)
        items.append(Item("decision", n["text"], at, n["phase"]) if n["node"] == "decision" else Item("toolCall", _shown(n, True), at))
        at = n["caused_by"]
    groups: dict[str, list] = {}
    for d in decisions:
        groups.setdefault(phase if d["phase"] is None else d["phase"], []).append(d)
    for name in sorted(groups, key=str.encode):
        current = name == phase
        for d in groups[name] if current else groups[name][:1] if compress else []:
            if d["seq"] not in seen:
                seen.add(d["seq"])
                items.append(Item("decision", d["text"], d["seq"], (name or None) if current else name))
        if compress and not current:
            items.append(Item("phaseSummary", PHASE_TEXT.format(name=name, n=len(groups[name])), None, name, [groups[name][0]["seq"]]))
    items += [Item("episode", EPISODE_TEXT.format(id=e)) for e in episodes or []]
    used, kept = 0, []
    for i in items:
        if used + i.tokens() > max_tokens:
            break
        used += i.tokens()
        kept.append(i)
    return AgentContext(kept, list(episodes or []))


def build_timeline(thread: Thread, objective: str, max_tokens: int, share: float = 0.35, detail: bool = True, line_chars: int = 80) -> AgentContext:
    """Anomalies, one line an event within a share of the budget, then full texts near the objective; what doesn't fit is skipped."""
    kept, used = [], 0

    def take(items: list[Item], limit: int) -> list[Item]:
        nonlocal used
        out = []
        for i in items:
            if used + i.tokens() <= limit:
                used += i.tokens()
                out.append(i)
        return out

    kept += take(thread.anomaly_items(), max_tokens)
    lines = [Item("timelineEntry", _clip(n["text"] if n["node"] == "decision" else _shown(n, False), line_chars), n["seq"], n["phase"]) for n in thread.nodes if n["node"] != "intent"]
    lines.sort(key=lambda i: i.seq)
    room = used + int(np.float32(max(0, max_tokens - used)) * np.float32(min(1.0, max(0.0, share))))
    n = len(lines)
    # the two ends first, then evenly spread ones, then the rest
    order = list(dict.fromkeys([0, n - 1, *range(max(1, n // 8), n - 1, max(1, n // 8)), *range(1, n - 1)])) if n else []
    chosen = sorted(take([lines[i] for i in order], room), key=lambda i: i.seq)
    kept += chosen
    if detail:
        goal, shown = _words(objective), {i.seq for i in chosen}
        near = [(len(_words(d["text"]) & goal), d) for d in thread.decisions()]
        near = sorted((x for x in near if x[0]), key=lambda x: (-x[0], -x[1]["seq"]))
        near = [Item("decision", d["text"], d["seq"], d["phase"]) for _, d in near if not (d["seq"] in shown and len(d["text"]) <= line_chars)]
        kept += sorted(take(near, max_tokens), key=lambda i: i.seq)
    return AgentContext(kept)


def quality_column(state: str) -> Column:
    """output_quality as an expression over a column."""
    t = F.lower(F.coalesce(state, F.lit("")))
    good, bad = F.lit(False), F.lit(False)
    for w in GOOD:
        good = good | t.contains(w)
    for w in BAD:
        bad = bad | t.contains(w)
    return F.when(good, 1.0).when(bad, 0.0).otherwise(0.5)


def output_quality(state: str | None) -> float:
    """1 if a state's text speaks of success, 0 if of failure, else 0.5."""
    t = (state or "").lower()
    return 1.0 if any(w in t for w in GOOD) else 0.0 if any(w in t for w in BAD) else 0.5
