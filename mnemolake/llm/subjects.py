"""The subject areas of each document: term weighting, truncated singular value decomposition, refined seed centroids.

1. A text becomes sentences of hashed words. What doesn't speak of the document's own dispute is left out: page headers,
   sentences that cite another decision in parentheses, names of courts, names of parties. A name is a capitalised word that
   begins a party's name in some caption, with the capitalised words after it; where a text writes common nouns small,
   every capitalised word inside a sentence is one.
2. Words are weighted by inverse document frequency; words that a good share of one language's texts hold weigh nothing, unless
   the labels show them to be more frequent under some subject. Documents of the same words count as one text in all that is
   counted or fitted, so that copies, however many, neither make their words common nor draw a centroid to them.
3. The truncated decomposition of the matrix of documents and words comes from three passes of a randomised range finder over all
   documents: each task multiplies its rows into a fixed matrix of hashed words and ranks, and those matrices are added up.
4. Labels, in any spelling, give seed centroids for each subject and language, and one more a subject for the labelled
   documents of small or unknown languages together that are near none of those. Over all documents, those that lie clearly
   nearest to one centroid move it, a few times.
5. Each sentence goes to its nearest subject by cosine if it leads the second by a margin. A document has the one or two
   subjects whose sentences lead by enough in sum and in share.

All counts cover all documents. What reaches the driver has fixed sizes: TERMS counts for each of at most LANGS languages,
TERMS x RANK sums, and the centroids.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.session import materialize

#: Buckets of hashed words, rank of the decomposition, languages that are told apart (the largest; others count as one).
TERMS, RANK, LANGS = 1 << 16, 128, 12
#: Share of the documents that a language needs to be told apart.
LANG_SHARE = 0.01
#: A word in more than this share of a language's texts weighs nothing if it is as frequent under every subject; nor does a word in one text only.
COMMON = 0.25
#: A word is more frequent under a subject if its share is so many times, and so many standard errors above, that of the other subjects.
TIMES, ERRORS = 2, 3
#: A text with a smaller share of capitals inside its sentences writes common nouns small.
NOUN_CAPITALS = 0.18
#: Lead of a sentence's best subject over the second, and the sum and share of leads that a document's subject needs.
MARGIN, NEED, SHARE = 0.08, 0.3, 0.15
REFINE_ROUNDS, REFINE_MARGIN = 5, 0.1
#: A document of an unknown language whose cosine with every centroid is below this is in none of the languages told apart.
FOREIGN = 0.1
#: Longest line that counts as a page header.
HEADER_CHARS = 100

# The line between the parties of a caption, by language.
VERSUS = ("v.", "vs.", "gegen", "contre", "contra", "contro")

_VERSUS = re.compile(rf"^[ \t]*(?:{'|'.join(map(re.escape, VERSUS))})[ \t]*$", re.M)
_HYPHEN = re.compile(r"-\n[ \t]*(?=[^\W\d_])")
_CITATION = re.compile(r"\([^()]*\d{4}[^()]*\)")
_TOKEN = re.compile(r"[^\W\d_]{3,}|[.!?](?=\s|$)")
_CHUNK = 4096


class _Ids(dict):
    """Word to 2 * bucket + 1 if it is capitalised; -1 for the end of a sentence. Emptied when full."""

    def __missing__(self, word: str) -> int:
        v = -1 if word in ".!?" else (zlib.crc32(word.lower().encode()) % TERMS) * 2 + word[0].isupper()
        if len(self) >= 300_000:
            self.clear()
        self[word] = v
        return v


def _without_headers(t: str, key: str | None) -> str:
    """Without the short lines that hold key."""
    if not key:
        return t
    at = t.find(key)
    while at >= 0:
        a, b = t.rfind("\n", 0, at) + 1, t.find("\n", at)
        b = len(t) if b < 0 else b
        if b - a < HEADER_CHARS:
            t = t[:a] + t[b + 1 :]
            at = t.find(key, a)
        else:
            at = t.find(key, at + len(key))
    return t


def _without_citations(t: str) -> str:
    """Without the sentences in which a parenthesis holds a year or a longer number."""
    out, p = [], 0
    for m in _CITATION.finditer(t):
        if m.start() < p:
            continue
        a = max(t.rfind(c, p, m.start()) for c in ".!?") + 1
        if a > p:
            out.append(t[p:a])
        ends = [x for x in (t.find(c, m.end()) for c in ".!?") if x >= 0]
        p = min(ends) + 1 if ends else len(t)
    out.append(t[p:])
    return " ".join(out)


def _caption_names(t: str) -> list[str]:
    """The first word of each party's name: of the lines above and below a line between the parties, wherever in the text it stands."""
    out = []
    for m in _VERSUS.finditer(t):
        above, below = t[: m.start()].rstrip(), t[m.end() :].lstrip()
        for y in (above[above.rfind("\n") + 1 :].strip(), below.split("\n", 1)[0].strip()):
            words = _TOKEN.findall(y.rstrip(",").rsplit(",", 1)[0])
            if words and words[0][0].isupper():
                out.append(words[0])
    return out


def _nested(lists: list[list[int]]) -> pa.ListArray:
    flat: list[int] = []
    for x in lists:
        flat += x
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)), pa.array(np.array(flat, np.int32)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = _Ids()

    def words(x: list[str]) -> list[int]:
        return [ids[w] >> 1 for w in x if w not in ".!?"]

    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            tokens, names, courts = [], [], []
            for text, source, docket in zip(*(b.column(c).to_pylist() for c in ("text", "source", "docket_no"))):
                t = unicodedata.normalize("NFC", text or "").replace("\r", "")
                names.append(words(_caption_names(t)))
                courts.append(words(_TOKEN.findall(source or "")))
                t = _HYPHEN.sub("", _without_headers(_without_headers(t, docket), source))
                tokens.append(list(map(ids.__getitem__, _TOKEN.findall(_without_citations(t)))))
            lists = [_nested(x) for x in (tokens, names, courts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *lists], ["doc_id", "lang", "tokens", "names", "courts"])


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, number of the row of each value)."""
    sizes = np.diff(col.offsets.to_numpy())
    return col.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(col)), sizes)


def _lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)), pa.array(values.astype(np.int32)))


def strip_names(x: np.ndarray, row: np.ndarray, n: int, name: np.ndarray, court: np.ndarray) -> np.ndarray:
    """Which tokens of n texts stay: sentence ends, and words that belong to no name."""
    sep = x < 0
    h = np.where(sep, 0, x >> 1)
    capital = ~sep & ((x & 1) == 1)
    first = np.ones(len(x), bool)
    first[1:] = sep[:-1] | (row[1:] != row[:-1])
    inside = ~sep & ~first
    share = np.bincount(row[inside & capital], minlength=n) / np.maximum(1, np.bincount(row[inside], minlength=n))
    drop = inside & capital & (share < NOUN_CAPITALS)[row]
    # a run of capitalised words, from the first that begins a name on
    start = capital & name[h]
    new_run = ~capital
    new_run[1:] |= row[1:] != row[:-1]
    new_run[:1] = True
    at = np.arange(len(x))
    run_start = np.maximum.accumulate(np.where(new_run, at, 0))
    last_name = np.maximum.accumulate(np.where(start, at, -1))
    drop |= capital & (last_name >= run_start)
    drop |= ~sep & court[h]
    return ~drop


def _strip(name: np.ndarray, court: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x, row = _flat(b.column("tokens"))
            keep = strip_names(x, row, n, name, court)
            x, row = x[keep], row[keep]
            ids = np.where(x < 0, -1, x >> 1)
            word = ids >= 0
            pairs = np.unique(row[word].astype(np.int64) * TERMS + ids[word])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), _lists(ids, row, n), _lists(pairs % TERMS, pairs // TERMS, n)], ["doc_id", "lang", "tokens", "terms"])

    return run


class Weights:
    """Weights of the buckets, and the slots of those with a weight, so that matrices hold no rows for the others."""

    def __init__(self, weight: np.ndarray):
        self.weight = weight.astype(np.float32)
        self.slot = np.where(weight > 0, np.cumsum(weight > 0) - 1, -1).astype(np.int32)
        self.kept = self.weight[weight > 0]

    def __len__(self) -> int:
        return len(self.kept)


def _rows(b: pa.RecordBatch, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, row, value) of a batch's weighted rows, each of length one; terms of no weight are left out."""
    t, row = _flat(b.column("terms"))
    s = weights.slot[t]
    s, row = s[s >= 0], row[s >= 0]
    w = weights.kept[s]
    norm = np.sqrt(np.bincount(row, w * w, minlength=b.num_rows))
    return s, row, (w / np.maximum(norm, 1e-12)[row]).astype(np.float32)


def _sum_rows(m: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of m with the same number in at, which ascends: (numbers, sums)."""
    if not len(at):
        return at, m[:0]
    first = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
    return at[first], np.add.reduceat(m, first, axis=0)


def _project(weight: Weights, basis: np.ndarray):
    """A task's share of A'A * basis, as chunks of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(basis)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                t, row, v = _rows(whole.slice(at, 1000), weight)
                if not len(t):
                    continue
                _, y = _sum_rows(basis[t] * v[:, None], row)
                number = np.cumsum(np.diff(row, prepend=row[0]) > 0)
                order = np.argsort(t, kind="stable")
                terms, s = _sum_rows(y[number[order]] * v[order, None], t[order])
                total[terms] += s
        chunks = [(i, total[i * _CHUNK : (i + 1) * _CHUNK]) for i in range(-(-len(total) // _CHUNK))]
        chunks = [(i, c) for i, c in chunks if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunks], pa.int32()), pa.array([c.tobytes() for _, c in chunks], pa.binary())], ["chunk", "data"])

    return run


def _add_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(pdf["data"].iloc[0], np.float32).copy()
    for d in pdf["data"].iloc[1:]:
        total += np.frombuffer(d, np.float32)
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "data": [total.tobytes()]})


def _gram_times(docs: DataFrame, weight: Weights, basis: np.ndarray) -> np.ndarray:
    parts = docs.select("terms").mapInArrow(_project(weight, basis.astype(np.float32)), "chunk int, data binary")
    out = np.zeros(basis.shape, np.float32)
    for r in parts.groupBy("chunk").applyInPandas(_add_chunks, "chunk int, data binary").collect():
        m = np.frombuffer(r["data"], np.float32).reshape(-1, basis.shape[1])
        out[r["chunk"] * _CHUNK : r["chunk"] * _CHUNK + len(m)] = m
    return out


def decompose(docs: DataFrame, weight: Weights, rank: int = RANK, passes: int = 3, seed: int = 5) -> np.ndarray:
    """The leading right singular vectors (slots x rank) of the weighted matrix of documents and words."""
    basis = np.random.default_rng(seed).normal(size=(len(weight), rank)).astype(np.float32)
    for i in range(passes):
        image = _gram_times(docs, weight, basis)
        if i < passes - 1:
            basis = np.linalg.qr(image)[0]
    value, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2) if passes > 1 else (None, None)
    return basis @ turn[:, ::-1] if turn is not None else np.linalg.qr(image)[0]


def _embed(weight: Weights, space: np.ndarray):
    table = (space * weight.kept[:, None]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                t, row, _ = _rows(b, weight)
                z = np.zeros((b.num_rows, table.shape[1]), np.float32)
                if len(t):
                    rows, s = _sum_rows(table[t], row)
                    z[rows] = s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-12)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), flat], ["doc_id", "lang", "z"])

    return run


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _seed_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, str], np.ndarray] = {}
    for b in batches:
        if b.num_rows:
            z = _matrix(b.column("z"), len(b.column("z")[0])).astype(np.float64)
            for i, key in enumerate(zip(b.column("subject").to_pylist(), b.column("lang").to_pylist())):
                sums[key] = sums.get(key, 0) + z[i]
    keys = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([sums[k].tolist() for k in keys], pa.list_(pa.float64()))], ["subject", "lang", "s"])


def _foreign(known: np.ndarray):
    """Seed sums of the documents that are near none of the known centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = (b.filter(pa.array((_matrix(b.column("z"), len(b.column("z")[0])) @ known.T).max(axis=1) < FOREIGN)) if len(known) else b for b in batches if b.num_rows)
        yield from _seed_sums(far)

    return run


def _by_subject(score: np.ndarray, subject: np.ndarray, n: int) -> np.ndarray:
    out = np.full((len(score), n), -1.0, np.float32)
    for k, s in enumerate(subject):
        np.maximum(out[:, s], score[:, k], out=out[:, s])
    return out


def _leads(by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best subject, its lead over the second)."""
    best = by.argmax(axis=1)
    if by.shape[1] < 2:
        return best, by[:, 0]
    two = np.partition(by, -2, axis=1)[:, -2:]
    return best, two[:, 1] - two[:, 0]


def _move(centroids: np.ndarray, subject: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(centroids.shape, np.float64)
        for b in batches:
            if b.num_rows:
                z = _matrix(b.column("z"), centroids.shape[1])
                score = z @ centroids.T
                _, lead = _leads(_by_subject(score, subject, n))
                near = score.argmax(axis=1)
                for k in range(len(centroids)):
                    total[k] += z[(near == k) & (lead > REFINE_MARGIN)].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["k", "s"])

    return run


def _add_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"k": [pdf["k"].iloc[0]], "s": [np.sum(np.stack(pdf["s"].to_list()), axis=0)]})


def _assign(weight: Weights, space: np.ndarray, centroids: np.ndarray, subject: np.ndarray, names: list[str]):
    table = (space * weight.kept[:, None]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                n = b.num_rows
                x, row = _flat(b.column("tokens"))
                sentence = np.cumsum((x < 0) | (np.diff(row, prepend=-1) > 0))
                slot = np.where(x >= 0, weight.slot[x], -1)
                keep = slot >= 0
                doc, subj, lead = [], [], []
                if keep.any():
                    ids, v = _sum_rows(table[slot[keep]], sentence[keep])
                    of = np.zeros(int(sentence[-1]) + 1, np.int64)
                    of[sentence] = row
                    # the length in the space of words, so that a sentence of words the decomposition doesn't hold is near nothing
                    norm = np.sqrt(np.bincount(sentence[keep], weight.kept[slot[keep]] ** 2)[ids])
                    best, m = _leads(_by_subject((v / np.maximum(norm, 1e-12)[:, None]) @ centroids.T, subject, len(names)))
                    ok = (m >= MARGIN) & (norm > 0)
                    sums = np.bincount(of[ids][ok] * len(names) + best[ok], m[ok], minlength=n * len(names)).reshape(n, -1)
                    first = np.argsort(-sums, axis=1, kind="stable")[:, :2]
                    need = np.maximum(NEED, SHARE * sums.sum(axis=1))
                    for c in range(first.shape[1]):
                        top = sums[np.arange(n), first[:, c]]
                        for i in np.flatnonzero(top >= need).tolist():
                            doc.append(i)
                            subj.append(names[first[i, c]])
                            lead.append(round(float(top[i] / sums[i].sum()), 4))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(subj, pa.string()), pa.array(lead, pa.float64())], ["doc_id", "subject", "share"])

    return run


def clean_labels(labels: DataFrame, areas: list[str]) -> DataFrame:
    """(doc_id, subject): the area that each label spells with at most two letters wrong; ties to the first area."""
    given = F.lower(F.trim("subject"))
    best = F.array_min(F.array(*[F.struct(F.levenshtein(given, F.lit(a.lower())).alias("d"), F.lit(a).alias("a")) for a in areas]))
    return labels.where("subject is not null and doc_id is not null").select("doc_id", best.alias("b")).where("b.d <= 2").select("doc_id", F.col("b.a").alias("subject")).distinct()


def _counts(df: DataFrame, column: str) -> np.ndarray:
    """How many times each bucket occurs in an array column; at most TERMS rows come back."""
    out = np.zeros(TERMS, np.int64)
    for r in df.select(F.explode(column).alias("t")).groupBy("t").count().collect():
        out[r["t"]] = r["count"]
    return out


def _typical(texts: DataFrame, labelled: DataFrame, common: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Which of the common words of each language are more frequent under some subject, by the labelled texts."""
    spark = texts.sparkSession
    words = [(g, int(t)) for g, c in common.items() for t in np.flatnonzero(c)]
    out = {g: np.zeros(TERMS, bool) for g in common}
    if not words:
        return out
    seeds = texts.where(F.col("lang").isin(list(common))).join(labelled, "text_id")
    size = {(r["lang"], r["subject"]): r["count"] for r in seeds.groupBy("lang", "subject").count().collect()}
    held: dict[str, dict[str, np.ndarray]] = {}
    pairs = F.broadcast(spark.createDataFrame(words, "lang string, t int"))
    for r in seeds.select("lang", "subject", F.explode("terms").alias("t")).join(pairs, ["lang", "t"]).groupBy("lang", "subject", "t").count().collect():
        held.setdefault(r["lang"], {}).setdefault(r["subject"], np.zeros(TERMS))[r["t"]] = r["count"]
    for g, by in held.items():
        n, h = sum(c for (l, _), c in size.items() if l == g), sum(by.values())
        for s, c in by.items():
            a = size[g, s]
            if a == n:
                continue
            p, q, both = c / a, (h - c) / (n - a), h / n
            out[g] |= (p > TIMES * q) & (p - q > ERRORS * np.sqrt(both * (1 - both) * (1 / a + 1 / (n - a))))
    return out


def subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject, share): the one or two areas of each document; share is the area's part of what its sentences show.

    documents: (doc_id, text, lang, source, docket_no), whatever else they have; lang may be null or wrong. Null, blank and
    purely procedural texts have no row, nor has any document when no label names an area. Areas are a fixed small table.
    """
    spark = documents.sparkSession
    names = sorted(r["subject"] for r in areas.where("subject is not null").select("subject").distinct().collect())
    none = spark.createDataFrame([], "doc_id bigint, subject string, share double")
    if not names:
        return none
    src = documents.where(F.length(F.trim("text")) > 0).select("doc_id", "lang", "text", "source", "docket_no")
    read = materialize(src.mapInArrow(_read, "doc_id bigint, lang string, tokens array<int>, names array<int>, courts array<int>"), "words")
    name, court = _counts(read, "names") >= 2, _counts(read, "courts") > 0
    docs = read.select("doc_id", "lang", "tokens").mapInArrow(_strip(name, court), "doc_id bigint, lang string, tokens array<int>, terms array<int>")
    docs = materialize(docs, "terms")
    # documents of the same words are one text
    text_id = F.xxhash64("terms")
    one_each = docs.groupBy(text_id.alias("text_id")).agg(F.min("doc_id").alias("doc_id"))
    texts = materialize(docs.select("doc_id", "lang", "terms").join(one_each, "doc_id"), "texts")
    counted = texts.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()
    n = texts.count()
    if not n:
        return none
    # a label that few documents carry is no language of this corpus
    sizes = {r["lang"]: r["count"] for r in counted if r["lang"] is not None and r["count"] >= LANG_SHARE * n}
    group = F.when(F.col("lang").isin(list(sizes)), F.col("lang"))
    df = {}
    for r in texts.select(group.alias("g"), F.explode("terms").alias("t")).groupBy("g", "t").count().collect():  # at most LANGS * TERMS rows
        df.setdefault(r["g"], np.zeros(TERMS, np.int64))[r["t"]] = r["count"]
    total = sum(df.values()) if df else np.zeros(TERMS, np.int64)
    weight = np.log(n / np.maximum(total, 1)) * (total >= 2)
    one = clean_labels(labels, names).join(docs.select("doc_id", text_id.alias("text_id")), "doc_id")
    one = materialize(one.groupBy("text_id").agg(F.countDistinct("subject").alias("c"), F.min("subject").alias("subject")).where("c = 1").select("text_id", "subject"), "labelled")
    common = {g: c > COMMON * sizes[g] for g, c in df.items() if g is not None and sizes[g] >= 20}
    typical = _typical(texts, one, common)
    for g, c in common.items():
        weight[c & ~typical[g]] = 0
    if not (weight > 0).any():
        return none
    weight = Weights(weight)
    space = decompose(texts, weight, min(RANK, len(weight)))
    z = materialize(texts.select(F.col("text_id").alias("doc_id"), "lang", "terms").mapInArrow(_embed(weight, space), "doc_id bigint, lang string, z array<float>"), "embedded").withColumnRenamed("doc_id", "text_id")
    seeds: dict[tuple[str, str], np.ndarray] = {}
    for r in z.where(group.isNotNull()).join(one, "text_id").select("subject", "lang", "z").mapInArrow(_seed_sums, "subject string, lang string, s array<double>").collect():
        key = (r["subject"], r["lang"])
        seeds[key] = seeds.get(key, 0) + np.array(r["s"])
    known = np.array([v / np.linalg.norm(v) for v in seeds.values() if np.linalg.norm(v) > 0], np.float32)
    for r in z.where(group.isNull()).withColumn("lang", F.lit("")).join(one, "text_id").select("subject", "lang", "z").mapInArrow(_foreign(known), "subject string, lang string, s array<double>").collect():
        key = (r["subject"], r["lang"])
        seeds[key] = seeds.get(key, 0) + np.array(r["s"])
    keys = sorted(k for k, v in seeds.items() if np.linalg.norm(v) > 0)
    if not keys:
        return none
    centroids = np.array([seeds[k] / np.linalg.norm(seeds[k]) for k in keys], np.float32)
    subject = np.array([names.index(k[0]) for k in keys])
    for _ in range(REFINE_ROUNDS):
        moved = np.zeros(centroids.shape, np.float64)
        for r in z.select("z").mapInArrow(_move(centroids, subject, len(names)), "k int, s array<double>").groupBy("k").applyInPandas(_add_sums, "k int, s array<double>").collect():
            moved[r["k"]] = r["s"]
        size = np.linalg.norm(moved, axis=1, keepdims=True)
        centroids = np.where(size > 0, moved / np.maximum(size, 1e-12), centroids).astype(np.float32)
    return docs.select("doc_id", "tokens").mapInArrow(_assign(weight, space, centroids, subject, names), "doc_id bigint, subject string, share double")


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject, documents, share): how many documents of the corpus are about each area; those about none under null."""
    n = documents.count()
    per = documents.select("doc_id").join(found.select("doc_id", "subject"), "doc_id", "left").groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    return per.select("subject", "documents", F.round(F.col("documents") / F.lit(max(n, 1)), 6).alias("share"))
