"""The language of each document and of each segment in it, with a confidence.

A byte convolutional network: filters of several widths over the bytes of a text, the greatest response of each filter in
a fixed-length window, and a softmax over the languages and "none" (codes, numbers, symbols). A filter is a table with one
weight for each of its places and byte values, so a response is a sum of table entries. The network is trained here, in
numpy, on a bounded sample of the labelled segments, in two steps: labels are often wrong and documents mixed, so first each half of the
sample is judged by a network trained on the other half, and what contradicts its label is left out.

A text's windows cover all of it. Its language is the one with the greatest mean log-probability over the windows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The languages, and the names that labels give them besides codes with a region.
LANGUAGES = ("en", "es", "de", "fr", "pt", "it")
NAMES = {
    "en": ("en", "eng", "english", "englisch", "ingles", "anglais", "inglese"),
    "es": ("es", "spa", "spanish", "espanol", "castellano", "spanisch", "espagnol"),
    "de": ("de", "deu", "ger", "german", "deutsch", "aleman", "allemand", "tedesco"),
    "fr": ("fr", "fra", "fre", "french", "francais", "franzosisch", "frances"),
    "pt": ("pt", "por", "portuguese", "portugues", "portugiesisch", "portugais"),
    "it": ("it", "ita", "italian", "italiano", "italienisch", "italien"),
}
NONE = "none"
CLASSES = (*LANGUAGES, NONE)
#: Bytes of a window, filter widths, filters of each width.
WINDOW, WIDTHS, FILTERS = 64, (2, 3, 4, 5), 32
#: Lines whose language a worker remembers, so that equal ones are read once; emptied when full.
KNOWN_LINES = 50_000
#: Labelled segments of each language that the network is fitted on, at most.
FIT_SEGMENTS = 1500
#: Steps of 128 windows that training makes at least.
LEAST_STEPS = 250


def label_language(value: Column) -> Column:
    """The language that a label names, in any spelling: a code, a code with a region, or a name; null if it names none."""
    v = F.lower(F.trim(value))
    # without accents and without what follows a code's dash or underscore
    v = F.translate(v, "áàâãäéèêëíìîïóòôõöúùûüñç̧̀́̂̃̈", "aaaaaeeeeiiiiooooouuuunc")
    v = F.regexp_replace(v, r"^([a-z]{2,3})[-_ ][a-z0-9]{2,8}(?:[-_ ].*)?$", "$1")
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(v.isin(*names), F.lit(lang)).otherwise(out)
    return out


def normal(text: str) -> str:
    """Composed, lower case, white space as single spaces; digits as 0."""
    t = unicodedata.normalize("NFC", text).lower()
    return re.sub(r"\d", "0", re.sub(r"\s+", " ", t).strip())


_WORD = re.compile(r"(?<![^\W_])[^\W\d_]{2,}(?![^\W_])")


def has_words(text: str) -> bool:
    """Whether a text holds words: two or more letter-only words, one of them of three letters or more."""
    words, long = 0, False
    for m in _WORD.finditer(unicodedata.normalize("NFC", text)):
        words += 1
        long |= m.end() - m.start() >= 3
        if long and words >= 2:
            return True
    return False


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all windows, the number of windows of each text); windows overlap by the widest filter, the last is padded with 0."""
    step, over = WINDOW - max(WIDTHS) + 1, max(WIDTHS) - 1
    codes = [t.encode("utf-8", "replace") for t in texts]
    counts = np.maximum(1, -(-(np.array([len(b) for b in codes], np.int64) - over) // step))
    sizes = (counts - 1) * step + WINDOW
    flat = np.frombuffer(b"".join(b.ljust(n, b"\0") for b, n in zip(codes, sizes.tolist())), np.uint8)
    if not len(flat):
        return np.zeros((0, WINDOW), np.uint8), counts
    first = np.repeat(np.cumsum(sizes) - sizes, counts)
    within = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[first + within * step], counts


class ByteCnn:
    def __init__(self, classes: int, seed: int = 0):
        g = np.random.default_rng(seed)
        self.p = {f"t{w}": (g.normal(size=(w, 256, FILTERS)) * 0.3 / w).astype(np.float32) for w in WIDTHS}
        self.p |= {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.p |= {"v": (g.normal(size=(FILTERS * len(WIDTHS), classes)) * 0.1).astype(np.float32), "c": np.zeros(classes, np.float32)}

    def _pool(self, x: np.ndarray, where: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        pooled, at = [], []
        for w in WIDTHS:
            t = self.p[f"t{w}"]
            n = x.shape[1] - w + 1
            r = t[0][x[:, :n]]
            for j in range(1, w):
                r += t[j][x[:, j : j + n]]
            if where:
                k = r.argmax(axis=1)
                at.append(k)
                m = np.take_along_axis(r, k[:, None, :], 1)[:, 0]
            else:
                m = r.max(axis=1)
            pooled.append(np.maximum(m + self.p[f"b{w}"], 0))
        return np.concatenate(pooled, axis=1), at

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of byte pairs, side by side for all widths: places 0 and 1 of every filter, 2 and 3 of those that have them, 4 of the widest."""
        if not hasattr(self, "_pairs"):
            both = lambda w, j: self.p[f"t{w}"][j][:, None, :] + (self.p[f"t{w}"][j + 1][None, :, :] if j + 1 < w else 0 * self.p[f"t{w}"][j][None, :, :])
            first = np.concatenate([both(w, 0) for w in WIDTHS], axis=2).reshape(1 << 16, -1)
            second = np.concatenate([both(w, 2) for w in WIDTHS[1:]], axis=2).reshape(1 << 16, -1)
            self._pairs = np.ascontiguousarray(first), np.ascontiguousarray(second), self.p["t5"][4]
        return self._pairs

    def _pooled(self, x: np.ndarray) -> np.ndarray:
        """As _pool, with one lookup for two places of all filters at once."""
        first, second, last = self._tables()
        wide = np.zeros((WINDOW + 2, len(x)), np.intp)  # places first, so that the greatest is taken over whole blocks
        wide[:WINDOW] = x.T
        pair = (wide[:-1] << 8) | wide[1:]
        r = first.take(pair[: WINDOW - 1], axis=0)
        r[: WINDOW - 2, :, FILTERS:] += second.take(pair[2:WINDOW], axis=0)
        r[: WINDOW - 4, :, 3 * FILTERS :] += last.take(wide[4:WINDOW], axis=0)
        for q, w in enumerate(WIDTHS):  # places where a filter would stand out of the window
            r[WINDOW - w + 1 :, :, q * FILTERS : (q + 1) * FILTERS] = -np.inf
        return np.maximum(r.max(axis=0) + np.concatenate([self.p[f"b{w}"] for w in WIDTHS]), 0)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.p["c"])), np.float32)
        for i in range(0, len(x), 64):  # so few that what is summed stays in the processor's cache
            z = self._pooled(x[i : i + 64]) @ self.p["v"] + self.p["c"]
            z -= z.max(axis=1, keepdims=True)
            out[i : i + 64] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def __getstate__(self) -> dict:
        return {"p": self.p}

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int, seed: int = 0, rate: float = 3e-3) -> "ByteCnn":
        g = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(rounds):
            order = g.permutation(len(x))
            for i in range(0, len(x), 128):
                xb, yb = x[order[i : i + 128]], y[order[i : i + 128]]
                h, at = self._pool(xb, True)
                keep = (g.random(h.shape) > 0.2).astype(np.float32) / 0.8
                hd = h * keep
                z = hd @ self.p["v"] + self.p["c"]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                z[np.arange(len(yb)), yb] -= 1
                z /= len(yb)
                grad = {"v": hd.T @ z, "c": z.sum(axis=0)}
                dh = (z @ self.p["v"].T) * keep * (h > 0)
                for q, w in enumerate(WIDTHS):
                    d = dh[:, q * FILTERS : (q + 1) * FILTERS]
                    grad[f"b{w}"] = d.sum(axis=0)
                    gt = np.zeros((w, 256 * FILTERS), np.float32)
                    for j in range(w):
                        # only the window's greatest response of a filter learns
                        byte = np.take_along_axis(xb, at[q] + j, 1).astype(np.int64)
                        gt[j] = np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), d.ravel(), 256 * FILTERS)
                    grad[f"t{w}"] = gt.reshape(w, 256, FILTERS)
                step += 1
                for k, v in grad.items():
                    m[k] += 0.1 * (v - m[k])
                    s[k] += 0.01 * (v * v - s[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        return self


def _rounds(least: int, rows: int) -> int:
    """Rounds over the rows, more of them where there are few, so that LEAST_STEPS steps are made."""
    return max(2, least, -(-LEAST_STEPS * 128 // max(1, rows)))


def train(texts: list[str], labels: list[str], rounds: int = 6, seed: int = 11) -> ByteCnn | None:
    """A network from labelled texts, some of them mislabelled; None if there are none."""
    clean = [normal(t) for t in texts]
    y0 = np.array([CLASSES.index(v) for v in labels], np.int64)
    # codes: what the sample holds itself, and made ones, so that the class is never empty
    g = np.random.default_rng(seed)
    marks = "0000000000abcdefx-_=[](){}|:;,./#+*%<>\"' "
    made = ["".join(g.choice(list(marks), g.integers(8, 64))) for _ in range(max(50, len(texts) // 10))]
    clean += made
    y0 = np.concatenate([y0, np.full(len(made), CLASSES.index(NONE))])
    x, n = windows(clean)
    y = np.repeat(y0, n)
    if not len(texts):
        return None
    half = np.repeat(g.random(len(clean)) < 0.5, n)
    kept = np.ones(len(x), bool)
    if half.any() and not half.all():
        for side in (half, ~half):
            judge = ByteCnn(len(CLASSES), seed).fit(x[side], y[side], _rounds(rounds // 2, int(side.sum())), seed)
            p = judge.log_probs(x[~side])
            kept[np.flatnonzero(~side)] = p[np.arange(len(p)), y[~side]] > np.log(0.5)
    if not kept.any():
        kept[:] = True
    return ByteCnn(len(CLASSES), seed).fit(x[kept], y[kept], _rounds(rounds, int(kept.sum())), seed)


def classify(model: ByteCnn, texts: list[str]) -> tuple[list[str | None], list[float | None]]:
    """(language, confidence) of each text, null where it holds no words of a language."""
    lang: list[str | None] = [None] * len(texts)
    conf: list[float | None] = [None] * len(texts)
    todo = [i for i, t in enumerate(texts) if t and has_words(t)]
    if not todo:
        return lang, conf
    x, n = windows([normal(texts[i]) for i in todo])
    lp = model.log_probs(x)
    mean = np.add.reduceat(lp, np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    for i, row in zip(todo, p):
        k = int(row.argmax())
        if CLASSES[k] != NONE:
            lang[i], conf[i] = CLASSES[k], round(float(row[k]), 6)
    return lang, conf


def segments(docs: DataFrame) -> DataFrame:
    """(id, seg_no, text, named): the name (0) and the non-blank lines of the body (from 1), with the languages that the document's labels name."""
    labels = F.transform(F.filter(F.coalesce("filters", F.expr("array()")), lambda f: f["field"] == "lang"), lambda f: label_language(f["value"]))
    named = F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))
    lines = F.filter(F.transform(F.split(F.coalesce("body", F.lit("")), "\n"), lambda x: x), lambda x: F.regexp_replace(x, "[ \t\r]+", "") != "")
    one = F.struct(F.lit(0).alias("seg_no"), F.col("name").alias("text"))
    rest = F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("seg_no"), x.alias("text")))
    return docs.select("id", named.alias("named"), F.explode(F.concat(F.array(one), rest)).alias("s")).select("id", "s.seg_no", "s.text", "named")


def fit_sample(segs: DataFrame, per_language: int = FIT_SEGMENTS) -> ByteCnn | None:
    """Train on at most per_language segments of each language, from documents whose labels name exactly one."""
    one = segs.where((F.size("named") == 1) & F.col("text").isNotNull()).select("text", F.col("named")[0].alias("lang"), F.xxhash64("id", "seg_no").alias("h"))
    words = one.where(F.col("text").rlike(r"(?<![\p{L}\p{N}])\p{L}{2,}(?![\p{L}\p{N}]).*(?<![\p{L}\p{N}])\p{L}{3,}(?![\p{L}\p{N}])"))
    w = Window.partitionBy("lang").orderBy("h", "text")
    rows = words.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_language).select("text", "lang").collect()
    rows.sort()
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(segs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """segs with lang and confidence for text; both null where there are no words, or no model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, tuple[str | None, float | None]] = {}
        for b in batches:
            texts = b.column("text").to_pylist()
            if len(known) > KNOWN_LINES:
                known.clear()
            new = list({t: None for t in texts if t not in known}) if model else []
            known.update(zip(new, zip(*classify(model, new))) if new else ())
            found = [known.get(t, (None, None)) for t in texts]
            lang, conf = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("seg_no"), b.column("named"), lang, conf], ["id", "seg_no", "named", "lang", "confidence"])

    return segs.mapInArrow(run, "id string, seg_no int, named array<string>, lang string, confidence double")


def document_language(found: DataFrame) -> DataFrame:
    """(id, field, lang, confidence): of each document's name and body the language with most confidence in total, and its share."""
    field = F.when(F.col("seg_no") == 0, "name").otherwise("body")
    per = found.where("lang is not null").groupBy("id", field.alias("field"), "lang").agg(F.sum("confidence").alias("s"))
    w = Window.partitionBy("id", "field")
    per = per.withColumn("all", F.sum("s").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("s"), "lang")))
    return per.where("r = 1").select("id", "field", "lang", F.round(F.col("s") / F.col("all"), 4).alias("confidence"))
