"""Language identification with a byte convolutional network trained in numpy.

Bytes of the lower-cased text (digits as one symbol, ASCII punctuation as blanks) are embedded; filters of widths 2, 3 and 4
slide over a window of WINDOW bytes, each keeps its maximum, and a softmax over the maxima gives the language. For
prediction embedding and filters collapse into tables indexed by pairs of bytes, so a position costs two look-ups and an
addition for all filters at once. Every byte of a text is in exactly one window; a text's language is the one with the
largest sum of log-probabilities, each window counting by its length, and its score the mean probability of that language.

Training sees at most PER_LANGUAGE documents of a language (PIECES stretches of WINDOW characters each), chosen by hash
among the documents with a language that aren't held out; everything else covers all data.

Defined cases: text that is null or has no letter is `und` with score 0. Without any training text all is `und`. Rows
that repeat get the same prediction; an empty table gives an empty table; extra columns aren't read. A null doc_id counts
as the empty text for the fold. Ties go to the language first in code point order.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import fresh, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
PER_LANGUAGE = 500
PIECES = 3
FOLDS = 5
EPOCHS = 10
LETTER = re.compile(r"[^\W\d_]")

_MAP = np.arange(256, dtype=np.uint8)
_MAP[:128] = 32
_MAP[48:58] = 48
_MAP[65:91] = np.arange(97, 123)
_MAP[97:123] = np.arange(97, 123)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_pieces(docs: DataFrame, per_language: int = PER_LANGUAGE, pieces: int = PIECES) -> list[tuple[str, str]]:
    """(lang, text) to learn from: at most `pieces` stretches of WINDOW characters of about `per_language` documents of each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", "lang"), 11).cast("double") / float(1 << 53)
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in sorted(counts.items())])
    n = F.length("text")
    starts = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.lit(1), n - WINDOW + 1)).cast("int") + 1 for k in range(pieces)]
    stretches = F.array(*[F.substring(F.col("text"), s, F.lit(WINDOW)) for s in starts])
    rows = known.where(unit < share).select("doc_id", "lang", F.explode(stretches).alias("text")).collect()
    return sorted({(r["lang"], r["text"]) for r in rows})


def symbols(raw: bytes | np.ndarray) -> np.ndarray:
    return _MAP[np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw]


class ByteNet:
    """Embedding (256 x DIM), one filter bank for each width, dense layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"E": rng.normal(0, 0.5, (256, DIM)), "D": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), "c": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray, lengths: np.ndarray):
        """x (n, WINDOW) bytes -> probabilities, and what the backward pass needs."""
        e = self.p["E"][x]
        tops, kept = [], []
        for w in WIDTHS:
            cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * DIM)
            a = cols @ self.p[f"W{w}"] + self.p[f"b{w}"]
            beyond = np.arange(a.shape[1])[None, :] > np.maximum(lengths - w, 0)[:, None]
            a[beyond] = -np.inf
            at = a.argmax(axis=1)
            tops.append(np.take_along_axis(a, at[:, None], 1)[:, 0])
            kept.append((cols, at))
        m = np.concatenate(tops, axis=1)
        h = np.maximum(m, 0)
        z = h @ self.p["D"] + self.p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), (kept, m, h)

    def gradients(self, x, lengths, y):
        prob, (kept, m, h) = self.forward(x, lengths)
        dz = prob.copy()
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        g = {"D": h.T @ dz, "c": dz.sum(axis=0), "E": np.zeros_like(self.p["E"])}
        dm = (dz @ self.p["D"].T) * (m > 0)
        rows = np.arange(len(x))[:, None]
        for i, w in enumerate(WIDTHS):
            cols, at = kept[i]
            d = dm[:, i * FILTERS : (i + 1) * FILTERS]
            own = cols[rows, at]  # (n, FILTERS, w * DIM)
            g[f"W{w}"] = np.einsum("nfk,nf->kf", own, d)
            g[f"b{w}"] = d.sum(axis=0)
            back = d[:, :, None] * self.p[f"W{w}"].T[None]
            for j in range(w):
                np.add.at(g["E"], x[rows, at + j], back[:, :, j * DIM : (j + 1) * DIM])
        return g

    def train(self, x, lengths, y, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.005, seed: int = 7):
        """Adam; deterministic for equal input."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                g = self.gradients(x[own], lengths[own], y[own])
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= (rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> dict[str, np.ndarray]:
        """Filters of all widths as sums over pairs of bytes: `one` for positions 0 and 1, `two` for 2 and 3 (of widths above 2)."""
        part = lambda w, j: self.p["E"] @ self.p[f"W{w}"][j * DIM : (j + 1) * DIM]  # noqa: E731  (256, FILTERS)
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        none = np.zeros((256, FILTERS), np.float32)
        one = np.concatenate([pair(part(w, 0), part(w, 1)) for w in WIDTHS], axis=1)
        two = np.concatenate([pair(part(3, 2), none), pair(part(4, 2), part(4, 3))], axis=1)
        bias = np.concatenate([self.p[f"b{w}"] for w in WIDTHS])
        return {"one": one.astype(np.float32), "two": two.astype(np.float32), "bias": bias, "D": self.p["D"], "c": self.p["c"]}


def windows_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, lengths, text of each) of the texts raw[offsets[i]:offsets[i + 1]]; the last window of a text is filled up with zeros."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), count)
    first = np.append(0, np.cumsum(count))[:-1]
    start = offsets[owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
    lengths = np.minimum(offsets[owner + 1] - start, WINDOW) if len(owner) else np.zeros(0, np.int64)
    at = start[:, None] + np.arange(WINDOW)[None, :]
    x = raw[np.minimum(at, max(0, len(raw) - 1))] if len(raw) else np.zeros((0, WINDOW), np.uint8)
    x = np.where(np.arange(WINDOW)[None, :] < lengths[:, None], x, 0).astype(np.uint8)
    return x, lengths, owner


def log_probabilities(t: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray, step: int = 32) -> np.ndarray:
    """(windows, languages) by the tables; the same as ByteNet.forward up to rounding."""
    out = np.empty((len(x), len(t["c"])), np.float32)
    f = FILTERS
    wide = np.zeros((step, WINDOW + 3), np.int64)
    for lo in range(0, len(x), step):
        n = min(step, len(x) - lo)
        wide[:n, :WINDOW] = x[lo : lo + n]
        pair = (wide[:n, :-1] << 8) | wide[:n, 1:]
        a = t["one"][pair[:, :WINDOW]]
        a[:, :, f:] += t["two"][pair[:, 2 : WINDOW + 2]]
        short = lengths[lo : lo + n]
        for i, w in enumerate(WIDTHS):
            beyond = np.arange(WINDOW)[None, :] > np.maximum(short - w, 0)[:, None]
            a[:, :, i * f : (i + 1) * f][beyond] = -np.inf
        h = np.maximum(a.max(axis=1) + t["bias"], 0)
        z = h @ t["D"] + t["c"]
        z -= z.max(axis=1, keepdims=True)
        out[lo : lo + n] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    return out


def fit(pieces: list[tuple[str, str]], seed: int = 7) -> ByteNet | None:
    """A network learnt from (lang, text). Half of the windows are cut to a random shorter length, as short texts occur."""
    rng = np.random.default_rng(seed)
    raws, labels = [], []
    languages = sorted({k for k, _ in pieces})
    for lang, text in pieces:
        if LETTER.search(text):
            raw = symbols(text.lower().encode())[:WINDOW]
            raws.append(raw if rng.random() < 0.5 else raw[: max(4, int(len(raw) * rng.random()))])
            labels.append(languages.index(lang))
    if not raws:
        return None
    x, lengths, _ = windows_of(np.concatenate(raws), np.append(0, np.cumsum([len(r) for r in raws])))
    return ByteNet(languages, seed).train(x, lengths, np.array(labels))


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    (held,) = fresh(["doc_id", "text"], "held_out")
    given = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias(held), "text")
    # Parameters, a few kilobytes; the tables are built by each worker process.
    shared = spark.sparkContext.broadcast(None if net is None else (net.languages, net.p))

    def run(it):
        tables = languages = None
        if shared.value is not None:
            languages, p = shared.value
            own = ByteNet(languages)
            own.p = p
            tables = own.tables()
        for batch in it:
            for part in hashing.slices(batch, "text"):
                column = part.column(part.schema.get_field_index("text"))
                texts = column.to_pylist()
                lettered = np.array([t is not None and LETTER.search(t) is not None for t in texts], bool)
                pred, score = ["und"] * len(texts), [0.0] * len(texts)
                if tables is not None and lettered.any():
                    raw, offsets = hashing.text_bytes(pa.compute.utf8_lower(pa.compute.fill_null(column, "")))
                    x, lengths, owner = windows_of(symbols(raw), offsets)
                    logs = log_probabilities(tables, x, lengths)
                    sums = np.zeros((len(texts), len(languages)))
                    means = np.zeros((len(texts), len(languages)))
                    np.add.at(sums, owner, logs * lengths[:, None])
                    np.add.at(means, owner, np.exp(logs) * lengths[:, None])
                    best = sums.argmax(axis=1)
                    total = np.maximum(np.diff(offsets), 1)
                    for i in np.flatnonzero(lettered):
                        pred[i], score[i] = languages[best[i]], float(min(1.0, means[i, best[i]] / total[i]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op5_lang_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit(training_pieces(docs)))
