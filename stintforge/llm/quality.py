"""Quality by co-training two views of a document.

The content view sees the text alone: frequencies of byte-class triples, repeated words, line layout.  The metadata
view sees only what stands beside the text: source, language tag, declared length.  Each view's classifier is fitted
on the labelled rows; in every round each one labels the unlabelled rows it is surest of (as many of each class as the
labelled rows suggest) for the other one.  At the end both are calibrated on rows kept aside.  Given the label the
views count as independent, so the sum of their calibrated log odds, less the prior's, scores all documents, after a
calibration of its own.

Bounds: at most about ``max_docs`` labelled and as many unlabelled documents are fitted on (by a hash, whole texts,
equal ones once); every document is scored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .linear import apply, calibrate, logistic, sigmoid

CLASSES = 8
SOURCES, LANGS, LENGTHS, LAYOUT = 32, 16, 24, 7


def _class_table() -> np.ndarray:
    """Byte classes: small, capital, digit, blank, line break, stop marks, other marks, beyond ASCII."""
    table = np.full(256, 6, np.int64)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 0, 1, 2
    table[[32, 9]], table[[10, 13]], table[[ord(c) for c in ".,;:!?"]], table[128:] = 3, 4, 5, 7
    return table


TABLE = _class_table()


def content(text: bytes) -> np.ndarray:
    """Square roots of byte-class triple frequencies, then line layout, then word repetition."""
    out = np.zeros(CLASSES**3 + LAYOUT + 4)
    counts = np.zeros(CLASSES**3)
    for at in range(0, len(text), 1 << 20):
        c = TABLE[np.frombuffer(text, np.uint8, min((1 << 20) + 2, len(text) - at), at)]
        if len(c) > 2:
            counts += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    out[: CLASSES**3] = np.sqrt(counts / max(counts.sum(), 1))
    out[CLASSES**3 : -4] = layout(text)
    words = text.lower().split()
    if words:
        tally: dict[bytes, int] = {}
        for w in words:
            tally[w] = tally.get(w, 0) + 1
        out[-4:] = len(tally) / len(words), max(tally.values()) / len(words), np.log1p(len(text) / len(words)) / 3, sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
    return out


def layout(text: bytes) -> np.ndarray:
    lines = text.split(b"\n")
    sizes = np.array([len(x) for x in lines])
    raw = np.frombuffer(text, np.uint8)
    marks = np.isin(raw, np.frombuffer(b"*#&%$|<>{}[]=~^@", np.uint8)).mean() if len(raw) else 0.0
    upper = ((raw >= 65) & (raw <= 90)).mean() if len(raw) else 0.0
    return np.array([np.log1p(len(lines)) / 5, np.log1p(sizes.mean()) / 6, len(set(lines)) / len(lines), (sizes < 20).mean(), min(1.0, 4 * marks), upper, np.log1p(sizes.max()) / 10])


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed source and language tag, and the bit length of the declared length (unknown: the last)."""
    out = np.zeros(SOURCES + LANGS + LENGTHS)
    out[zlib.crc32((source or "").encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32((lang or "").encode()) % LANGS] = 1
    out[SOURCES + LANGS + (LENGTHS - 1 if n_chars is None else min(max(n_chars, 0).bit_length(), LENGTHS - 2))] = 1
    return out


def _features(docs: DataFrame, extra: list[str]) -> DataFrame:
    """(extra columns, content, meta) with float32 arrays as bytes."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars")]
        a = [content(t).astype("<f4").tobytes() for t in cols[0]]
        b = [metadata(*row).astype("<f4").tobytes() for row in zip(*cols[1:], strict=True)]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in extra], pa.array(a, pa.binary()), pa.array(b, pa.binary())], [*extra, "content", "meta"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return map_arrow(_inputs(docs, extra), step, f"{kinds}, content binary, meta binary")


def _inputs(docs: DataFrame, extra: list[str]) -> DataFrame:
    """``extra`` and the columns of both views; source, lang and n_chars count as null where the table has none."""
    plain = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    return docs.select(*extra, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), plain("source", "string"), plain("lang", "string"), plain("n_chars", "long"))


class Model:
    """Coefficients of both views, calibrations (slope, intercept) of both and of their sum, and the prior's log odds."""

    def __init__(self, views: list[np.ndarray], scales: list[np.ndarray], both: np.ndarray, prior: float):
        self.views, self.scales, self.both, self.prior = views, scales, both, prior

    def odds(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Calibrated log odds of the views."""
        return [s[0] * apply(v, x) + s[1] for v, s, x in zip(self.views, self.scales, rows, strict=True)]

    def scores(self, content_rows: np.ndarray, meta_rows: np.ndarray) -> list[np.ndarray]:
        """Calibrated probability of good quality: content view, metadata view, both."""
        odds = self.odds([content_rows, meta_rows])
        return [sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(self.both[0] * (odds[0] + odds[1] - self.prior) + self.both[1])]


def cotrain(views: list[np.ndarray], labels: np.ndarray, aside: np.ndarray, rounds: int = 4, share: float = 0.05) -> Model:
    """``labels`` is -1 where unknown; ``aside`` marks labelled rows that only calibrate."""
    own = [np.where(aside, -1, labels).astype(float) for _ in views]
    base = labels[(labels >= 0) & ~aside].mean()
    free = int((labels < 0).sum())
    fitted: list[np.ndarray] = []
    for turn in range(rounds + 1):
        fitted = [logistic(x[y >= 0], y[y >= 0], weight=np.where(labels[y >= 0] >= 0, 1.0, 0.5)) for x, y in zip(views, own, strict=True)]
        if turn == rounds or not free:
            break
        for k, x in enumerate(views):
            other = own[1 - k]
            p = np.where((other < 0) & (labels < 0), sigmoid(apply(fitted[k], x)), np.nan)
            for target, rate in ((1.0, base), (0.0, 1 - base)):
                sure = np.argsort(np.where(np.isnan(p), np.inf, -p if target else p), kind="stable")[: int(free * share * rate)]
                sure = sure[~np.isnan(p[sure]) & (np.abs(p[sure] - target) < 0.1)]
                other[sure] = target
    test = aside & (labels >= 0)
    truth = labels[test].astype(float)
    prior = float(np.log((base + 1e-3) / (1 - base + 1e-3)))
    model = Model(fitted, [calibrate(apply(v, x[test]), truth) for v, x in zip(fitted, views, strict=True)], np.array([1.0, 0.0]), prior)
    model.both = calibrate(sum(model.odds([x[test] for x in views])) - prior, truth)
    return model


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 8000, max_free: int | None = None) -> Model | None:
    """None where the labels do not have both classes; about ``max_free`` unlabelled rows (``max_docs`` by default)."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    n, total = known.count(), docs.count()
    uniform = lambda x: F.pmod(F.xxhash64(x), F.lit(1 << 20)) / float(1 << 20)
    by_id, by_text = uniform(F.col("doc_id").cast("string")), uniform(F.col("text"))
    labelled = docs.where(by_id < min(1.0, max_docs / max(n, 1))).join(known, "doc_id")
    others = docs.where(by_text < min(1.0, (max_docs if max_free is None else max_free) / max(total, 1))).join(known, "doc_id", "left_anti").withColumn("quality", F.lit(-1))
    aside = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    drawn = _inputs(labelled, ["doc_id", "quality"]).unionByName(_inputs(others, ["doc_id", "quality"])).withColumn("aside", aside)
    once = drawn.groupBy("quality", "aside", "text", "source", "lang", "n_chars").agg(F.count("*").alias("rows"))
    rows = _features(once, ["quality", "aside"]).toArrow()
    y = rows["quality"].to_numpy()
    side = rows["aside"].to_numpy() & (y >= 0)
    if len(set(y[(y >= 0) & ~side])) < 2:
        return None
    views = [np.frombuffer(b"".join(rows[c].to_pylist()), "<f4").reshape(len(y), -1).astype(float) for c in ("content", "meta")]
    return cotrain(views, y, side)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, content_score, meta_score, score of every row; 0.5 throughout without a model."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        cols = [batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars")]
        if own is None:
            got = [np.full(batch.num_rows, 0.5)] * 3
        else:
            got = own.scores(np.array([content(t) for t in cols[0]]), np.array([metadata(*row) for row in zip(*cols[1:], strict=True)]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, got)], ["doc_id", "content_score", "meta_score", "score"])

    return map_arrow(_inputs(docs, ["doc_id"]), step, f"doc_id {kind}, content_score double, meta_score double, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Learn from ``labels`` (doc_id, quality; values other than 0 and 1 are ignored) and score every row of ``docs``.

    ``docs`` has doc_id and text, and source, lang and n_chars where they are known.  Null text counts as empty, null
    source or language as a tag of its own, null n_chars as unknown; null and repeated ids keep their rows.  Without
    both classes among the labels every score is 0.5.
    """
    return score(docs, learn(docs, labels)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
