"""Language identification by prediction by partial matching over bytes.

For each language a byte context tree of order 3 down to 0 is learned.  A context that was followed n times by d
distinct bytes gives byte s the probability c(s) / (n + d), and escapes to its shorter context with d / (n + d); below
order 0 every byte has probability 1/256 (escape method C, without exclusion).  The statistics are frozen before any
text is scored, so the code length of a byte after its context is a constant: for every string of one to four bytes
that any language has seen its bits are tabulated for all languages, and for every context the bits of its escape.  A
text's code lengths are sums of table rows: most bytes need one lookup, those that no language has seen after three
bytes escape to shorter strings.  The language with the shortest code wins.

Learning is bounded by ``max_docs`` documents a language (by a hash of the id, whole texts) only: every language, byte
value and context of these documents is kept.  The table has a row of four-byte numbers, one a language, for each
string that was seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_parts, fresh, held_out, map_arrow, small

ORDER = 3
#: Texts are scored in pieces of so many bytes, whatever their length.
SEGMENT = 1 << 20


def _grams(codes: np.ndarray) -> np.ndarray:
    """The last four bytes at each position as one number; three spaces stand before a text."""
    wide = np.concatenate([np.full(ORDER, 32, np.uint8), codes]).astype(np.uint32)
    return wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, at = binary_parts(batch.column("text"))
    langs = batch.column("lang").to_pylist()
    parts: dict[str, list[np.ndarray]] = {}
    out: list[tuple[str, np.ndarray, np.ndarray]] = []

    def settle(lang: str) -> None:
        grams, n = np.unique(np.concatenate(parts.pop(lang)), return_counts=True)
        out.append((lang, grams, n))

    for i, lang in enumerate(langs):
        if at[i + 1] > at[i]:
            parts.setdefault(lang, []).append(_grams(np.frombuffer(data, np.uint8, at[i + 1] - at[i], at[i])))
            if sum(map(len, parts[lang])) > 4 * SEGMENT:
                settle(lang)
    for lang in list(parts):
        settle(lang)
    names = pa.array([x for lang, g, _ in out for x in [lang] * len(g)], pa.string())
    join = lambda k, kind: np.concatenate([x[k] for x in out]).astype(kind) if out else np.zeros(0, kind)
    return pa.RecordBatch.from_arrays([names, pa.array(join(1, np.int64)), pa.array(join(2, np.int64))], ["lang", "gram", "n"])


class Lookup:
    """Positions of known numbers, by open addressing; -1 for any other."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint32)
        self.shift = np.uint32(32 - max(3, int(4 * len(keys)).bit_length()))
        self.table = np.full(1 << (32 - int(self.shift)), -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(self.keys)
        while len(todo):
            free = self.table[slot] < 0
            self.table[slot[free]] = todo[free]  # of several the last one stands
            left = self.table[slot] != todo
            todo, slot = todo[left], slot[left] + 1 & len(self.table) - 1

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return ((x * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(x), -1, np.int32)
        slot = self._slot(x)
        out = self.table[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != x))
        while len(todo):
            slot[todo] = slot[todo] + 1 & len(self.table) - 1
            at = self.table[slot[todo]]
            out[todo] = at
            todo = todo[(at >= 0) & (self.keys[at] != x[todo])]
        return out


class Model:
    """Frozen code lengths: of each order, the strings that were seen with their bits, and the contexts with their escapes' bits."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, k = langs, len(langs)
        self.strings: list[Lookup] = []
        self.contexts: list[Lookup] = []
        self.bits: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        grams = np.concatenate([np.asarray(g, np.int64) for g, _ in counts]) if k else np.zeros(0, np.int64)
        n = np.concatenate([np.asarray(c, np.float64) for _, c in counts]) if k else np.zeros(0)
        lang = np.repeat(np.arange(k), [len(g) for g, _ in counts])
        lower, lower_at = np.full((1, k), 8.0), np.zeros(0, np.int64)
        for order in range(ORDER + 1):
            strings, at = np.unique(grams & (1 << 8 * (order + 1)) - 1, return_inverse=True)
            seen = np.zeros((len(strings), k))
            np.add.at(seen, (at, lang), n)
            contexts, of = np.unique(strings >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, seen > 0)
            known = total > 0
            escape = np.where(known, np.log2(np.where(known, total + kinds, 1)) - np.log2(np.where(known, kinds, 1)), 0.0)
            shorter = lower[np.searchsorted(lower_at, strings & (1 << 8 * order) - 1)] if order else lower
            own = np.log2(np.maximum(total + kinds, 1))[of] - np.log2(np.where(seen > 0, seen, 1))
            lower, lower_at = np.where(seen > 0, own, escape[of] + shorter), strings
            self.strings.append(Lookup(strings))
            self.contexts.append(Lookup(contexts))
            self.bits.append(lower.astype(np.float32))
            self.escapes.append(escape.astype(np.float32))

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each four under each language."""
        at = self.strings[ORDER].find(grams)
        out = self.bits[ORDER][at]
        todo = np.flatnonzero(at < 0)
        if len(todo):
            out[todo] = 0
        for order in range(ORDER, -1, -1):
            if not len(todo):
                break
            context = self.contexts[order].find(grams[todo] >> np.uint32(8) & np.uint32((1 << 8 * order) - 1))
            out[todo[context >= 0]] += self.escapes[order][context[context >= 0]]
            if not order:
                out[todo] += 8
                break
            at = self.strings[order - 1].find(grams[todo] & np.uint32((1 << 8 * order) - 1))
            out[todo[at >= 0]] += self.bits[order - 1][at[at >= 0]]
            todo = todo[at < 0]
        return out

    def lengths(self, data, at: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        out = np.zeros((len(at) - 1, len(self.langs)))
        if not self.langs or at[-1] == at[0]:
            return out
        texts = np.flatnonzero(np.diff(at) > 0)
        starts = at[:-1][texts]
        piece = max(1, SEGMENT * 4 // max(4, len(self.langs)))
        for lo in range(int(at[0]), int(at[-1]), piece):
            hi = min(lo + piece, int(at[-1]))
            first = max(lo - ORDER, int(at[0]))
            grams = _grams(raw[first:hi])[lo - first :]
            inside = starts[(starts > lo - ORDER) & (starts < hi)] - lo
            for back in (2, 1, 0):  # before a text's first bytes stand spaces, not the text before it
                place = inside + back
                place = place[(place >= 0) & (place < hi - lo)]
                own = np.uint32((1 << 8 * (back + 1)) - 1)
                grams[place] = grams[place] & own | np.uint32(0x20202020) & ~own
            k = np.searchsorted(starts, lo, "right") - 1
            bounds = np.concatenate([[0], inside[inside > 0]])
            out[texts[k : k + len(bounds)]] += np.add.reduceat(self.costs(grams), bounds, axis=0, dtype=np.float64)
        return out


def learn(docs: DataFrame, max_docs: int = 2000) -> Model:
    """Count four-byte strings of the learning documents, on the executors, and freeze the model.

    ``docs`` has doc_id, text and lang; rows without text or lang teach nothing.  Without learning rows the model
    knows no language.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.join(small(sizes), "lang").where(draw < max_docs / F.col("_n")).select("lang", F.col("text").cast("binary").alias("text"))
    top = map_arrow(sample, _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not top.num_rows:
        return Model([], [])
    names = np.asarray(top["lang"].to_pylist(), dtype=object)
    grams, n = top["gram"].to_numpy(), top["n"].to_numpy().astype(np.float64)
    langs = sorted(set(names))
    return Model(langs, [(grams[names == x], n[names == x]) for x in langs])


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, temper_bytes: int = 64) -> DataFrame:
    """Add lang_pred, score and bits_per_byte (of the best language) to every row of ``docs``.

    Its columns (or those of ``keep``) stay, but for any that have one of these three names.

    A null text, or one without a letter, is ``und`` with score 0, as is every text when no language was learned.  The
    score is the share of the best language when each language weighs 2 ** -(its bits), as if the text had at most
    ``temper_bytes`` bytes.  Ties go to the language first by code point.  Whole texts are scored, in pieces of bounded
    memory.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "bits_per_byte") and (keep is None or f.name in keep)]
    raw, letter = (fresh(x, docs.columns) for x in ("__bytes", "__letter"))
    kept = docs.select(*[F.col(f"`{f.name}`") for f in plain], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias(raw), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(letter))
    schema = T.StructType([*plain, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        data, at = binary_parts(batch.column(raw))
        n = np.diff(at).astype(np.float64)
        good = batch.column(letter).to_numpy(zero_copy_only=False) & bool(model.langs)
        if model.langs:
            bits = model.lengths(data, np.asarray(at, np.int64))
            best = bits.argmin(1)
            shift = (bits - bits.min(1, keepdims=True)) * (np.minimum(n, temper_bytes) / np.maximum(n, 1))[:, None]
            score = np.where(good, 1 / np.exp2(-np.minimum(shift, 1000)).sum(1), 0.0)
            names = np.where(good, np.asarray(model.langs, dtype=object)[best], "und")
            per = bits.min(1) / np.maximum(n, 1)
        else:
            names, score, per = np.full(len(n), "und", dtype=object), np.zeros(len(n)), np.zeros(len(n))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(plain)], pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(per)], [*[f.name for f in plain], "lang_pred", "score", "bits_per_byte"])

    return map_arrow(kept, step, schema)


def identify(docs: DataFrame, max_docs: int = 2000) -> DataFrame:
    """Learn from the rows that are not held out (remainder 2 of 4) and predict all."""
    return predict(docs, learn(docs.where(~held_out(4, 2)), max_docs))


def accept(docs: DataFrame, model: Model, against: float = 64.0) -> DataFrame:
    """The rows of ``docs`` whose text is in a language of the model; columns of any names are kept.

    Rejected are null texts, texts without a letter, and those that every language's trees encode in ``against`` or
    more bits beyond eight a byte: plain bytes then explain the text 2 ** ``against`` times better than any language.
    Where no language was learned, nothing speaks against a text that has letters.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = predict(docs.select(row, F.col("text"), F.octet_length("text").alias("bytes")), model, keep=["row", "bytes"])
    return found.where((F.col("lang_pred") != "und") & ((F.col("bits_per_byte") - 8) * F.col("bytes") < against)).select("row.*")
