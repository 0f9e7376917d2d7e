"""Toxicity by weak supervision.

Voters say toxic, clean or nothing about a text: a fixed lexicon, lexicons mined from the learning rows (words and
word beginnings that are over-represented in toxic rows, dealt over several voters by rank), density and repetition
patterns, an address pattern, and absence voters.  A generative label model estimates the voters' accuracies and
correlations by expectation maximisation: given the hidden label, each voter depends on one other (the tree of the
largest conditional mutual information), so voters that go along with each other do not count twice.  Given labels
only hold the hidden label while the model's rates are estimated; the posterior of every row comes from its votes.  A
logistic regression on the mined features is trained on these posteriors and scores whole texts.

Bounds: learning uses at most about ``max_docs`` labelled documents and half as many others (by a hash, whole texts,
equal ones once), and a vocabulary of ``max_terms`` terms.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_arrow
from .linear import apply, logistic, sigmoid

#: A fixed list of common insults.
INSULTS = frozenset("idiot idiots moron morons stupid dumb fool fools clown clowns scum trash garbage pathetic worthless loser losers disgusting vile filthy imbecile cretin retard bastard asshole bitch shit fuck fucking crap whore pig vermin".split())
WORDS = re.compile(r"[^\W\d_]+")
ADDRESS = re.compile(r"\b(?:you|your|you're|he|she|they|these|those)\b(?:\W+\w+){0,2}\W+$")
BEGINNINGS = (4, 5, 6)
GROUPS = 4
#: A hit among more words than these is no vote: in a long text it may be chance.
SPARSE = 200
VOTERS = GROUPS + 6


def terms(text: str) -> Counter[str]:
    """How often each word, and each beginning of 4 to 6 letters (marked with a star), occurs in a text."""
    words = Counter(WORDS.findall(text.lower()))
    for w, n in list(words.items()):
        for k in BEGINNINGS:
            if len(w) > k:
                words[w[:k] + "*"] += n
    return words


class Lexicon:
    """Mined terms with their rank, and what a text's words hit."""

    def __init__(self, mined: list[str]):
        self.rank = {t: i for i, t in enumerate(mined)}
        self.size = len(mined)

    def hits(self, text: str) -> tuple[dict[int, int], int, int, int, bool]:
        """Count by term rank; fixed insults; hit words, words in all; whether an insult follows an address."""
        rank, found = self.rank, {}
        words = Counter(WORDS.findall(text.lower()))
        fixed = hit = 0
        first = None
        for w, n in words.items():
            got = False
            if (r := rank.get(w)) is not None:
                found[r], got = found.get(r, 0) + n, True
            for k in BEGINNINGS:
                if len(w) > k and (r := rank.get(w[:k] + "*")) is not None:
                    found[r], got = found.get(r, 0) + n, True
            if w in INSULTS:
                fixed, got = fixed + n, True
                first = first or w
            hit += n * got
        address = False
        if first is not None:
            at = text.lower().find(first)
            address = ADDRESS.search(text[max(0, at - 60) : at].lower()) is not None
        return found, fixed, hit, sum(words.values()), address

    def votes(self, found: dict[int, int], fixed: int, hit: int, n: int, address: bool) -> list[int]:
        """1 toxic, 0 clean, -1 nothing; the order is fixed."""
        by_group = [0] * GROUPS
        for r, k in found.items():
            by_group[r % GROUPS] += k
        dense = lambda k: 1 if k * SPARSE >= n and k else -1
        return [
            *map(dense, by_group),
            dense(fixed),
            1 if fixed >= 3 else -1,
            1 if hit >= 2 and dense(hit) == 1 else -1,
            1 if address else -1,
            -1 if found or fixed else 0,
            0 if n >= 8 and dense(hit) < 1 else -1,
        ]

    def features(self, found: dict[int, int], fixed: int, hit: int, n: int) -> tuple[list[int], list[float]]:
        """Sparse: presence of each term, then log counts and density."""
        extra = [np.log1p(hit), min(1.0, 20 * hit / max(n, 20)), float(fixed > 0), np.log1p(fixed)]
        return [*found, *range(self.size, self.size + len(extra))], [*[1.0] * len(found), *extra]

    @property
    def width(self) -> int:
        return self.size + 4


def mine(rows: DataFrame, max_terms: int = 400) -> list[str]:
    """Terms of toxic rows among (text, toxic): presence by label, ranked by log odds ratio times root of the count."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[label].update(terms(text).keys())
        names = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[t] for t in names], pa.int64()) for c in counts]], ["term", "clean", "toxic"])

    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []
    summed = map_arrow(rows, step, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (clean - F.col("clean") + 0.5))
    ranked = summed.where("toxic >= 4").withColumn("odds", odds).where("odds > 3").withColumn("rank", F.col("odds") * F.sqrt("toxic"))
    top = ranked.orderBy(F.desc("rank"), "term").limit(max_terms)
    return [r["term"] for r in top.select("term").collect()]


def dependence(joint: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """(voter, the one it depends on) in an order that starts from roots; ``joint`` is [label, j, k, value of j, value of k]."""
    own = np.einsum("yjjaa->yja", joint)
    apart = own[:, :, None, :, None] * own[:, None, :, None, :]
    mutual = np.einsum("y,yjkab->jk", weight, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(apart, 1e-12)))
    j = len(mutual)
    inside, out = [0], []
    while len(inside) < j:
        rest = [k for k in range(j) if k not in inside]
        best = max(((mutual[a, b], -a, -b) for a in rest for b in inside))
        out.append((-best[1], -best[2]))
        inside.append(-best[1])
    return out


def log_odds(votes: np.ndarray, post: np.ndarray, use: np.ndarray, tree: bool = True) -> np.ndarray:
    """Log odds of the label for every row, by the voters' rates and tree estimated on the rows ``use`` under ``post``."""
    onehot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    n, j = votes.shape
    flat, value, parts = onehot.reshape(n, -1), votes + 1, [use * (1 - post), use * post]
    weight = np.array([p.sum() for p in parts])
    rates = np.stack([(np.einsum("n,njv->jv", p, onehot) + 0.5) / (p.sum() + 1.5) for p in parts])
    both = np.stack([(flat * p[:, None]).T @ flat for p in parts]).reshape(2, j, 3, j, 3).transpose(0, 1, 3, 2, 4)
    apart = rates[:, :, None, :, None] * rates[:, None, :, None, :]
    joint = (both + 4 * apart) / (weight + 4)[:, None, None, None, None]
    same = np.arange(j)
    joint[:, same, same] = np.einsum("yja,ab->yjab", rates, np.eye(3))
    prior = np.clip(weight[1] / max(weight.sum(), 1e-9), 1e-3, 0.999)
    if not tree:
        return np.log(prior / (1 - prior)) + np.einsum("njv,jv->n", onehot, np.log(rates[1]) - np.log(rates[0]))
    odds = np.log(prior / (1 - prior)) + np.log(rates[1][0, value[:, 0]]) - np.log(rates[0][0, value[:, 0]])
    for a, b in dependence(joint, weight / max(weight.sum(), 1e-9)):
        given = joint[:, a, b] / joint[:, a, b].sum(1, keepdims=True)  # [label, value of a, value of b]
        odds += np.log(given[1][value[:, a], value[:, b]]) - np.log(given[0][value[:, a], value[:, b]])
    return odds


def label_model(votes: np.ndarray, labels: np.ndarray, trust: float = 0.98, steps: int = 20) -> np.ndarray:
    """Posterior of the toxic label for each row of votes (1, 0 or -1); ``labels`` is -1 where unknown.

    The first estimate is made on the labelled rows alone, all further ones on all rows.  Where there are no labelled
    rows of both labels it starts from a guess, and the first half of the steps takes the voters as independent.
    """
    known = labels >= 0
    held = np.where(labels == 1, trust, 1 - trust)
    guess = known & (len(set(labels[known])) == 2)
    post = np.where(known, held, np.where((votes == 1).any(1), 0.9, 0.03))
    use = guess if guess.any() else np.ones(len(post), bool)
    free = post
    for step in range(steps):
        free = sigmoid(log_odds(votes, post, use, tree=guess.any() or step >= steps // 2))
        post, use = np.where(known, held, free), np.ones(len(post), bool)
    return free


class Model:
    def __init__(self, lexicon: Lexicon, beta: np.ndarray):
        self.lexicon, self.beta = lexicon, beta

    def score(self, text: str) -> float:
        found, fixed, hit, n, _ = self.lexicon.hits(text)
        at, value = self.lexicon.features(found, fixed, hit, n)
        return float(sigmoid(self.beta[at] @ np.array(value) + self.beta[-1]))


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000, max_terms: int = 400) -> Model:
    """Fit on the rows of ``docs`` (doc_id, text) given; ``labels`` has doc_id and toxic (0 or 1, others ignored)."""
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n, all_rows = known.count(), docs.count()
    uniform = lambda x: F.pmod(F.xxhash64(x), F.lit(1 << 20)) / float(1 << 20)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    drawn = texts.where(uniform(F.col("doc_id").cast("string")) < min(1.0, max_docs / max(n, 1)))
    labelled = drawn.join(known, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    lexicon = Lexicon(mine(labelled, max_terms))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        votes, at, values = [], [], []
        for text in batch.column("text").to_pylist():
            found, fixed, hit, k, address = lexicon.hits(text)
            votes.append(lexicon.votes(found, fixed, hit, k, address))
            a, v = lexicon.features(found, fixed, hit, k)
            at.append(a), values.append(v)
        return pa.RecordBatch.from_arrays([pa.array(votes, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), batch.column("toxic")], ["votes", "at", "value", "toxic"])

    share = min(1.0, max_docs / max(all_rows, 1) / 2)
    others = texts.where(uniform(F.col("text")) < share).join(known, "doc_id", "left_anti").groupBy("text").agg(F.lit(-1).alias("toxic"))
    rows = map_arrow(labelled.unionAll(others), step, "votes array<int>, at array<int>, value array<double>, toxic int").toArrow()
    if not rows.num_rows:
        return Model(lexicon, np.append(np.zeros(lexicon.width), -3.0))
    votes = np.array(rows["votes"].to_pylist())
    x = np.zeros((rows.num_rows, lexicon.width))
    for i, (a, v) in enumerate(zip(rows["at"].to_pylist(), rows["value"].to_pylist(), strict=True)):
        x[i, a] = v
    y = label_model(votes, rows["toxic"].to_numpy())
    return Model(lexicon, logistic(x, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, in (0, 1); a null text counts as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.score(t) for t in batch.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return map_arrow(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")), step, f"doc_id {kind}, score double")


def rate(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Learn without the held-out rows (remainder 1 of 3) and score all: doc_id, held_out, score, predicted."""
    own = held_out(3, 1)
    model = learn(docs.where(~own), labels.where(~own))
    return score(docs, model).select("doc_id", own.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
