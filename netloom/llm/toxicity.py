"""Toxicity by weak supervision.

*Voters.* Lexicon voters are words, pattern voters are word beginnings of four and five
letters (they catch inflected and compound forms); both are mined from a bounded sample of
labelled rows by the lower bound of their log odds. A voter says "toxic" where it occurs
and abstains elsewhere; one more voter says "clean" where none of the others speaks.

*Label model.* A generative model with, for each voter, the chance to speak given either
class is fitted by expectation maximisation. Voters that speak together beyond what the
class explains (a word and its own beginning, say) are not independent witnesses: each
vote counts 1 / (sum of its absolute residual correlations), estimated in every round.
The given label of a row is one more vote in every round, right with the fixed chance
``RELIABLE``; without it the rounds drift to one lexicon and lose the others.

*Classifier.* A logistic regression on the voters' signals, the number of different voters
and their share of the words is trained on the posterior labels, so rows are scored by a
linear form and not by the label model.

The sample is at most ``max_fit_rows`` different labelled texts, the ones of smallest hash,
and the voters are the ``max_voters`` best; both bound what reaches the driver. Mining
counts whole texts in every task and combines them by a shuffle. Scoring is one pass.

Defined cases: a null or empty text has no word and gets the score of a text without votes;
without labelled rows of both classes every score is the share of toxic labels, or 0;
labels that are null do not train, and of several labels of an id the highest counts;
repeated rows give repeated results; an empty table gives an empty result. A score of 0.5 is a
toxic one; a very long text is read whole by one task. Other columns do
not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import bounded_batches, materialize, slices, with_fields

_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5)
#: The chance that a given label is right.
RELIABLE = 0.95


def signals(text: str) -> tuple[set[str], int]:
    """Words, and beginnings as ``^abcd``, of a text; the number of different words."""
    words = set(_WORD.findall(text.lower()))
    found = set(words)
    for n in BEGINNINGS:
        found.update("^" + w[:n] for w in words if len(w) > n)
    return found, len(words)


def _count_signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def flush(label: int) -> pa.RecordBatch:
        own, counts[label] = counts[label], Counter()
        return pa.RecordBatch.from_arrays(
            [pa.array(list(own), pa.string()), pa.array([label] * len(own), pa.int32()), pa.array(list(own.values()), pa.int64())],
            names=["signal", "label", "n"],
        )

    for batch in batches:
        for text, label in zip(batch.column("body").to_pylist(), batch.column("label").to_pylist()):
            counts[label].update(signals(text)[0])
            if len(counts[label]) > 1_000_000:
                yield flush(label)
    yield flush(0)
    yield flush(1)


def label_model(votes: np.ndarray, given: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for each row of 0/1 ``votes``, and the voters' estimated figures.

    ``given`` holds the rows' 0/1 labels: the first posteriors, and a vote in every round.
    """
    q = np.clip(given.astype(float), 0.02, 0.98)
    anchor = (2 * given.astype(float) - 1) * np.log(RELIABLE / (1 - RELIABLE))
    n, m = votes.shape
    for _ in range(rounds):
        w1, w0 = q.sum(), (1 - q).sum()
        speak1 = (q @ votes + prior) / (w1 + 1)
        speak0 = ((1 - q) @ votes + 1e-3) / (w0 + 1)
        expected = np.outer(q, speak1) + np.outer(1 - q, speak0)
        rest = votes - expected
        scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        correlation = (rest / scale).T @ (rest / scale) / max(n, 1)
        independent = 1 / np.maximum(np.abs(np.where(np.abs(correlation) > 0.1, correlation, 0)).sum(axis=1), 1)
        odds = np.log(prior / (1 - prior)) + anchor + votes @ (independent * np.log(speak1 / speak0)) + (
            1 - votes
        ) @ (independent * np.log((1 - speak1) / (1 - speak0)))
        q = np.clip(1 / (1 + np.exp(-np.clip(odds, -30, 30))), 1e-6, 1 - 1e-6)
    return q, {"speak_toxic": speak1, "speak_clean": speak0, "independent": independent}


def logistic(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the intercept) for soft labels ``q``, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (q - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _inputs(voters: dict[str, int], texts) -> tuple[np.ndarray, np.ndarray]:
    """0/1 votes (the last: none of the others speaks) and the classifier's inputs."""
    votes = np.zeros((len(texts), len(voters) + 1), np.float64)
    share = np.zeros(len(texts))
    names = voters.keys()
    for i, text in enumerate(texts):
        found, n = signals(text)
        hits = [voters[s] for s in found & names]
        votes[i, hits] = 1
        share[i] = len(hits) / max(n, 1)
    number = votes[:, :-1].sum(axis=1)
    votes[:, -1] = number == 0
    return votes, np.column_stack([votes, np.log1p(number), np.sqrt(share)])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    max_fit_rows: int = 20_000,
    max_voters: int = 300,
    min_docs: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> dict:
    """Voters and weights, learned from the labelled rows that ``train`` selects."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("label_id"), F.col("toxic").cast("int").alias("label"))
    known = known.filter("label IS NOT NULL").groupBy("label_id").agg(F.max("label").alias("label"))
    rows = docs.filter(train).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    chosen = (
        rows.select("id", F.xxhash64("body").alias("h")).join(known, F.col("id") == F.col("label_id"))
        .groupBy("h").agg(F.max("label").alias("label"), F.min("id").alias("id"))
        .orderBy("h").limit(max_fit_rows).select(F.col("id").alias("fit_id"), "label")
    )
    sample = materialize(rows.join(chosen, F.col("id") == F.col("fit_id")).select("id", "body", "label"), "toxic-fit")
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return {"voters": {}, "weights": None, "share": n1 / max(n0 + n1, 1)}
    a, b = F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0))
    counted = (
        sample.mapInArrow(_count_signals, "signal string, label int, n bigint")
        .groupBy("signal").agg(a.alias("a"), b.alias("b")).filter(F.col("a") >= min_docs)
    )
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    lower = odds - 2 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = counted.withColumn("lower", lower).filter("lower > 0.7").orderBy(F.desc("lower"), "signal").limit(max_voters)
    voters = {r["signal"]: i for i, r in enumerate(best.select("signal").collect())}

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                _, x = _inputs(voters, part.column("body").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary())], names=["label", "x"]
                )

    seen = sample.mapInArrow(vote, "label int, x binary").toArrow().combine_chunks()
    x = np.frombuffer(b"".join(seen.column("x").to_pylist()), np.float32).reshape(seen.num_rows, -1).astype(float)
    y = seen.column("label").to_numpy().astype(float)
    q, _ = label_model(x[:, : len(voters) + 1], y, n1 / (n0 + n1))
    return {"voters": voters, "weights": logistic(x, q), "share": n1 / (n0 + n1)}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` and ``votes`` (words and beginnings that spoke) of each row."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(list(model["voters"]), object)
        for batch in batches:
            for part in slices(batch, "body", 1 << 20):
                if model["weights"] is None:
                    p, spoke = np.full(part.num_rows, model["share"]), [[] for _ in range(part.num_rows)]
                else:
                    votes, x = _inputs(model["voters"], part.column("body").to_pylist())
                    p = 1 / (1 + np.exp(-np.clip(x @ model["weights"][:-1] + model["weights"][-1], -30, 30)))
                    spoke = [sorted(names[np.flatnonzero(v)].tolist()) for v in votes[:, :-1]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array(p), pa.array(spoke, pa.list_(pa.string()))], names=[id_col, "score", "votes"]
                )

    return rows.mapInArrow(run, with_fields(rows, [id_col], "score double, votes array<string>"))
