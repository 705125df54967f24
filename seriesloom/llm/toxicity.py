"""Toxicity by a chain of classifiers (operator 7).

Categories (``CATEGORIES``, columns of the labels) are predicted one after the other by logistic regressions on the presence
of words; each later model also sees the probabilities of all earlier categories. So that it learns from probabilities as
good as those it will meet, these are predicted out of fold while training. The last category decides. The query's chain is
the two categories that the table has labels for: ``quality``, then ``toxic``, whose model is fed the probability of quality.

Training uses the labelled documents with the smallest hashes of identifiers, at most ``MAX_LABELLED`` of them, a bounded
random sample. Per category and fold the ``FEATURES`` words with the strongest chi-square are kept, from counts over the
whole sample; each model is fitted by Newton steps with an L2 penalty.

Plan: the labels sample is broadcast (its bound is ``MAX_LABELLED`` rows); one scan finds its documents, one of each identifier
(a partial minimum, so a document that stands there any number of times leaves each task once). Words are counted by partial
aggregates, a top-k per category and fold by Spark's group limit; to the driver come the kept words and, of each document, which
of these it has: ``MAX_LABELLED`` rows of at most ``FEATURES`` times categories times (``FOLDS`` + 1) numbers, however long texts
are. Scoring is one scan, and its closure holds the kept words alone.

Defined results: null or wordless text gets the probabilities of no words; a text of any length counts with all its words;
documents without label, repeated or null identifiers are scored like any other; labels that are null are left out; of several
labels of one identifier the largest counts; of several texts of one labelled identifier that with the smallest hash;
words of equal chi-square are taken in the order of their hashes; without labelled documents of both kinds a category's
probability is the share of positive ones (0 without any), and nothing is rejected; an empty table gives an empty
result; further columns are ignored by :func:`classify` and passed through by :func:`clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, dropped, hinted, release, small_batches
from .shingles import SIGNS, shingle_sets

MAX_LABELLED = 8_000
FEATURES = 300
FOLDS = 5
#: Probability from which a document is rejected where none can be learned (see ``best_threshold``).
THRESHOLD = 0.5
#: Columns of the labels, in the order of the chain; the last decides.
CATEGORIES = ("quality", "toxic")
#: Rejected rows (16 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 500_000
#: Documents that hold a word, at least, and its least chi-square.
LEAST_DOCS, LEAST_CHI = 3, 4.0


@dataclass
class Link:
    """One category's model: intercept, weights of words, weights of earlier categories' probabilities."""

    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float

    def log_odds(self, hits: np.ndarray, before: np.ndarray) -> np.ndarray:
        """hits: sum of word weights per document; before: earlier probabilities, a column each."""
        return self.intercept + hits + before @ self.earlier


def _present(words: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(document, place in words) of each kept word in each set."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    all_ = np.concatenate([*sets, np.zeros(0, np.uint64)])
    if not len(words):
        return row[:0], row[:0]
    at = np.minimum(np.searchsorted(words, all_), len(words) - 1)
    ok = words[at] == all_
    return row[ok], at[ok]


def choose_words(rows: DataFrame, categories: list[str]) -> dict[tuple[int, int], np.ndarray]:
    """For each category and held-out fold (-1: none), the ``FEATURES`` words most associated with the category in the other
    folds, by chi-square, from documents (fold, a column per category, words)."""
    sums = [F.count("*").alias("n"), *(F.sum(c).alias(f"p{i}") for i, c in enumerate(categories))]
    docs = {r.fold: r for r in rows.groupBy("fold").agg(*sums).collect()}  # FOLDS rows at most
    of = lambda k, c: float(sum(r[c] for f, r in docs.items() if f != k))
    by_fold = [F.sum(F.when(F.col("fold") == k, v).otherwise(0)).alias(f"{n}_{k}") for k in range(FOLDS) for n, v in [("n", F.lit(1)), *((f"p{i}", F.col(c)) for i, c in enumerate(categories))]]
    counts = rows.select("fold", *categories, F.explode("words").alias("word")).groupBy("word").agg(*by_fold)

    def chi(i: int, k: int) -> Column:
        n, p = of(k, "n"), of(k, f"p{i}")
        count, hit = (sum((F.col(f"{x}_{f}") for f in range(FOLDS) if f != k), F.lit(0)).cast("double") for x in ("n", f"p{i}"))
        expected = count * (p / n)
        value = F.pow(hit - expected, 2) * n * n / F.greatest(F.lit(1e-9), count * (n - count) * (p * (n - p) / n))
        return F.when(count >= LEAST_DOCS, value).otherwise(-1.0)

    wanted = [(i, k) for i in range(len(categories)) for k in range(-1, FOLDS) if of(k, "n") and 0 < of(k, f"p{i}") < of(k, "n")]
    if not wanted:
        return {}
    scored = counts.select("word", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), chi(i, k).alias("chi")) for i, k in wanted))).alias("s")).select("word", "s.*")
    best = scored.where(F.col("chi") > LEAST_CHI).withColumn("r", F.row_number().over(Window.partitionBy("i", "k").orderBy(F.desc("chi"), "word"))).where(F.col("r") <= FEATURES)
    found: dict[tuple[int, int], list[int]] = {}
    for r in best.select("i", "k", "word").collect():  # FEATURES rows a category and fold at most
        found.setdefault((r.i, r.k), []).append(r.word)
    return {w: np.sort(np.array(found.get(w, []), np.int64).view(np.uint64)) for w in wanted}


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, steps: int = 15) -> np.ndarray:
    """Logistic regression (last weight: intercept, not penalised) by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def best_threshold(log_odds: np.ndarray, y: np.ndarray) -> float:
    """The probability that parts out-of-fold predictions with the best F1, midway to the next lower one, at most
    ``THRESHOLD`` (models fitted without a fold are surer on small samples); ``THRESHOLD`` without both kinds."""
    if not len(y) or y.min() == y.max():
        return THRESHOLD
    order = np.argsort(-log_odds, kind="stable")
    s, hit = log_odds[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[1:] == s[:-1]] = -1  # equal predictions fall on one side
    i = int(np.argmax(f1))
    return min(THRESHOLD, float(1 / (1 + np.exp(-(s[i] + s[min(i + 1, len(s) - 1)]) / 2))))


def train_chain(sets: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, words: dict[tuple[int, int], np.ndarray]) -> tuple[list[Link], float]:
    """A link per column of ``labels`` (0/1), and the last one's threshold; ``fold`` numbers each document's fold, ``words`` has
    the words of each column's model without a fold (-1: with all)."""
    n, chain, before, odds = len(sets), [], np.zeros((len(sets), 0)), np.zeros(len(sets))
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)

        def one(rows: np.ndarray, k: int, c: int = c, y: np.ndarray = y, before: np.ndarray = before) -> Link:
            if not len(rows) or y[rows].min() == y[rows].max():
                share = float(y[rows].mean()) if len(rows) else 0.0
                return Link(np.zeros(0, np.uint64), np.zeros(0), np.zeros(before.shape[1]), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
            own, kept = [sets[i] for i in rows], words[c, k]
            x = np.zeros((len(rows), len(kept)))
            x[_present(kept, own)] = 1
            w = fit(np.hstack([x, before[rows]]), y[rows])
            return Link(kept, w[: len(kept)], w[len(kept) : -1], float(w[-1]))

        odds = np.zeros(n)
        for k in range(FOLDS):
            held = np.flatnonzero(fold == k)
            if len(held):
                model = one(np.flatnonzero(fold != k), k)
                odds[held] = _apply(model, [sets[i] for i in held], before[held])
        chain.append(one(np.arange(n), -1))
        before = np.hstack([before, 1 / (1 + np.exp(-odds[:, None]))])
    return chain, best_threshold(odds, labels[:, -1])


def _apply(link: Link, sets: list[np.ndarray], before: np.ndarray) -> np.ndarray:
    """Log odds, within 12 of even."""
    row, at = _present(link.words, sets)
    hits = np.bincount(row, weights=link.weights[at], minlength=len(sets)) if len(row) else np.zeros(len(sets))
    return np.clip(link.log_odds(hits, before), -12, 12)


def predict(chain: list[Link], sets: list[np.ndarray]) -> np.ndarray:
    """Probabilities, a column per category."""
    before = np.zeros((len(sets), 0))
    for link in chain:
        before = np.hstack([before, 1 / (1 + np.exp(-_apply(link, sets, before)[:, None]))])
    return before


def sample(docs: DataFrame, labels: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> DataFrame:
    """Stored (_id, fold, columns, words: distinct hashes) of at most ``limit`` labelled documents."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), *(F.col(c).cast("int").alias(c) for c in columns)).dropna()
    known = known.groupBy("_id").agg(*(F.max(c).alias(c) for c in columns)).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    known = known.withColumn("fold", F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")
    rows = rows.groupBy("_id", "fold", *columns).agg(F.min(F.struct("h", "_text")).alias("t"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [s.view(np.int64) for s in shingle_sets(part.column(0).to_pylist(), 1, blanks=SIGNS)]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(sets, pa.list_(pa.int64()))], ["_id", "fold", *columns, "words"])

    schema = ", ".join(["_id long", "fold int", *(f"{c} int" for c in columns), "words array<long>"])
    with small_batches(docs.sparkSession):
        return cut(rows.select("t._text", "_id", "fold", *columns).mapInArrow(run, schema), "sample")


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[Link], float]:
    """The chain, and the threshold of its last category."""
    names = [f"c{i}" for i in range(len(categories))]
    known = labels.select(id_col, *(F.col(c).alias(n) for c, n in zip(categories, names, strict=True)))
    rows = sample(docs, known, names, id_col, text_col)
    words = choose_words(rows, names)
    every = np.unique(np.concatenate([*words.values(), np.zeros(0, np.uint64)]))
    kept = F.broadcast(docs.sparkSession.createDataFrame([(int(w),) for w in every.view(np.int64)], "word long"))
    present = rows.select("_id", F.explode("words").alias("word")).join(kept, "word").groupBy("_id").agg(F.collect_list("word").alias("own"))
    got = rows.select("_id", "fold", *names).join(present, "_id", "left").toArrow().sort_by("_id")
    sets = [np.sort(np.array(x or [], np.int64).view(np.uint64)) for x in got.column("own").to_pylist()]
    y = np.stack([got.column(n).to_numpy() for n in names], 1)
    dropped(rows)
    return train_chain(sets, y, got.column("fold").to_numpy(), words)


def score(docs: DataFrame, chain: list[Link], names: list[str], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``), p_<category> for each, toxic and kept (the last category decides)."""
    keep = keep or [id_col]
    fields = [docs.schema[c] for c in keep]
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    schema = StructType([*fields, *(StructField(f"p_{n}", DoubleType()) for n in names), StructField("toxic", BooleanType()), StructField("kept", BooleanType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = list(shingle_sets(part.column(0).to_pylist(), 1, blanks=SIGNS))
            p = np.round(predict(chain, sets), 6)
            bad = p[:, -1] >= threshold
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(p[:, i]) for i in range(len(names))), pa.array(bad), pa.array(~bad)], schema.fieldNames())
        release()

    return docs.select(F.col(text_col).alias("_text_"), *(F.col(c) for c in keep)).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, keep: list[str] | None = None) -> DataFrame:
    """Train on the labelled documents and score all."""
    chain, threshold = train(docs, labels, categories)
    with small_batches(docs.sparkSession):
        return cut(score(docs, chain, list(categories), threshold=threshold, keep=keep), "scored")


def clean(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns as they are. Rejected ones are told by identifier and text hash."""
    chain, threshold = train(docs, labels, categories, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("__rejected_id"), F.xxhash64(text_col).alias("__rejected_h"), F.col(text_col).alias("__text"))
    scored = score(rows, chain, list(categories), text_col="__text", threshold=threshold, keep=["__rejected_id", "__rejected_h"])
    with small_batches(docs.sparkSession):
        rejected = cut(scored.where("toxic").select("__rejected_id", "__rejected_h").distinct(), "rejected")
    same = F.col(id_col).eqNullSafe(F.col("__rejected_id")) & (F.xxhash64(text_col) == F.col("__rejected_h"))
    return docs.join(hinted(rejected, BROADCAST_ROWS), same, "left_anti")
