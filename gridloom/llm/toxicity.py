"""Toxicity by a classifier chain.

Categories are predicted one after the other; a category's linear model takes the words of a text and the probabilities
of the categories before it. In training these are out-of-fold predictions, so that a model learns from what it will
meet. Counts of words by label, over all labelled documents, choose each category's own words; all other words that
labelled documents have count together, as one sum of log-odds for each category. The models are logistic regressions on a
bounded sample of labelled documents, small enough to be sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import in_batches, saved
from gridloom.llm.words import _LOWER, BASES, U, pieces, run_hashes

#: Words are hashed into so many buckets; each category's model has a weight of its own for so many of them; it is fitted on so many documents at most.
#: A word gets its own weight if its rate among positive documents is so many standard errors off; the rest share one weight for each category.
BUCKETS, CHOSEN, SAMPLE, FOLDS, ERRORS = 1 << 20, 400, 20_000, 5, 5.0
#: Rows that are predicted at once.
SLICE = 512
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_buckets(column: pa.Array) -> Iterator[np.ndarray]:
    """Distinct buckets of each text's runs of letters (bytes of ASCII letters or above 127), A-Z as a-z; null counts as empty."""
    for lo, hi, w in pieces(column):
        word = _LETTER[w.data]
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        inner = w.offsets[(w.offsets > 0) & (w.offsets < len(w.data))]
        start[inner], end[inner - 1] = word[inner], word[inner - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        h = (run_hashes(_LOWER[w.data], starts, ends, BASES[0]) & U(BUCKETS - 1)).astype(np.int32)
        first = np.searchsorted(starts, w.offsets)
        for i in range(hi - lo):
            yield np.unique(h[first[i] : first[i + 1]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))


@dataclass(frozen=True)
class Chain:
    """names: categories in order; buckets: the words with a weight of their own; weights[k]: of the features (buckets, then the other words' evidence
    for each category), then of the k earlier categories' log-odds, then the constant; odds: categories x BUCKETS, log-odds of the other words."""

    names: tuple[str, ...]
    buckets: np.ndarray
    weights: tuple[np.ndarray, ...]
    odds: np.ndarray | None = None

    def features(self, sets: Iterator[np.ndarray], n: int) -> np.ndarray:
        """Presence of the buckets, then the other words' evidence."""
        x = np.zeros((n, len(self.buckets) + len(self.names)), np.float32)
        for i, s in enumerate(sets):
            x[i, np.searchsorted(self.buckets, np.intersect1d(s, self.buckets, assume_unique=True))] = 1.0
            x[i, len(self.buckets) :] = self.odds[:, s].sum(axis=1)
        x[:, len(self.buckets) :] = np.arcsinh(x[:, len(self.buckets) :])
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (rows x categories) from the features."""
        out = np.zeros((len(x), len(self.names)))
        for k, w in enumerate(self.weights):
            out[:, k] = _sigmoid(x @ w[: x.shape[1]] + _logit(out[:, :k]) @ w[x.shape[1] : -1] + w[-1])
        return out


def _regress(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 12, start: np.ndarray | None = None) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps (from ``start``, if given); the last weight is the constant. One class only: that constant."""
    constant = _logit(np.array([(y.sum() + 0.5) / (len(y) + 1)]))[0]
    w = np.append(np.zeros(x.shape[1]), constant)
    if len(np.unique(y)) < 2:
        return w
    if start is not None:
        w = start.copy()
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        slope, curve = -ridge * w, np.diag(ridge)
        for i in range(0, len(x), 2048):  # in pieces: what the driver holds beside x stays small
            part = np.concatenate((x[i : i + 2048], np.ones((len(x[i : i + 2048]), 1), x.dtype)), axis=1)
            p = _sigmoid(part @ w)
            slope += part.T @ (y[i : i + 2048] - p)
            curve += (part * (p * (1 - p)).astype(x.dtype)[:, None]).T @ part
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, labels: np.ndarray, names: tuple[str, ...], buckets: np.ndarray, folds: int = FOLDS) -> Chain:
    """labels: rows x categories, NaN where unknown. A category is fitted on the rows that have it; row i is in fold i mod ``folds``."""
    fold = np.arange(len(x)) % folds
    out_of_fold, weights = np.zeros((len(x), 0)), []
    for k in range(len(names)):
        z = np.concatenate((x, _logit(out_of_fold).astype(x.dtype)), axis=1)
        known = ~np.isnan(labels[:, k])
        weights.append(_regress(z[known], labels[known, k]))
        p = np.zeros(len(x))
        for f in range(folds):
            rows, held = known & (fold != f), fold == f
            w = _regress(z[rows], labels[rows, k], start=weights[-1]) if rows.any() else weights[-1]
            p[held] = _sigmoid(z[held] @ w[:-1] + w[-1])
        out_of_fold = np.concatenate((out_of_fold, p[:, None]), axis=1)
    return Chain(names, buckets, tuple(weights))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(word_buckets(batch.column(batch.num_columns - 1))), pa.list_(pa.int32()))], [*batch.schema.names[:-1], "words"])


def learn(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], sample: int = SAMPLE, chosen: int = CHOSEN) -> Chain:
    """The chain, from documents (``doc_id, text``) and labels (``doc_id`` and one 0/1 column for each category, null where unknown).

    For each category the ``chosen`` buckets whose rate among positive documents differs from that among all by most standard errors get
    a weight of their own (counts over all labelled documents, combined before the shuffle). Every other counted bucket has log-odds:
    of its counts and a prior of one document of the rarer kind at the whole's rate. The driver holds ``BUCKETS`` of these at most, and the
    sample: the ``sample`` labelled documents of least id hash (with repeated ids a few more), with their own words and their sums. A document's sums in training come
    from the documents of other folds, as a word seen once would else name its own document's label.
    """
    y = [F.col(c).cast("double").alias(c) for c in categories]
    named = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("labelled"), *y)
    # Words first, join second: the exchange holds sets of buckets, not texts. By merge at every size, as labels grow with documents.
    words = in_batches(docs.where("doc_id IS NOT NULL"), _features, "doc_id long, words array<int>")
    rows = words.join(named.hint("merge"), F.col("doc_id") == F.col("labelled")).select("doc_id", *categories, "words")
    rows = saved(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")), "labelled")
    kinds = range(len(categories))
    whole = rows.agg(*[F.sum(c).alias(f"p{k}") for k, c in enumerate(categories)], *[F.count(c).alias(f"n{k}") for k, c in enumerate(categories)], F.count("*").alias("rows")).first()
    by_fold = [f(F.when(F.col("fold") == i, F.col(c))).alias(f"{n}{k}_{i}") for k, c in enumerate(categories) for i in range(FOLDS) for n, f in (("p", F.sum), ("n", F.count))]
    counted = rows.select(*categories, "fold", F.explode("words").alias("bucket")).groupBy("bucket").agg(*by_fold)

    def total(n: str, k: int, left_out: int | None = None) -> Column:
        return sum((F.coalesce(F.col(f"{n}{k}_{i}").cast("double"), F.lit(0.0)) for i in range(FOLDS) if i != left_out), F.lit(0.0))

    def log_odds(k: int, left_out: int | None = None) -> Column:
        n, p = whole[f"n{k}"] or 0, whole[f"p{k}"] or 0.0
        if not 0 < p < n:
            return F.lit(0.0)
        rate, prior = p / n, n / min(p, n - p)
        yes, all_ = total("p", k, left_out), total("n", k, left_out)
        return F.log((yes + prior * rate) / (all_ - yes + prior * (1 - rate)) * ((1 - rate) / rate))

    counted = saved(counted.select("bucket", *[total(n, k).alias(f"{n}{k}") for k in kinds for n in "pn"], *[log_odds(k).alias(f"o{k}") for k in kinds], *[F.array(*[log_odds(k, i) for i in range(FOLDS)]).alias(f"out{k}") for k in kinds]), "word-counts")
    picked: set[int] = set()
    for k in kinds:
        n, p = whole[f"n{k}"] or 0, whole[f"p{k}"] or 0.0
        if n and 0 < p < n:
            rate = p / n
            z = (F.col(f"p{k}") - F.col(f"n{k}") * rate) / F.sqrt(F.col(f"n{k}") * rate * (1 - rate) + 1)
            picked |= {r["bucket"] for r in counted.where(F.abs(z) >= ERRORS).orderBy(F.abs(z).desc(), "bucket").limit(chosen).select("bucket").collect()}
    buckets = np.array(sorted(picked), np.int32)
    known = counted.select("bucket", *[F.col(f"o{k}").cast("float").alias(f"o{k}") for k in kinds]).toArrow()
    odds = np.zeros((len(categories), BUCKETS), np.float32)
    odds[:, known.column("bucket").to_numpy()] = np.stack([known.column(f"o{k}").to_numpy() for k in kinds])
    odds[:, buckets] = 0.0
    chain = Chain(categories, buckets, (), odds)
    lit = F.array(*[F.lit(int(b)) for b in buckets]).cast("array<int>")
    # The hash that the sample ends at: of hashes alone, and of those below a bound that leaves about so many.
    spot = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    near = rows.where(spot <= min(2**63 - 1, int(1.1 * sample / max(whole["rows"], 1) * 2**63)))
    last = near.select(spot.alias("spot")).orderBy("spot").limit(sample).agg(F.max("spot").alias("spot")).first()["spot"]
    some = saved(near.where(spot <= F.lit(last).cast("long")).withColumn("row", F.monotonically_increasing_id()), "sample")
    rest = some.select("row", "fold", F.explode(F.array_except("words", lit)).alias("bucket")).join(counted, "bucket")
    sums = rest.groupBy("row").agg(*[F.sum(F.get(f"out{k}", F.col("fold"))).alias(f"s{k}") for k in kinds])
    some = some.select("row", *categories, F.array_intersect("words", lit).alias("words")).join(sums, "row", "left").orderBy("row").toArrow()
    x = chain.features((np.sort(np.array(w.as_py(), np.int32)) for w in some.column("words")), some.num_rows)
    for k in kinds:
        x[:, len(buckets) + k] = np.arcsinh(np.nan_to_num(some.column(f"s{k}").to_numpy().astype(float)))
    labelled = np.stack([some.column(c).to_numpy().astype(float) for c in categories], axis=1) if some.num_rows else np.zeros((0, len(categories)))
    return replace(fit(x, labelled, categories, buckets), odds=odds)


def _predict(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # In slices: a batch of short texts has many rows, and a row has a feature for each word with a weight of its own.
            sets, at = word_buckets(batch.column("text")), range(0, batch.num_rows, SLICE)
            parts = [chain.predict(chain.features(islice(sets, SLICE), min(SLICE, batch.num_rows - i))) for i in at]
            p = np.concatenate(parts) if parts else np.zeros((0, len(chain.names)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1]))], ["doc_id", *(f"p_{c}" for c in chain.names)])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("low_quality", "toxic"), verdict: str = "toxic", least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, p_<category> ..., <verdict>``: one row for each row of ``docs``; the verdict is that its category has ``least`` or more.

    Null text counts as empty. Null doc_id: scored, never labelled. Repeated rows and repeated labels count each. A category without labels of
    both kinds gets its labels' share as a constant (a half without labels). Other columns are ignored. An empty table gives
    an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chain = learn(rows, labels, categories)
    kind = ", ".join(["doc_id long", *(f"p_{c} double" for c in categories)])
    return in_batches(rows, _predict(chain), kind).withColumn(verdict, F.col(f"p_{verdict}") >= least)
