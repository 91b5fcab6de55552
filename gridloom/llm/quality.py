"""Document quality by weak supervision: rules vote good or bad or abstain, expectation-maximisation weighs them.

Measurements of each text are taken in one pass without a shuffle. The label model needs no more than the number of rows
with each combination of votes (3 to the number of rules at most), which Spark counts; on those, EM estimates how often
each rule is right when it votes at all, for good documents and for each kind of junk, and the share of each. The
posterior is then an expression over the votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gridloom.llm.store import in_batches, saved
from gridloom.llm.words import BASES, _BYTES, U, mix, pieces, run_hashes

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs", "n_marks")


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_SYMBOLS, _BANGS, _MARKS = _table(b"#*$%&|<>"), _table(b"!"), _table(b".,;:?")
_UPPER, _LETTERS = _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123)]))


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in a group of two or more, equal to an earlier one) for each key."""
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), bool)
    later[1:] = keys[order][1:] == keys[order][:-1]
    again = later.copy()
    again[:-1] |= later[1:]
    out = np.zeros((2, len(keys)), bool)
    out[0, order], out[1, order] = again, later
    return out[0], out[1]


def measure(column: pa.Array, window: int = 8) -> dict[str, np.ndarray]:
    """``FEATURES`` of each text; null counts as empty."""
    out: dict[str, list] = {f: [] for f in FEATURES}
    for lo, hi, w in pieces(column):
        rows = np.arange(hi - lo, dtype=U)

        def per_row(mask: np.ndarray, w=w) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(mask)))
            return sums[w.offsets[1:]] - sums[w.offsets[:-1]]

        counts = w.counts()
        in_word = np.zeros(len(w.data) + 1, np.int8)
        in_word[w.starts] += 1
        in_word[w.ends] -= 1
        in_word = np.cumsum(in_word[:-1], dtype=np.int8) > 0 if len(w.data) else np.zeros(0, bool)
        out["n_words"].append(counts)
        out["word_chars"].append(per_row(in_word & ((w.data & 0xC0) != 0x80)))
        for name, table in (("n_symbols", _SYMBOLS), ("n_upper", _UPPER), ("n_letters", _LETTERS), ("n_bangs", _BANGS), ("n_marks", _MARKS)):
            out[name].append(per_row(table[w.data]))
        # Lines: from a text's start or a newline to the next newline or the text's end.
        breaks = np.flatnonzero(w.data == 10)
        starts = np.unique(np.concatenate((w.offsets[:-1][np.diff(w.offsets) > 0], breaks + 1)))
        starts = starts[starts < len(w.data)]
        ends = np.append(starts[1:], len(w.data))
        ends = ends - (w.data[ends - 1] == 10) if len(ends) else ends
        has_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
        starts, ends = starts[has_word], ends[has_word]
        row = np.searchsorted(w.offsets, starts, "right") - 1
        _, later = _repeated(run_hashes(_BYTES[w.data], starts, ends, BASES[0]) ^ mix(rows[row] + U(1)))
        out["n_lines"].append(np.bincount(row, minlength=hi - lo))
        out["n_dup_lines"].append(np.bincount(row[later], minlength=hi - lo))
        # Windows of words, within a text.
        n = np.maximum(counts - window + 1, 0)
        row = np.repeat(np.arange(hi - lo), n)
        first = np.repeat(w.first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        again, _ = _repeated(run_hashes(w.hashes(), first, first + window) ^ mix(rows[row] + U(1)))
        change = np.zeros(len(w.starts) + 1, np.int64)
        np.add.at(change, first[again], 1)
        np.add.at(change, first[again] + window, -1)
        covered = np.concatenate(([0], np.cumsum(np.cumsum(change)[:-1] > 0)))
        out["n_repeat_words"].append(covered[w.first[1:]] - covered[w.first[:-1]])
    return {f: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for f, x in out.items()}


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains (also on null). {name} in the SQL stands for a measure."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        """0 bad, 1 good, 2 abstains."""
        bad, good = (F.expr(x.format_map({f: f"measures.{f}" for f in FEATURES})) for x in (self.bad, self.good))
        return F.when(bad, 0).when(good, 1).otherwise(2)


RULES = (
    Rule("repetition", "100 * {n_repeat_words} > 30 * {n_words}", "100 * {n_repeat_words} <= 15 * {n_words}"),
    Rule("symbols", "10 * {n_symbols} > {n_words}", "50 * {n_symbols} < {n_words}"),
    Rule("shouting", "{n_letters} >= 20 AND 2 * {n_upper} > {n_letters}", "{n_letters} >= 20 AND 5 * {n_upper} < {n_letters}"),
    Rule("exclaiming", "{n_words} >= 5 AND 5 * {n_bangs} > {n_words}", "20 * {n_bangs} < {n_words}"),
    Rule("lines", "{n_lines} >= 4 AND 2 * {n_dup_lines} > {n_lines}", "{n_lines} >= 2 AND 10 * {n_dup_lines} <= {n_lines}"),
    Rule("word_length", "{n_words} > 0 AND ({word_chars} < 2 * {n_words} OR {word_chars} > 15 * {n_words})", "{word_chars} BETWEEN 3 * {n_words} AND 10 * {n_words}"),
    Rule("marks", "{n_words} >= 40 AND 200 * {n_marks} < {n_words}", "{n_words} >= 20 AND 25 * {n_marks} >= {n_words}"),
    Rule("empty", "{n_words} = 0", "{n_words} >= 20"),
)
#: Priors of the label model: (chance of a bad vote, weight) for good documents, for the rule that a kind of junk is named
#: after, and for other rules on it. Weights are shares of all rows, so that the model is the same at every size.
PRIORS = {"good": (0.005, 0.2), "own": (0.9, 0.002), "other": (0.1, 0.002)}


@dataclass(frozen=True)
class LabelModel:
    """shares: of good documents, then of each rule's kind of junk; rates[class][rule]: chance that the rule's vote, if it has one, is bad."""

    shares: tuple[float, ...]
    rates: tuple[tuple[float, ...], ...]

    def accuracies(self, rules: tuple[Rule, ...] = RULES) -> dict[str, float]:
        """Chance that a rule's vote is right: good for good documents, bad for its own kind of junk."""
        good = self.shares[0]
        return {r.name: (good * (1 - self.rates[0][j]) + self.shares[j + 1] * self.rates[j + 1][j]) / (good + self.shares[j + 1]) for j, r in enumerate(rules)}

    def posterior(self, votes: Column) -> Column:
        """Probability that a row is good, from its array of votes: a table over all combinations (3 to the number of rules)."""
        n = len(self.rates[0])
        combination = np.stack(np.meshgrid(*[np.arange(3)] * n, indexing="ij"), axis=-1).reshape(-1, n)
        score = np.log(self.shares) + (combination == 0) @ np.log(self.rates).T + (combination == 1) @ np.log1p(-np.array(self.rates)).T
        q = np.exp(score - score.max(axis=1, keepdims=True))
        table = F.split(F.lit(",".join(f"{x:.12g}" for x in q[:, 0] / q.sum(axis=1))), ",").cast("array<double>")
        place = sum((F.element_at(votes, i + 1) * 3 ** (n - 1 - i) for i in range(n)), F.lit(1))
        return F.element_at(table, place)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """EM over combinations of votes (combinations x rules: 0 bad, 1 good, 2 abstains) and their counts, with ``PRIORS``.

    Junk comes in kinds that break different rules, so there is one class of good documents and one for each rule's kind of
    junk; rules vote independently within a class. It starts from rows with bad votes as junk of those kinds, for the
    most part, so that classes keep their names. No rows: the priors alone.
    """
    rules = patterns.shape[1]
    total = max(float(counts.sum()), 1.0)
    bad, good = patterns == 0, patterns == 1
    q = np.concatenate((np.full((len(counts), 1), 0.1), np.where(bad, 0.9, 0.002)), axis=1)
    q[~bad.any(axis=1), 0] = 1.0
    q /= q.sum(axis=1, keepdims=True)
    prior = np.full((rules + 1, rules, 2), PRIORS["other"])
    prior[0] = PRIORS["good"]
    prior[np.arange(rules) + 1, np.arange(rules)] = PRIORS["own"]
    for _ in range(rounds):
        mass = q * counts[:, None]
        shares = mass.sum(axis=0) + np.array([1.0, *[0.001] * rules]) * 0.01 * total
        shares /= shares.sum()
        weight = prior[:, :, 1] * total
        rates = (mass.T @ bad + prior[:, :, 0] * weight) / (mass.T @ (bad | good) + weight)
        rates = np.clip(rates, 1e-5, 1 - 1e-5)
        score = np.log(shares) + bad @ np.log(rates.T) + good @ np.log(1 - rates.T)
        q = np.exp(score - score.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
    return LabelModel(tuple(map(float, shares)), tuple(tuple(map(float, r)) for r in rates))


def measured(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row, measures``: the columns ``keep`` of ``docs`` (all by default) as one struct, whatever their names, and ``FEATURES`` as another."""
    row = docs.select(*[f"`{c}`" for c in (docs.columns if keep is None else keep)])
    kind = StructType([StructField("row", row.schema), StructField("measures", StructType([StructField(f, LongType()) for f in FEATURES]))])
    # A text that is in the row as it is goes to the workers once.
    at = row.columns.index(text_col) if text_col in row.columns and docs.schema[text_col].dataType == StringType() else None
    own = [F.col(f"`{text_col}`").cast("string").alias("text")] if at is None else []
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in row.columns]).alias("row"), *own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(batch.column(1) if at is None else batch.column(0).field(at))
            struct = pa.StructArray.from_arrays([pa.array(m[f], pa.int64()) for f in FEATURES], list(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), struct], ["row", "measures"])

    return in_batches(both, run, kind)


def votes(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the column ``votes``: an array of 0 (bad), 1 (good) and 2 (abstains), in the order of ``rules``."""
    return df.withColumn("votes", F.array(*[r.vote() for r in rules]))


def learn(voted: DataFrame, rules: tuple[Rule, ...] = RULES) -> LabelModel:
    """The label model of all rows; only counts of combinations of votes reach the driver."""
    found = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()
    return fit(np.array([r["votes"] for r in found], int).reshape(len(found), len(rules)), np.array([r["n"] for r in found], float))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, measures, votes, quality, kept``: one row for each row of ``docs``; kept where quality, the posterior, is ``least`` or more.

    Null text counts as empty: the rules that need words then vote bad or abstain. Null doc_id stays null; repeated rows
    each count. Other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    voted = saved(votes(measured(rows, "text", ("doc_id",)), rules).select("row.doc_id", "measures", "votes"), "votes")
    q = learn(voted, rules).posterior(F.col("votes"))
    return voted.withColumn("quality", q).withColumn("kept", F.col("quality") >= least)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Measures twice rather than moving texts: once for the label model, once to filter. No shuffle but that of the counts.
    """
    texts = docs.select(F.lit(True).alias("any"), F.col(f"`{text_col}`").alias("text"))
    model = learn(votes(measured(texts, "text", ("any",)), rules), rules)
    return votes(measured(docs, text_col), rules).where(model.posterior(F.col("votes")) >= least).select("row.*")
