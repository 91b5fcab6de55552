"""Hard negatives by a secondary-sort shuffle.

Vectors become integers, so scores are exact. Anchors and rows meet in blocks of bounded size (every anchor against every row, a block of scores at a time).
First each block gives each anchor's best rows of its own label; their best over all blocks are its positives and set the score ranges in which negatives
lie. Then each block gives, for each range, the best rows of other labels in it: no other row of the block can be among the answer, so nothing is lost before the
shuffle. Pairs are dealt by anchor and sorted within partitions by (anchor, descending score, positives first, id), and one iterator over each
partition opens a window at each positive, gives negatives to the windows that are open and closes those that are full or passed; it holds one anchor's
open windows at a time, never an anchor's pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.store import in_batches, saved

#: Anchors and rows of one block, and anchors scored at once in it: 8 MB of scores.
ANCHORS, ROWS, SLICE = 4096, 4096, 256
#: Integers beyond this are not taken: their products would not fit a long.
MOST = 1 << 28
PAIRS = "anchor_id long, score long, negative boolean, id long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    n, values = len(column), column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(n, len(values) // max(n, 1))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where sums fit their 53 bits, which is faster."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if bound < 2**53 else a @ b.T


def _best(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of each line's first ``most`` allowed columns, by falling score, then column."""
    few = min(most, scores.shape[1])
    masked = np.where(allowed, scores, np.iinfo(np.int64).min)
    least = np.partition(masked, scores.shape[1] - few, axis=1)[:, -few][:, None] if few else masked[:, :0]
    line, column = np.nonzero(allowed & (scores >= least))  # at ties more than asked for: first by column, cut below
    order = np.lexsort((column, -scores[line, column], line))
    line, column = line[order], column[order]
    place = np.arange(len(line)) - np.searchsorted(line, line)
    return line[place < most], column[place < most]


def _block(anchors: pa.Table, rows: pa.Table, positives: int, negatives: int, low: tuple[int, int]) -> pa.Table:
    """Pairs of a block: best rows of the anchor's label, or, where anchors have their positives' scores, the best of other labels in each range."""
    rows = rows.sort_by("id")
    ids, labels, x = rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["x"])
    out = []
    for at in range(0, anchors.num_rows if rows.num_rows else 0, SLICE):
        some = anchors.slice(at, SLICE)
        who, scores = some["id"].to_numpy(), _scores(_matrix(some["x"]), x)
        same = some["label"].to_numpy()[:, None] == labels[None, :]
        if "scores" not in anchors.column_names:
            out.append((who, scores, False, *_best(scores, same & (who[:, None] != ids[None, :]), positives)))
            continue
        lists = some["scores"].to_pylist()
        found = []
        for k in range(max((len(s) for s in lists), default=0)):
            top = np.array([s[k] if k < len(s) else 0 for s in lists], np.int64)[:, None]
            there = np.array([k < len(s) for s in lists])[:, None]
            found.append(np.stack(_best(scores, there & ~same & (scores <= top) & (low[1] * scores >= low[0] * top), negatives)))
        if found:
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            out.append((who, scores, True, pairs[0], pairs[1]))
    names = ["anchor_id", "score", "negative", "id"]
    columns = [np.concatenate(c) for c in zip(*[(who[i], s[i, j], np.full(len(i), neg), ids[j]) for who, s, neg, i, j in out], strict=True)] or [np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64)]
    return pa.table(columns, names=names)


def _windows(batches: Iterator[pa.RecordBatch], positives: int, negatives: int, low: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The streaming pass over pairs in order."""
    anchor, opened, windows = None, 0, []
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in MINED.split(", ")]
    for batch in batches:
        out = []
        for who, score, negative, row in zip(*(batch.column(c).to_pylist() for c in ("anchor_id", "score", "negative", "id")), strict=True):
            if who != anchor:
                anchor, opened, windows = who, 0, []
            if not negative:
                if opened < positives:
                    opened += 1
                    windows.append([row, score, 0])
                continue
            windows = [w for w in windows if w[2] < negatives and low[1] * score >= low[0] * w[1]]
            for w in windows:
                w[2] += 1
                out.append((who, w[0], w[2], row, w[1], score))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names)


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100)
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and each of its positives, the best rows of other labels whose
    score is at most the positive's and at least ``low`` of it (a fraction in integers).

    ``rows``: ``id long, label, x array<long>``; ``anchors``: ``id``, those rows that are anchors. A score is the inner product with the anchor's x; higher come first, then smaller
    ids. Positives are an anchor's first ``positives`` other rows of its label. Rows with a null in id, label or x, or in it, or with a component beyond 2**28, take no part; of rows that share
    an id one does, the least by (label, x); only vectors of one length are compared. A range with no row (also where the positive's score is below zero) gives none,
    nor does an empty table. Other columns are left out.
    """
    fits = F.forall("x", lambda v: v.isNotNull() & v.between(-MOST, MOST))
    rows = rows.select("id", F.col("label").cast("long").alias("label"), "x").where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fits)
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.*").withColumn("dims", F.size("x"))
    rows = saved(rows, "vectors")
    chosen = saved(rows.join(anchors.select("id").distinct(), "id", "left_semi"), "anchors")
    n, m = rows.count(), chosen.count()
    row_blocks, anchor_blocks = max(math.ceil(n / ROWS), 1), max(math.ceil(m / ANCHORS), 1)

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        """Each row in a block of its kind, and a copy for each block of the other kind."""
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    keys = ["dims", "a", "r"]
    right = dealt(rows, "r", row_blocks, "a", anchor_blocks)

    def pairs(left: DataFrame) -> DataFrame:
        left = dealt(left, "a", anchor_blocks, "r", row_blocks)
        run = lambda x, y: _block(x, y, positives, negatives, low)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, PAIRS)

    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = saved(pairs(chosen).withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives).drop("k"), "positives")
    tops = best.groupBy("anchor_id").agg(F.collect_set("score").alias("scores")).withColumnRenamed("anchor_id", "id")
    every = best.unionByName(pairs(chosen.join(tops, "id")))
    every = every.repartition("anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), "negative", "id")
    return in_batches(every, lambda b: _windows(b, positives, negatives, low), MINED)
