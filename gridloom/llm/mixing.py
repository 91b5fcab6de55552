"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is each of its documents' expected number of copies. The whole part is taken at once; the fractions
are rounded dependently: two documents meet, words move at random from one to the other until one of them is whole, and
the other meets the next. A document with a large share of the words meets all others as one, so that it is whole before the small ones are; expectations are kept
where they have room for its words, and given up for the target where they have not.
The words in play stay the same throughout and the very last fraction, a small document's where the others could take the large ones' words, is rounded to
the nearer side: a source misses its target by half of that document. Each chunk of a source does this on its own and leaves one fraction; those meet in a tree of
sixteen-fold levels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.store import saved

WEIGHTS = (5, 2, 1)
CHUNK, FAN, LARGE, TURNS = 8192, 16, 2048, 64
_EVEN = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size`` with ``rank`` (by code point, null last) and ``target``: ``share`` of all sizes dealt by the repeating
    weights, none above ``most`` times its source's size.

    Excess that is dealt again by weight until nobody is above ends at least(cap, level * weight) for one level. With the
    sources in order of cap / weight, the level is found from running sums: those before a source are full, the rest share.
    One row for each source: sources are taken to be few enough for one sorted task.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(every)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.select("source", "source_size", rank.cast("long").alias("rank"), weight.alias("w")).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("level", (share * F.sum("source_size").over(whole) - F.col("full")) / F.col("open"))
    t = t.withColumn("level", F.max(F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level"))).over(whole))
    return t.select("source", "source_size", "rank", F.coalesce(F.least("cap", F.col("level") * F.col("w")), "cap").alias("target"))


def _pair(p: np.ndarray, size: np.ndarray, i: int, j: int, draw: float) -> None:
    """Words move from one of two documents to the other until one is whole."""
    up, down = min(size[i] * (1 - p[i]), size[j] * p[j]), min(size[j] * (1 - p[j]), size[i] * p[i])
    moved = up if draw * (up + down) < down else -down
    p[i] += moved / size[i]
    p[j] -= moved / size[j]
    for x in (i, j):
        if min(p[x], 1 - p[x]) < _EVEN:
            p[x] = round(p[x])


def _shares(p: np.ndarray, size: np.ndarray, i: int, rest: np.ndarray) -> np.ndarray:
    """The most that each of the others can move for document i whichever way it falls, in documents for each of its words."""
    return np.minimum(p[rest] / (1 - p[i]), (1 - p[rest]) / p[i]) / size[i]


def _room(p: np.ndarray, size: np.ndarray, i: int, rest: np.ndarray) -> float:
    """The part of document i's words that the others can take and keep their expectations."""
    return float(_shares(p, size, i, rest) @ size[rest])


def _against_rest(p: np.ndarray, size: np.ndarray, i: int, rest: np.ndarray, draw: float) -> float:
    """A large document against all others as one unit: it moves toward 0 or 1 by its own draw, and they give or take its words, each in a share that keeps
    its expectation and stays between 0 and 1 whichever way the draw falls. It becomes whole where they have room for its words; the room's part of them is returned."""
    q, share = p[i], _shares(p, size, i, rest)
    room = float(share @ size[rest])
    part = min(room, 1.0)
    if part > 0:
        p[i] += part * (float(draw < q) - q)
        p[rest] -= (p[i] - q) * size[i] / room * share
        for x in (np.array([i]), rest):
            near = np.minimum(p[x], 1 - p[x]) < _EVEN
            p[x[near]] = np.round(p[x[near]])
    return part


def _for_target(p: np.ndarray, size: np.ndarray, i: int, rest: np.ndarray, draw: float) -> None:
    """The same where the others have no room for both outcomes: the one they have room for is taken (drawn where each could be had alone, the nearer where neither), for the target's sake."""
    q, give, take = p[i], float(p[rest] @ size[rest]), float((1 - p[rest]) @ size[rest])
    up, down = give >= size[i] * (1 - q), take >= size[i] * q
    p[i] = float(up if up != down else draw < q if up else q >= 0.5)
    words = (q - p[i]) * size[i]
    p[rest] = p[rest] + (1 - p[rest]) * min(1.0, words / take) if words > 0 else p[rest] * (1 - min(1.0, -words / give))
    near = np.minimum(p[rest], 1 - p[rest]) < _EVEN
    p[rest[near]] = np.round(p[rest[near]])


def _meet(seed: int, last: bool):
    """One chunk: fractions p of units with sizes become 0 or 1, but for one at most (none with ``last``).

    Documents of more than a ``LARGE``-th of the chunk's words are settled first, the largest before the others, each against all the rest, so that the fraction that stays last is a small document's.
    """

    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values(["size", "doc_id", "print"], ascending=[False, True, True], na_position="last", kind="stable").reset_index(drop=True)
        p, size = chunk["p"].to_numpy(copy=True), chunk["size"].to_numpy(float)
        rng = np.random.Generator(np.random.PCG64([seed, int(chunk["rank"].iloc[0]), int(chunk["chunk"].iloc[0])]))
        open_ = np.flatnonzero((p > 0) & (p < 1))
        for i in open_:
            if size[i] * LARGE <= size[open_].sum():
                break
            for _ in range(TURNS):
                open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
                rest = open_[open_ != i]
                if not 0 < p[i] < 1 or not len(rest):
                    break
                if last and _room(p, size, i, rest) < 1:
                    _for_target(p, size, i, rest, rng.random())
                elif _against_rest(p, size, i, rest, rng.random()) < 1 / TURNS:
                    break
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
        i = -1
        for j in open_:
            if i < 0:
                i = j
                continue
            _pair(p, size, i, j, rng.random())
            i = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
        if last and i >= 0:
            p[i] = float(p[i] >= 0.5)
        chunk["p"] = p
        return chunk

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, print, source, n_rows, size, source_size, target, copies``: one row for each distinct (doc_id, text, source) of ``docs``.

    size is a text's number of words, print its xxhash64, n_rows how often the row occurs; each of its rows is taken
    ``copies`` times (0 to ``most``). Rerunning gives the same copies, whatever the partitions: draws depend on ids and
    texts alone.

    Null text: size 0, copies 0 or more, which takes no words. Null source: a source of its own, ranked last. Null doc_id:
    mixed like others. Repeated rows share one decision. Other columns are ignored. An empty table gives an empty result.
    Hot sources are dealt into chunks of about ``CHUNK`` documents.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    units = rows.select("doc_id", F.xxhash64("text").alias("print"), "source", words.alias("size")).groupBy("doc_id", "print", "source", "size").agg(F.count("*").alias("n_rows"))
    units = saved(units, "units")
    sums = saved(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count("*").alias("n")), "sources")
    top = sums.agg(F.count("*").alias("sources"), F.max("n").alias("most")).first()
    dealt = targets(sums, weights, share, most).join(sums.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    dealt = saved(dealt, "targets").withColumnRenamed("source", "s")
    dealt = F.broadcast(dealt) if top["sources"] <= 100_000 else dealt
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    play = units.join(dealt, units["source"].eqNullSafe(dealt["s"])).drop("s").withColumn("rate", rate)
    # A fraction within rounding error of a whole number counts as whole.
    whole = F.floor(F.col("rate") + _EVEN).cast("double")
    play = play.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    play = play.withColumn("p", F.when(F.col("p") < _EVEN, 0.0).otherwise(F.col("p")))
    chunks = F.ceil(F.col("n") / CHUNK)
    open_ = play.where("p > 0 AND size > 0").select("doc_id", "print", "rank", (F.col("size") * F.col("n_rows")).alias("size"), F.pmod(F.xxhash64("doc_id", "print"), chunks).alias("chunk"), "p")
    kind, done, level = "doc_id long, print long, rank long, size long, chunk long, p double", None, 0
    chunks = -(-(top["most"] or 0) // CHUNK)
    while True:
        met = saved(open_.groupBy("rank", "chunk").applyInPandas(_meet(seed * 1000 + level, chunks <= 1), kind), "met")
        won = met.where("p = 0 OR p = 1").select("doc_id", "print", "rank", F.col("p").alias("won"))
        done = won if done is None else done.unionByName(won)
        if chunks <= 1:
            break
        open_ = met.where("p > 0 AND p < 1").withColumn("chunk", F.floor(F.col("chunk") / FAN))
        chunks, level = -(-chunks // FAN), level + 1
    done = done.select(F.col("doc_id").alias("d"), F.col("print").alias("f"), F.col("rank").alias("r"), "won")
    out = play.join(done, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("f")) & (F.col("rank") == F.col("r")), "left")
    return out.select("doc_id", "print", "source", "n_rows", "size", "source_size", "target", (F.col("whole") + F.coalesce("won", F.lit(0.0))).cast("int").alias("copies"))
