"""Substring deduplication by relative Lempel-Ziv parsing against the whole corpus.

The reference is the corpus itself, indexed in blocks by the hash of anchors: in every window of ``window`` words the
run of K words with the least hash is an anchor, so equal windows hold equal anchors. The index keeps each anchor that
occurs in two or more documents, with the smallest document and the spot of its first occurrence there (the text's
fingerprint plus the place, so that spots of one text, and of no other, differ as their places do).

A document is factored greedily from left to right: consecutive anchors that the index places in one smaller document
at one distance extend the factor (anchors overlap or touch, so the words between are equal too); another document or
distance begins the next factor. Factors of ``window`` words or more are duplicate spans. Windows with an indexed
anchor that no factor holds whole, those at factor boundaries above all, are then checked exactly, by 128-bit hashes
against the least document that has them. The smallest document with a window has no factor over it and so always
takes part in that check; the result is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gridloom.llm.store import in_batches, saved
from gridloom.llm.words import BASES, U, Words, pieces, run_hashes, signed


def _least(g: np.ndarray, w: int) -> np.ndarray:
    """Least of g[i:i+w] for each i that has w values, by doubling."""
    n, out, have = len(g) - w + 1, g, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[w - have : w - have + n]) if have < w else out[:n]


class _Windows:
    """The windows of a document: hashes of its anchors (runs of k words) and the least one of each window."""

    def __init__(self, h: np.ndarray, window: int):
        self.k = window // 2 + 1
        self.h, self.window = h, window
        starts = np.arange(len(h) - self.k + 1)
        self.g = run_hashes(h, starts, starts + self.k)
        self.least = _least(self.g, window - self.k + 1)


def _documents(w: Words, rows: int, window: int) -> Iterator[tuple[int, np.ndarray | None]]:
    """(row, word hashes) of the documents; None for those without a window."""
    h = w.hashes()
    for i in range(rows):
        a, b = w.first[i], w.first[i + 1]
        yield i, h[a:b] if b - a >= window else None


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in pieces(batch.column("text")):
                rows, hashes, places = [], [], []
                for i, h in _documents(w, hi - lo, window):
                    if h is None:
                        continue
                    d = _Windows(h, window)
                    wanted = np.isin(d.g, np.unique(d.least))
                    place = np.flatnonzero(wanted)
                    values, first = np.unique(d.g[place], return_index=True)
                    rows.append(np.full(len(values), lo + i))
                    hashes.append(values)
                    places.append(place[first])
                if rows:
                    at = pa.array(np.concatenate(rows))
                    prints = batch.column("print").take(at)
                    spots = prints.to_numpy() + np.concatenate(places)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(hashes))), batch.column("doc_id").take(at), prints, pa.array(spots)], ["anchor", "doc_id", "print", "spot"])

    return run


def _factors(d: _Windows, doc: int, anchors: np.ndarray, of: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shared, held): for each window, whether its anchor is indexed, and whether one factor of the greedy parse holds it whole."""
    order = np.argsort(anchors)
    anchors, of, spot = anchors[order], of[order], spot[order]
    at = np.minimum(np.searchsorted(anchors, d.least), len(anchors) - 1)
    shared = anchors[at] == d.least
    held = np.zeros(len(d.least) + 1, np.int64)
    at = np.minimum(np.searchsorted(anchors, d.g), len(anchors) - 1)
    here = np.flatnonzero((anchors[at] == d.g) & (of[at] < doc))
    if len(here):
        source, distance = of[at[here]], spot[at[here]] - here
        new = np.ones(len(here), bool)
        new[1:] = (source[1:] != source[:-1]) | (distance[1:] != distance[:-1]) | (np.diff(here) > d.k)
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(here)) - 1
        start, end = here[begin], here[last] + d.k
        long = end - start >= d.window
        np.add.at(held, start[long], 1)
        np.add.at(held, end[long] - d.window + 1, -1)
    return shared, np.cumsum(held)[:-1] > 0


def _ranges(mask: np.ndarray) -> np.ndarray:
    """start, end, start, end, ... of the runs of true values."""
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).astype(np.int32)


def _parse(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            index = [batch.column(c) for c in ("anchors", "of", "spots")]
            for lo, hi, w in pieces(batch.column("text")):
                out: list[list] = [[], [], [], [], []]
                for i, h in _documents(w, hi - lo, window):
                    if h is None:
                        continue
                    row = lo + i
                    anchors, of, spot = (c[row].values.to_numpy(zero_copy_only=False) for c in index)
                    d = _Windows(h, window)
                    shared, held = _factors(d, ids[row], anchors.view(U), of, spot)
                    left = np.flatnonzero(shared & ~held)
                    for to, x in zip(out, (row, _ranges(held), signed(run_hashes(h, left, left + window)), signed(run_hashes(h, left, left + window, BASES[2])), left.astype(np.int32)), strict=True):
                        to.append(x)
                at = pa.array(np.array(out[0], np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("print").take(at), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int32()))],
                    ["doc_id", "print", "held", "h1", "h2", "starts"],
                )

    return run


def _removal(window: int, texts_too: bool):
    """Per row: number of words, words removed, kept text, its SHA-256 and the removed spans in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, starts = batch.column("held"), batch.column("starts")
            for lo, hi, w in pieces(batch.column("text")):
                counts, gone, texts, digests, spans = w.counts(), [], [], [], []
                data = w.data.tobytes()
                for i in range(hi - lo):
                    n = int(counts[i])
                    change = np.zeros(n + 1, np.int64)
                    if held[lo + i].is_valid:
                        runs = held[lo + i].values.to_numpy()
                        np.add.at(change, runs[::2], 1)
                        np.add.at(change, runs[1::2] + window - 1, -1)
                    if starts[lo + i].is_valid:
                        s = starts[lo + i].values.to_numpy()
                        np.add.at(change, s, 1)
                        np.add.at(change, s + window, -1)
                    removed = np.cumsum(change)[:-1] > 0
                    words = data[w.offsets[i] : w.offsets[i + 1]].split()
                    if removed.any():
                        words = [words[j] for j in np.flatnonzero(~removed)]
                    text = b" ".join(words)
                    gone.append(int(removed.sum()))
                    texts.append(text)
                    digests.append(hashlib.sha256(text).hexdigest())
                    spans.append(_ranges(removed))
                out = {"doc_id": batch.column("doc_id").slice(lo, hi - lo), "n_words": pa.array(counts.astype(np.int64)), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.list_(pa.int32()))}
                if texts_too:
                    out |= {"text": batch.column("text").slice(lo, hi - lo), "kept_text": pa.array(texts, pa.binary()).cast(pa.string())}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def duplicate_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """``doc_id, print, held, starts`` (of ``docs`` with doc_id and text) for documents with duplicate windows: the first words of such windows, as ranges
    (start, end, start, end, ...) from the factors and one by one from the check. print is xxhash64 of the text; both
    together name a row. See ``substring_dedup`` for the cases."""
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("print"))
    anchors = saved(in_batches(docs, _anchors(window), "anchor long, doc_id long, print long, spot long"), "anchors")
    # Written before it is joined with what it was counted from: Spark can then split a frequent anchor's rows among tasks. So are the windows below.
    index = saved(
        anchors.groupBy("anchor")
        .agg(F.min("doc_id").alias("of"), F.max("doc_id").alias("last"), F.min_by("spot", "doc_id").alias("of_spot"))
        .where("of < last")
        .select("anchor", "of", "of_spot"),
        "index",
    )
    found = anchors.drop("spot").join(index, "anchor").groupBy("doc_id", "print")
    found = found.agg(F.collect_set(F.struct("anchor", "of", "of_spot")).alias("x"))  # a set: repeated rows bring the same anchors
    found = found.select("doc_id", "print", F.col("x.anchor").alias("anchors"), F.col("x.of").alias("of"), F.col("x.of_spot").alias("spots"))
    kind = "doc_id long, print long, held array<int>, h1 array<long>, h2 array<long>, starts array<int>"
    parsed = saved(in_batches(docs.join(found, ["doc_id", "print"]), _parse(window), kind), "parsed")
    left = parsed.select("doc_id", "print", F.explode(F.arrays_zip("h1", "h2", "starts")).alias("w")).select("doc_id", "print", "w.*")
    least = saved(left.groupBy("h1", "h2").agg(F.min("doc_id").alias("of"), F.max("doc_id").alias("last")).where("of < last").select("h1", "h2", "of"), "shared-windows")
    checked = left.join(least, ["h1", "h2"]).where("of < doc_id").groupBy("doc_id", "print").agg(F.collect_set("starts").alias("starts"))
    held = parsed.where("size(held) > 0").groupBy("doc_id", "print").agg(F.first("held").alias("held"))
    return held.join(checked, ["doc_id", "print"], "full_outer")


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans``, and with ``texts`` also ``text, kept_text``: one row for each row of ``docs``.

    A word goes if a window of ``window`` consecutive words over it has the same words as a window that starts in a
    document with a smaller doc_id; all windows are judged on the input. kept_text has the other words joined by one
    space, kept_sha256 its SHA-256 in lower-case hex, spans the removed runs (first word, end, first word, end, ...).
    text is the input.

    Null text: no words, kept_text empty. Texts of less than a window are kept. Null doc_id: kept whole and compared with
    nothing. Rows with one doc_id never remove words from each other; equal rows get equal results. Other columns are
    ignored, whatever their names. An empty table gives an empty result. Only a document's own windows are ever gathered
    in one row, never a group of documents.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = duplicate_windows(docs, window)
    whole = docs.withColumn("print", F.xxhash64("text")).join(found, ["doc_id", "print"], "left").select("doc_id", "text", "held", "starts")
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<int>" + ", text string, kept_text string" * texts
    return in_batches(whole, _removal(window, texts), kind)


def _replace(window: int, text_at: int):
    """Rows as they are, but words in duplicate windows leave the text."""
    inner = _removal(window, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("row").flatten()
            job = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), parts[text_at], batch.column("held"), batch.column("starts")], ["doc_id", "text", "held", "starts"])
            done = pa.Table.from_batches(list(inner(iter([job]))))
            parts[text_at] = pc.if_else(pc.greater(done.column("n_removed"), 0), done.column("kept_text"), parts[text_at]).combine_chunks()
            some = pc.or_(pc.less(done.column("n_removed"), done.column("n_words")), pc.equal(done.column("n_words"), 0)).combine_chunks()
            row = pa.StructArray.from_arrays(parts, fields=list(batch.schema.field("row").type))
            yield pa.RecordBatch.from_arrays([row], ["row"]).filter(some)

    return run


def without_duplicates(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words that ``substring_dedup`` removes taken out of the text; rows of which no word is left go, all
    other texts and columns stay as they are, whatever their names. Cases as in ``substring_dedup``."""
    kind = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    keyed = kind.select(F.struct(*[F.col(f"`{c}`") for c in kind.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = duplicate_windows(keyed.select("doc_id", "text"), window)
    both = keyed.withColumn("print", F.xxhash64("text")).drop("text").join(found, ["doc_id", "print"], "left").select("row", "held", "starts")
    return in_batches(both, _replace(window, kind.columns.index(text_col)), StructType([StructField("row", kind.schema)])).select("row.*")
