"""Language-model scoring by a subword lattice: the probability of a text summed over all its segmentations.

The pieces and their weights are those of an existing vocabulary; nothing about them is fitted. A word's lattice, with its
begin mark, holds all ways to cut it into pieces, summed by a forward recursion in logarithms over its characters, and, if
it was seen in training, the whole word as one more arc from its begin to its end. Whole words weigh their training counts
less a discount; what the discount takes from all of them is the weight of the cuts into pieces. A text's probability is that
of its words and its end, so the probabilities of all texts of a length add up to one.

Words are scored once each, not once for each occurrence. Texts are cut into words once: they become chunks of documents, each with a
list of its distinct words, and documents are numbers of words in that list. The lists are joined with the corpus's words
and come back to their chunk; texts are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import in_batches, saved
from gridloom.llm.words import U, mix

#: Bytes of text in a chunk, and characters of words in one step of the recursion.
CHUNK_BYTES, STEP = 32 << 20, 1 << 16
BEGIN = 0x2581
_BASE = U(0x9E3779B97F4A7C15)
#: Bits of a place in the table of pieces.
_BITS = 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _pieces(path: str) -> tuple[tuple[str, ...], np.ndarray, np.ndarray, int]:
    """Pieces (control pieces as None), the 256 byte pieces' ids, hashes with ids, and the longest piece in characters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces: list = [None if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i) for i in range(n)]
    of_byte = np.full(256, -1)
    for i in range(n):
        if model.is_byte(i):
            of_byte[int(model.id_to_piece(i)[1:-1], 16)] = i
            pieces[i] = None
        elif pieces[i] is not None and chr(BEGIN) in pieces[i][1:]:
            pieces[i] = None
    hashes: dict[int, int] = {}
    longest = 1
    for i, p in enumerate(pieces):
        if p is not None:
            points = np.array([list(map(ord, p))], np.int64)
            hashes[int(_hash(points)[0])] = i
            longest = max(longest, len(p))
    keys = np.array(sorted(hashes), U)
    return tuple(pieces), of_byte, np.array([keys, [hashes[int(k)] for k in keys]], U), longest


def _hash(points: np.ndarray) -> np.ndarray:
    """Of each row's code points."""
    h = np.zeros(len(points), U)
    for j in range(points.shape[1]):
        h = h * _BASE + points[:, j].astype(U) + U(1)
    return mix(h)


class Lattice:
    """Unigram pieces with log-probabilities."""

    def __init__(self, path: str, logs: np.ndarray):
        self.pieces, self.of_byte, (self.keys, self.ids), self.longest = _pieces(path)
        self.ids = self.ids.astype(np.int64)
        self.logs = np.append(logs, -np.inf)
        # Places of the pieces by the top bits of their hashes, the next free place on a clash; -1: none.
        self.table = np.full(1 << _BITS, -1, np.int32)
        for i, at in enumerate((self.keys >> U(64 - _BITS)).astype(np.int64).tolist()):
            while self.table[at] >= 0:
                at = (at + 1) & ((1 << _BITS) - 1)
            self.table[at] = i

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        at = (h >> U(64 - _BITS)).astype(np.int64)
        i = self.table[at]
        found = np.where((i >= 0) & (self.keys[i] == h), self.ids[i], -1)
        open_ = np.flatnonzero((i >= 0) & (found < 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << _BITS) - 1)
            i = self.table[at[open_]]
            hit = (i >= 0) & (self.keys[i] == h[open_])
            found[open_[hit]] = self.ids[i[hit]]
            open_ = open_[(i >= 0) & ~hit]
        return found

    def _bytes(self, characters: np.ndarray) -> np.ndarray:
        """Log-probability of characters spelled in bytes."""
        return np.array([self.logs[self.of_byte[np.frombuffer(chr(int(c)).encode("utf-8", "surrogatepass"), np.uint8)]].sum() for c in characters])

    def run(self, points: np.ndarray) -> np.ndarray:
        """Natural log of each row's marginal probability over all cuts into pieces; single characters without a piece are spelled in bytes."""
        n, length = points.shape
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0.0
        raw = np.zeros((self.longest, n), U)
        for end in range(1, length + 1):
            c = points[:, end - 1].astype(U) + U(1)
            most = min(self.longest, end)
            # raw[k]: polynomial of the k + 1 characters that end here.
            for k in range(most - 1, 0, -1):
                raw[k] = raw[k - 1] * _BASE + c
            raw[0] = c
            found = self._find(mix(raw[:most]).ravel()).reshape(most, n)
            into = alpha[end]
            for k in range(most):
                rows = np.flatnonzero(found[k] >= 0)
                if len(rows):
                    into[rows] = np.logaddexp(into[rows], alpha[end - 1 - k][rows] + self.logs[found[k][rows]])
            rows = np.flatnonzero(found[0] < 0)
            if len(rows):
                values, inverse = np.unique(points[rows, end - 1], return_inverse=True)
                into[rows] = np.logaddexp(into[rows], alpha[end - 1][rows] + self._bytes(values)[inverse])
        return alpha[length]

    def words(self, words: list[str]) -> np.ndarray:
        """``run`` over words with the begin mark, in groups of one length."""
        points = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32) for w in words]
        lengths = np.array([len(p) for p in points])
        out = np.zeros(len(words))
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            length = int(lengths[order[at]])
            rows = order[at : at + max(1, STEP // (length + 1))]
            rows = rows[lengths[rows] == length]
            block = np.empty((len(rows), length + 1), np.int64)
            block[:, 0] = BEGIN
            block[:, 1:] = np.stack([points[r] for r in rows])
            out[rows] = self.run(block)
            at += len(rows)
        return out


def vocabulary_logs(path: str) -> np.ndarray:
    """Log-probabilities of the pieces from the vocabulary's own scores: as they are, if these are logs of probabilities (their
    exponentials add up to about one); scores that are ranks (0, -1, -2, ...) are taken by the harmonic law. Byte pieces share a hundredth."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, of_byte, _, _ = _pieces(path)
    score = np.array([model.get_score(i) for i in range(len(pieces))])
    own = np.array([x is not None for x in pieces])
    p = np.where(own, np.exp(np.minimum(score, 0)), 0.0)
    if not 0.5 < p.sum() < 1.5:
        p = np.where(own, 1 / (3 - np.minimum(score, 0)), 0.0)
    p *= 0.99 / p.sum()
    p[of_byte[of_byte >= 0]] = 0.01 / 256
    with np.errstate(divide="ignore"):
        return np.log(p)


def _lower(text: pa.Scalar) -> list[bytes]:
    return (text.as_buffer().to_pybytes().lower() if text.is_valid else b"").split()


#: A chunk's rows: one for each document (words: places in the chunk's list and how often, as 32-bit integers), one for each word
#: of its list (its place, and its occurrences in the chunk's training documents).
_ROWS = "chunk long, doc_id long, held_out boolean, places binary, times binary, word string, place int, c long"


class _Chunk:
    def __init__(self) -> None:
        self.list: dict[bytes, int] = {}
        self.docs: list[tuple] = []
        self.size, self.print = 0, hashlib.blake2b(digest_size=8)

    def add(self, doc: int | None, held_out: bool, text: pa.Scalar) -> None:
        if text.is_valid:
            self.size += len(text.as_buffer())
            self.print.update(text.as_buffer())
        self.print.update(f"\0{doc}\0".encode())
        found = Counter(_lower(text))
        places = np.fromiter((self.list.setdefault(w, len(self.list)) for w in found), np.int32, len(found))
        self.docs.append((doc, held_out, places, np.fromiter(found.values(), np.int32, len(found))))

    def rows(self) -> pa.RecordBatch:
        n, m = len(self.docs), len(self.list)
        c = np.zeros(m, np.int64)
        for _, held_out, places, times in self.docs:
            if not held_out:
                c[places] += times
        name = int.from_bytes(self.print.digest(), "little", signed=True)
        no = lambda k, t: pa.nulls(k, t)
        columns = [
            pa.array(np.full(n + m, name)),
            pa.concat_arrays([pa.array([d[0] for d in self.docs], pa.int64()), no(m, pa.int64())]),
            pa.concat_arrays([pa.array([d[1] for d in self.docs], pa.bool_()), no(m, pa.bool_())]),
            *(pa.concat_arrays([pa.array([d[k].tobytes() for d in self.docs], pa.binary()), no(m, pa.binary())]) for k in (2, 3)),
            pa.concat_arrays([no(n, pa.string()), pa.array(list(self.list), pa.binary()).cast(pa.string())]),
            pa.concat_arrays([no(n, pa.int32()), pa.array(np.arange(m, dtype=np.int32))]),
            pa.concat_arrays([no(n, pa.int64()), pa.array(c)]),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _ROWS.split(", ")])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = _Chunk()
    for batch in batches:
        for doc, held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            chunk.add(doc, held_out, text)
            if chunk.size >= CHUNK_BYTES:
                yield chunk.rows()
                chunk = _Chunk()
    if chunk.docs:
        yield chunk.rows()


@dataclass(frozen=True)
class Shares:
    """Training tokens n (ends included), distinct words v, ends, and words seen once and twice."""

    n: int
    v: int
    ends: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once else 0.5

    def end(self) -> float:
        """Probability of the end."""
        return (self.ends + 0.5) / (self.n + 1)

    def word(self, c: np.ndarray, log: np.ndarray) -> np.ndarray:
        """log10 probability of words with counts c and lattice logs (natural): the whole word's arc beside the cuts into pieces."""
        pieces = np.log((self.discount * self.v + 0.5) / (self.n + 1)) + log
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(c - self.discount, 0) / (self.n + 1))
        return np.logaddexp(whole, pieces) / np.log(10)

    def bare(self, log: np.ndarray) -> np.ndarray:
        """log10 probability of words by the vocabulary's pieces alone."""
        return (np.log1p(-self.end()) + log) / np.log(10)


def _marginals(path: str, logs: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(path, logs)
        for batch in batches:
            yield batch.assign(log=lattice.words(batch["word"].tolist()))

    return run


def _scores(shares: Shares):
    below = np.log10(shares.n + 0.5 * (shares.v + (shares.ends > 0) + 1))
    end = np.log10(shares.end())

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        at = words.column("place").to_numpy() if words.num_rows else np.zeros(0, int)
        c, log = np.zeros((2, at.max() + 1 if len(at) else 0))
        if len(at):
            c[at], log[at] = words.column("total").to_numpy(), words.column("log").to_numpy()
        values = np.stack([np.ones(len(c)), c > 0, np.log10(c + 0.5) - below, shares.word(c, log), shares.bare(log)])
        ends = np.array([1, shares.ends > 0, np.log10(shares.ends + 0.5) - below, end, end])
        out = np.empty((5, docs.num_rows))
        for i, (places, times) in enumerate(zip(docs.column("places"), docs.column("times"), strict=True)):
            out[:, i] = values[:, np.frombuffer(places.as_buffer(), np.int32)] @ np.frombuffer(times.as_buffer(), np.int32) + ends
        n, known = (pa.array(np.rint(out[k]).astype(np.int64)) for k in (0, 1))
        columns = [docs.column("doc_id"), docs.column("held_out"), n, known, pa.array(np.full(docs.num_rows, shares.n)), *(pa.array(np.ascontiguousarray(out[k])) for k in (2, 3, 4))]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"])

    return run


def score(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score``: one row for each row of ``docs``.

    Documents with crc32(doc_id as text) mod 5 = 1 are held out, the others train. A-Z count as a-z; tokens are the words
    and one end. base_score: sum of log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens, from training counts c, their sum N and
    number V. score: log10 of the text's marginal probability in the lattice, arcs of whole training words included;
    lattice_score: the same over the vocabulary's pieces alone. n_known: tokens with c > 0. ``vocabulary``: path of a sentencepiece model.

    Null text: empty, the end alone. Null doc_id: not held out. Repeated rows count each. Long texts and words are taken whole.
    Other columns are ignored. An empty table gives an empty result.
    """
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)).alias("held_out"), "text")
    chunks = saved(in_batches(rows, _chunks, _ROWS), "chunks")
    listed = chunks.where("word IS NOT NULL").select("chunk", "place", "word", "c")
    words = listed.groupBy("word").agg(F.sum("c").alias("total")).mapInPandas(_marginals(path, vocabulary_logs(path)), "word string, total long, log double")
    words = saved(words, "words")
    total = words.agg(F.sum("total").alias("n"), *(F.count(F.when(F.expr(x), 1)).alias(a) for a, x in (("v", "total > 0"), ("once", "total = 1"), ("twice", "total = 2")))).first()
    texts = chunks.where("word IS NULL")
    ends = texts.where("NOT held_out").count()
    shares = Shares((total["n"] or 0) + ends, total["v"], ends, total["once"], total["twice"])
    found = listed.drop("c").join(words, "word").select("chunk", "place", "total", "log")
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
    return texts.select(F.col("chunk").alias("home"), "doc_id", "held_out", "places", "times").groupBy("home").cogroup(found.groupBy("chunk")).applyInArrow(_scores(shares), kind)
