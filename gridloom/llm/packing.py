"""Packing token sequences by minimum bin slack.

Every document becomes token ids with an end id, cut into whole windows and one rest. Whole windows are sequences of
their own. Rests are dealt by a hash into blocks of about ``BLOCK`` pieces, and each block fills windows one by one:
the longest rest left opens a window, and a subset-sum dynamic programme over the multiset of the other lengths, kept
as a bitset per item tried, finds the fill nearest to the capacity; walking the bitsets back gives the items used.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import in_batches, saved
from gridloom.llm.words import _BYTES, BASES, U, pieces, run_hashes

#: Pieces in a block: its last window is the only one that can lack items to fill it.
BLOCK = 8192
#: Bytes of text that are encoded in one step, parts of texts that go to the tokenizer at once, and bytes that known parts may take in a worker.
PART_BYTES, BATCH, ROOM = 1 << 20, 4096, 16 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_set(*members: int | range) -> np.ndarray:
    out = np.zeros(256, bool)
    for m in members:
        out[m if isinstance(m, int) else list(m)] = True
    return out


#: First bytes of characters that are not white space whatever follows: ASCII from "!", and all but four of the longer ones' leads.
_SOLID_LEAD = _byte_set(range(0x21, 0x7F), range(0xC3, 0xE1), range(0xE4, 0xF5))
_ASCII_SOLID = _byte_set(range(0x21, 0x7F))
_LETTER = _byte_set(range(0x41, 0x5B), range(0x61, 0x7B))
#: Signs that are neither letters, digits nor apostrophes.
_SIGN = _byte_set(*b'!"#$%&()*+,-./:;<=>?@[]^_`{|}~')


def part_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes where texts (UTF-8, at ``offsets`` in ``data``) may be cut without changing their pre-tokens: at their starts, before a single
    space or around a single line feed between characters that surely are not white space, and between a letter and a sign."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 2:
        # After which byte a solid character has ended: ASCII, or the second byte of two with a lead from C3 on.
        solid_end = _ASCII_SOLID[data]
        letter_end = _LETTER[data].copy()
        two = (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        solid_end[1:] |= two
        letter_end[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        between = np.zeros(n, bool)
        between[1:-1] = solid_end[:-2] & _SOLID_LEAD[data[2:]]
        line = between & (data == 10)
        cut |= (between & (data == 32)) | line
        cut[1:] |= line[:-1] | (letter_end[:-1] & _SIGN[data[1:]])
        inner = offsets[(offsets > 0) & (offsets < n)]
        # Neighbours in other texts don't count: what they decided is undone, then each text's start is a cut.
        cut[inner] = cut[inner - 1] = False
        cut[np.minimum(inner + 1, n - 1)] &= ~np.isin(np.minimum(inner + 1, n - 1), inner) & ~line[inner]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts, each distinct part (see ``part_starts``) being encoded once while it stays in memory. Parts are known by a 64-bit hash and their length."""

    def __init__(self, path: str, room: int = ROOM):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        named = sorted((t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.named = re.compile(b"|".join(map(re.escape, named))) if named else None
        self.room = room
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids: np.ndarray = np.zeros(0, "<u4")

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """``part_starts``, with tokens that the vocabulary names apart (``<|endoftext|>``) as parts of their own: the tokenizer takes them out of a text first."""
        starts, raw = part_starts(data, offsets), data.tobytes()
        if self.named is None or not self.named.search(raw):
            return starts
        cut = np.zeros(len(data) + 1, bool)
        cut[starts] = True
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            for found in self.named.finditer(raw, a, b):
                cut[found.start() : found.end()] = False
                cut[[found.start(), found.end()]] = True
        return np.flatnonzero(cut[:-1])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each text's first place among them, with the end)."""
        starts = self._starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = run_hashes(_BYTES[data], starts, ends, BASES[0])
        if sum(x.nbytes for x in (self.keys, self.at, self.size, self.ids)) > self.room:
            self._forget()
        part, distinct = pd.factorize(hashes)
        where = np.empty(len(distinct), np.int64)
        where[part[::-1]] = np.arange(len(part))[::-1]
        row = np.searchsorted(self.keys, distinct)
        known = np.append(self.keys, U(0))[row] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        fresh, where = distinct[~known], where[~known]
        if len(fresh):
            raw = data.tobytes()
            spans, sizes, ids = list(zip(starts[where].tolist(), ends[where].tolist(), strict=True)), [], [self.ids]
            for i in range(0, len(spans), BATCH):  # what the tokenizer says of a part takes far more room than its ids
                found = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in spans[i : i + BATCH]], add_special_tokens=False)]
                sizes.extend(map(len, found))
                ids.append(np.fromiter(chain.from_iterable(found), "<u4"))
            size = np.array(sizes, np.int64)
            at = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate(ids)
            order = np.argsort(np.concatenate((self.keys, fresh)), kind="stable")
            self.keys, self.at, self.size = (np.concatenate(x)[order] for x in ((self.keys, fresh), (self.at, at), (self.size, size)))
        row = np.searchsorted(self.keys, distinct)[part]
        size = self.size[row]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(self.at[row] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]


def _encoder(path: str) -> Encoder:
    """The worker process's encoder for ``path``, kept for its next tasks: functions come with each task, modules stay."""
    kept = sys.modules.setdefault("_gridloom_encoders", ModuleType("_gridloom_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _cut(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = _encoder(path), np.array([end_id], "<u4")
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, w in pieces(batch.column(1), PART_BYTES):
                ids, first = encoder.encode(w.data, w.offsets)
                out: list[list] = [[], [], [], [], [], []]
                for i in range(hi - lo):
                    b = memoryview(np.concatenate((ids[first[i] : first[i + 1]], end)).tobytes())
                    n = len(b) // 4
                    whole = zlib.crc32(b)
                    for start in range(0, n, window):
                        length = min(window, n - start)
                        for to, x in zip(out, (keys[lo + i], start, length, zlib.crc32(b[4 * start : 4 * (start + length)]), n, whole), strict=True):
                            to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "text_crc32"])

    return run


def least_slack(lengths: np.ndarray, window: int) -> list[list[int]]:
    """Indices of ``lengths`` (each 1 to ``window``) grouped into windows: repeatedly the longest left, with those others whose sum comes nearest to the rest of the window."""
    left: dict[int, list[int]] = defaultdict(list)
    for i in np.argsort(-lengths, kind="stable")[::-1]:
        left[int(lengths[i])].append(int(i))
    sizes = sorted(left, reverse=True)
    bins = []
    while sizes:
        first = sizes[0]
        opened = [left[first].pop()]
        room = window - first
        reach, steps, full = 1, [], (1 << (room + 1)) - 1
        for size in sizes:
            if size > room or reach >> room:
                continue
            for _ in range(min(len(left[size]), room // size)):
                more = (reach | reach << size) & full
                if more == reach:
                    break
                steps.append((size, reach))
                reach = more
                if reach >> room:
                    break
        at = reach.bit_length() - 1
        for size, before in reversed(steps):
            if not before >> at & 1:
                opened.append(left[size].pop())
                at -= size
        sizes = [s for s in sizes if left[s]] if any(not left[int(lengths[i])] for i in opened) else sizes
        bins.append(opened)
    return bins


def _fill(window: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["doc_id", "start", "length", "ids_crc32", "text_crc32"], na_position="first", kind="stable").reset_index(drop=True)
        lengths = block["length"].to_numpy()
        whole = np.flatnonzero(lengths == window)
        rest = np.flatnonzero(lengths < window)
        sequence, offset = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
        sequence[whole] = np.arange(len(whole))
        for k, members in enumerate(least_slack(lengths[rest], window), start=len(whole)):
            rows = rest[members]
            sequence[rows] = k
            offset[rows] = np.cumsum(lengths[rows]) - lengths[rows]
        block["sequence_id"] = block["block"] * 2**32 + sequence
        block["offset"] = offset
        return block[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (long): one row for each piece of each row of ``docs``.

    A row's ids are its text's ids and ``end_id``; start counts the row's ids before the piece, ids_crc32 is the CRC-32 of
    the piece's ids as little-endian unsigned 32-bit numbers, doc_tokens counts all ids of the row. A sequence holds
    pieces at offsets 0 onward without gaps, ``window`` ids at most. sequence_id is the block's number times 2**32 plus a
    number in the block: unique, not dense. ``tokenizer``: path of a tokenizers file.

    Tokens that the vocabulary names apart are one id where a text holds their name. Null or empty text: the end id alone. Null doc_id: packed like others. Repeated rows are packed each. Long texts become
    whole windows and a rest. Other columns are ignored. An empty table gives an empty result. Results depend on the rows
    alone, not on their order or partitions.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "text_crc32"]
    cut = saved(in_batches(docs, _cut(tokenizer or default_tokenizer(), window, end_id), ", ".join(f"{n} long" for n in names)), "pieces")
    blocks = max(1, -(-cut.count() // BLOCK))
    each = cut.groupBy(*names).agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))  # repeated rows go to blocks of their own
    dealt = each.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "start", "copy"), F.lit(blocks))).select(*names, "block")
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("block").applyInPandas(_fill(window), kind)
