"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by a key of 32 hexadecimal digits: the text's hash, then the id's, so equal texts stand together.
Exact bytes and rows below candidate boundaries are counted across all partitions, first at all prefixes of three
digits, then, where a splitter is not within tolerance, between the boundaries next to it, three digits further, until
all splitters are. The counts also give every bucket its place, so that one exchange by bucket numbers the rows.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.store import saved

DIGITS, LENGTH = 3, 32


def _bucket(refined: list[dict[str, int]]) -> Column:
    """A row's bucket: its key's first digits, more of them where a round refined."""
    bucket = F.left("key", F.lit(DIGITS))
    for more in refined:
        entries = [F.lit(x) for item in more.items() for x in item]
        bucket = F.left("key", F.coalesce(F.try_element_at(F.create_map(*entries), bucket), F.length(bucket)))
    return bucket


def _splitters(leaves: list[tuple], shards: int) -> list[tuple[int, float]]:
    """For each inner splitter: the leaf whose nearer end it takes (as the number of leaves before the cut) and how many bytes that is off."""
    total = sum(x[1] for x in leaves)
    out, below, i = [], 0, 0
    for k in range(1, shards):
        want = total * k / shards
        while i < len(leaves) and below + leaves[i][1] < want:
            below += leaves[i][1]
            i += 1
        size = leaves[i][1] if i < len(leaves) else 0
        before, after = want - below, below + size - want
        out.append((i, before, i) if before <= after else (i + 1, after, i))
    return out


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


def histogram_shards(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: one row for each row of ``docs``.

    size is the UTF-8 bytes of the text and 8; shards hold nearly equal bytes: each splitter is within ``tolerance`` of a
    shard's share, or one row away. shard counts from 0 in key order, slot from 0 in each shard without gaps. Equal texts
    stand together and share a shard unless a splitter falls into their bytes and no boundary beside them is near enough.

    Null text: size 8, text_crc32 null, one group. Null doc_id: ordered by its hash like any other. Equal rows stand side by side
    in any order. Other columns are ignored. An empty table gives an empty result. Buckets with more than a 64th of the
    rows are refined too, so that a hot text is numbered by many tasks. What the driver holds are the buckets: 4096 and at
    most 4096 for each refined one, however many rows there are.
    """
    key = F.concat(*(F.lpad(F.hex(F.xxhash64(c)), 16, "0") for c in ("text", "doc_id")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), key.alias("key"))
    rows = saved(rows, "keys")
    refined: list[dict[str, int]] = []
    leaves: dict[str, tuple] = {}
    seen = rows
    while True:
        counted = seen.groupBy(_bucket(refined).alias("bucket")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
        leaves |= {r["bucket"]: (r["bucket"], r["bytes"], r["rows"], r["low"], r["high"]) for r in counted.collect()}
        ordered = [leaves[b] for b in sorted(leaves)]
        if not ordered:
            break
        share, count = sum(x[1] for x in ordered) / shards, sum(x[2] for x in ordered)
        far = {ordered[i][0] for _, off, i in _splitters(ordered, shards) if off > tolerance * share and i < len(ordered)}
        far |= {x[0] for x in ordered if 64 * x[2] > count and x[2] > 1000}
        far = {b for b in far if leaves[b][3] != leaves[b][4]}
        if not far:
            break
        refined.append({b: min(LENGTH, _common(leaves[b][3], leaves[b][4]) + DIGITS) for b in far})
        seen = rows.where(_bucket(refined[:-1]).isin(*far))
        for b in far:
            del leaves[b]
    cuts = [x[0] for x in _splitters(ordered, shards)] if ordered else []
    places, shard, slot = [], 0, 0
    for i, x in enumerate(ordered):
        while shard < len(cuts) and i >= cuts[shard]:
            shard, slot = shard + 1, 0
        places.append({"bucket": x[0], "shard": shard, "before": slot})
        slot += x[2]
    table = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(places)), "array<struct<bucket: string, shard: int, before: long>>")))
    table = F.broadcast(table) if len(places) <= 200_000 else table
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("key", "doc_id"))
    placed = rows.withColumn("bucket", _bucket(refined)).join(table, "bucket")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + rank - 1).alias("slot"))
