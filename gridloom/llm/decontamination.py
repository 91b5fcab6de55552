"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

An item's windows are its runs of ``window`` words (an item with fewer words is one window). A window is a set of shingles of ``shingle`` words, and
a document that holds it holds all of them: under one order of shingles, the prefix that containment of 1 makes necessary is the first shingle. The order
is by rarity, counted over all documents, so the join meets as few places as can be; windows with a shingle that no document has are gone before it.
A place where a prefix shingle stands fixes where the window would start (its position in the window) and end (the window's length): starts before the
document and ends behind it are dropped, then the words are compared in full.

Documents are not shuffled: their positions meet the windows by broadcast, in parts of at most ``PART_ROWS`` windows and about ``PART_BYTES``, whatever
the benchmark's size (a pass over the documents for each part); what is grouped is hits alone.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import saved

#: Words of lower-cased text, and the same runs in text as it is: digits, letters and all that is not ASCII, named by what they hold, as Java matches a
#: negated union of ranges six times slower.
WORD, ANY_CASE = r"[0-9a-z\x{80}-\x{10FFFF}]+", r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: What one broadcast holds at most.
PART_ROWS, PART_BYTES = 500_000, 64 << 20


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.translate(text, ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))


def _gram(words: str, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def _windows(items: DataFrame, window: int) -> DataFrame:
    """``text, words, length, items``: each distinct window once, with the ids (strings, sorted) of the items that have it."""
    each = items.select("item", _words("text").alias("words")).where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    each = each.select("item", "length", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("start"))
    each = each.select("item", F.array_join(F.slice("words", F.col("start"), F.col("length")), " ").alias("text"))
    whole = each.groupBy("text").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return whole.select("text", F.split("text", " ").alias("words"), "items").withColumn("length", F.size("words"))


def _parts(rows: DataFrame, bytes_: Column) -> list[DataFrame]:
    """``rows`` in parts that may be broadcast: by their hash, so many that none is likely to exceed the bounds."""
    size = rows.agg(F.count("*").alias("n"), F.sum(bytes_).alias("b")).first()
    parts = max(-(-size["n"] // PART_ROWS), -(-(size["b"] or 0) // PART_BYTES), 1)
    if not size["n"]:
        return []
    return [rows if parts == 1 else rows.where(F.pmod("h", F.lit(parts)) == k) for k in range(parts)]


def _positions(docs: DataFrame, size: int) -> DataFrame:
    """``doc, print, words, at, h``: every place of a shingle of so many words. Exploding indices keeps it in one stage of generated code: a place's columns are
    only built where the join that follows finds it."""
    rows = docs.select("doc", "print", _words("text").alias("words")).where(F.size("words") >= size)
    rows = rows.select("doc", "print", "words", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("at"))
    return rows.withColumn("h", _gram("words", F.col("at"), size))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document: ``id_col``, print long, n_words long, n_hit long, spans array<struct<start, end>>, items array<string>, contaminated boolean.

    ``print`` is the text's hash, which names it together with the id. n_hit: words inside any occurrence of a window; spans: the occurrences (words from
    start, before end), sorted; items: ids of the items they belong to, as strings, sorted. Nulls: a text that is null has no words; items without words have
    no windows; a null item id is not listed, but its windows hit; documents without an id are returned as others are. Repeated rows are each
    returned, texts that share an id are judged by themselves. Texts are read whole, whatever their length; empty tables give no rows, or no hits. Other columns
    are left out, so their names don't matter.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")).withColumn("print", F.xxhash64("text"))
    items = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("text"))
    windows = saved(_windows(items, window), "windows")
    size = F.least("length", F.lit(shingle))
    hits = []
    for s in sorted(r["s"] for r in windows.select(size.alias("s")).distinct().collect()):  # shorter shingles for items with fewer words only
        places = F.transform(F.sequence(F.lit(0), F.col("length") - s), lambda i: _gram("words", i, s))  # noqa: B023 - built at once
        grams = saved(windows.where(size == s).select("text", "length", "items", F.posexplode(places).alias("offset", "h")), "grams")
        counts = [_positions(docs, s).join(F.broadcast(part), "h").groupBy("h").agg(F.count("*").alias("n")) for part in _parts(grams.select("h").distinct(), F.lit(8))]
        if not counts:
            continue
        first = grams.join(_union(counts), "h", "left").groupBy("text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "h")).alias("m"), F.first("length").alias("length"), F.first("items").alias("items"))
        prefix = saved(first.where("m.n > 0").select("m.h", "m.offset", "text", "length", "items"), "prefixes")
        for part in _parts(prefix, F.octet_length("text") + F.coalesce(F.octet_length(F.array_join("items", " ")), F.lit(0)) + 64):
            start = F.col("at") - F.col("offset")
            met = _positions(docs, s).join(F.broadcast(part), "h").where((start >= 0) & (start + F.col("length") <= F.size("words")))
            met = met.where(F.array_join(F.slice("words", start + 1, F.col("length")), " ") == F.col("text"))
            hits.append(met.select("doc", "print", F.struct(start.alias("start"), (start + F.col("length")).alias("end")).alias("span"), "items"))
    rows = docs.select("doc", "print", F.coalesce(F.regexp_count("text", F.lit(ANY_CASE)), F.lit(0)).cast("long").alias("n_words"))
    if not hits:
        found = rows.select("doc", "print", F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items")).where("false")
    else:
        found = _union(hits).groupBy("doc", "print").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    found = found.withColumnsRenamed({"doc": "d", "print": "p"})
    every = rows.join(found, F.col("doc").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")), "left")
    reach = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    more = lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"))
    n_hit = F.coalesce(F.aggregate("spans", reach, more)["n"], F.lit(0)).cast("long")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return every.select(
        F.col("doc").alias(id_col), "print", "n_words", n_hit.alias("n_hit"), F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("spans").isNotNull().alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, most: float = 0.0, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with their columns, whose share of words inside benchmark windows is at most ``most``."""
    bad = contamination(docs, items, id_col=id_col, text_col=text_col, **options).where(F.col("contaminated") & (F.col("n_hit") > most * F.col("n_words")))
    bad = bad.select(F.col(id_col).alias("d"), F.col("print").alias("p")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("print"))
    return rows.join(bad, F.col("doc").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")), "left_anti").select("row.*")
