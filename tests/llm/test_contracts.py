"""Decontamination, hard negatives and whitening against brute force, with nulls, ties, repeats, long texts and clashing names."""

import hashlib
import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontamination, mixing, negatives, packing, queries_c, rlz, whitening

DATA = Path("/root/testdata/sf0.001")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def contaminated(docs, items, window):
    """(n_words, n_hit, item ids) of each document."""
    want = []
    for _, text in docs:
        w, hit, found = words(text), set(), set()
        for item, other in items:
            v = words(other)
            m = min(window, len(v))
            for run in {tuple(v[p : p + m]) for p in range(len(v) - m + 1)} if m else ():
                for p in range(len(w) - m + 1):
                    if tuple(w[p : p + m]) == run:
                        hit |= set(range(p, p + m))
                        found.add(item)
        want.append((len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return want


def some_texts():
    rng = np.random.Generator(np.random.PCG64(11))
    make = lambda n: " ".join(rng.choice(["a", "b", "cé", "Д1"], n))  # noqa: E731 - few words, so that windows meet by chance
    far = lambda n: " ".join(rng.choice([f"w{k}" for k in range(400)], n))
    passage = far(30)
    items = [(1, passage), (20, f"{far(12)} {passage[:60]}"), (3, make(14)), (4, "A b"), (5, None), (6, " .,;"), (None, far(15)), (7, passage), (8, "a " * 25), (9, "x y z q w e r t")]
    docs = [far(40), f"{far(10)}. {passage.upper()}! {far(5)}", passage, "A, B", None, "", "...", make(60), make(300), "a " * 400, f"{far(2000)} {passage} {far(2000)} {passage}", "x\ty\nz q-w e'r t", passage.replace(" ", " "), items[6][1]]
    return [(k, t) for k, t in enumerate(docs)], items


@pytest.mark.parametrize("window,shingle", [(10, 5), (10, 3), (4, 5), (1, 1)])
def test_windows_of_items_in_documents(spark, window, shingle, monkeypatch):
    docs, items = some_texts()
    monkeypatch.setattr(decontamination, "PART_ROWS", 7)  # several broadcasts
    tables = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contamination(*tables, window, shingle).collect()}
    assert len(got) == len(docs)
    for (k, _), (n, hit, found) in zip(docs, contaminated(docs, items, window), strict=True):
        r = got[k]
        assert (r.n_words, r.n_hit, list(r.items), r.contaminated) == (n, hit, found, hit > 0), k
        assert len({p for s in r.spans for p in range(s.start, s.end)}) == hit and list(r.spans) == sorted(r.spans)


def test_contamination_of_odd_tables(spark):
    docs, items = some_texts()
    schema = DOCUMENTS + ", words long, items string, h string, `a.b` long"
    rows = [(None, items[0][1], None, None, None, 1, "x", None, 1), (None, None, None, None, None, None, None, None, None), *[(3, items[0][1], "en", "s", 1, 2, "y", "", 1)] * 3, (3, "other", "en", "s", 1, 2, "y", "", 1)]
    odd, bench = spark.createDataFrame(rows, schema), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id is None, r.n_words, r.n_hit) for r in decontamination.contamination(odd, bench).collect())
    assert got == [(False, 1, 0), (False, 30, 30), (False, 30, 30), (False, 30, 30), (True, 0, 0), (True, 30, 30)]
    kept = decontamination.decontaminated(odd, bench)
    assert kept.columns == odd.columns and sorted(str(r.text) for r in kept.collect()) == ["None", "other"]
    assert decontamination.decontaminated(odd, bench, most=1.0).count() == 6
    assert decontamination.contamination(odd.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontamination.contamination(odd, bench.limit(0)).collect()} == {0}


def mined(rows, anchors, positives, most, low):
    """rows: (id, label, x), distinct ids."""
    out = []
    for a, label, x in rows:
        if a not in anchors:
            continue
        scored = sorted((-sum(u * v for u, v in zip(x, y, strict=True)), i, other) for i, other, y in rows if i != a and len(y) == len(x))
        for s, i, _ in [t for t in scored if t[2] == label][:positives]:
            found = [t for t in scored if t[2] != label and low[0] * -s <= low[1] * -t[0] <= low[1] * -s]
            out += [(a, i, k + 1, t[1], -s, -t[0]) for k, t in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("size,values", [(3, 3), (5, 300), (2, 1 << 27)])
def test_hard_negatives(spark, monkeypatch, size, values):
    rng = np.random.Generator(np.random.PCG64(size))
    rows = [(int(i), int(rng.integers(0, 3)), [int(v) for v in rng.integers(-values // 4, values, size)]) for i in rng.permutation(300)]
    rows += [(1000 + i, 0, [1] * size) for i in range(60)] + [(2000 + i, 1, [2] * (size + 1)) for i in range(5)]  # a group of copies; another length
    monkeypatch.setattr(negatives, "ROWS", 50)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "SLICE", 3)
    table = spark.createDataFrame(rows, "id long, label int, x array<long>").repartition(3)
    anchors = {i for i, _, _ in rows if i % 20 == 0}
    got = negatives.hard_negatives(table, table.where("id % 20 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, anchors, 5, 5, (80, 100))
    wide = negatives.hard_negatives(table, table.where("id % 20 = 0"), positives=2, negatives=9, low=(1, 3))
    assert sorted(tuple(r) for r in wide.collect()) == mined(rows, anchors, 2, 9, (1, 3))


def test_hard_negatives_of_odd_tables(spark):
    good = [(0, 1, [3, 4]), (1, 1, [3, 3]), (2, 2, [3, 3]), (3, 2, [2, 3]), (5, 2, [])]
    rows = [(*r, 0, "x") for r in good] + [(2, 2, [3, 3], 1, "y"), (None, 1, [9, 9], 1, ""), (6, None, [9, 9], 1, ""), (7, 1, None, 1, ""), (8, 1, [9, None], 1, ""), (9, 1, [1 << 40, 1], 1, "")]
    table = spark.createDataFrame(rows, "id long, label int, x array<long>, score long, anchor_id string")
    got = negatives.hard_negatives(table, spark.createDataFrame([(0,), (0,), (6,), (None,), (77,)], "id long"))
    assert sorted(tuple(r) for r in got.collect()) == mined(good, {0}, 5, 5, (80, 100)) == [(0, 1, 1, 2, 21, 21), (0, 1, 2, 3, 21, 18)]
    assert negatives.hard_negatives(table.limit(0), table).count() == 0
    assert negatives.hard_negatives(table, table.limit(0)).count() == 0


def test_scatter_is_exact():
    rng = np.random.Generator(np.random.PCG64(2))
    for least, most, n, d in ((-3, 4, 130, 3), (10**6 - 70, 10**6 + 70, 9000, 5), (-(1 << 44), 1 << 44, 70, 2), (7, 8, 1, 1), (5, 6, 65, 4)):
        x = rng.integers(least, most, (n, d))
        total, sums, cross = whitening.scatter(x)
        big = x.astype(object)
        assert total == n and sums == list(big.sum(axis=0)) and (cross == big.T @ big).all()


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "SLICE", 100)
    rng = np.random.Generator(np.random.PCG64(4))
    x = np.floor(rng.normal(size=(400, 5)) @ np.diag([1, 5, 9, 40, 200.0]) @ rng.normal(size=(5, 5))).astype(np.int64) + 10**6
    x[200:300] = x[7]  # a group of copies
    rows = [(int(i), [int(v) for v in r]) for i, r in enumerate(x)]
    table = spark.createDataFrame([*rows, (None, rows[0][1]), (900, None), (901, [1, None]), (902, [1 << 60]), (903, [])], "id long, x array<long>").repartition(3)
    got = whitening.whiten(table, 3).collect()
    assert sorted(str(r.id) for r in got) == sorted([*(str(i) for i in range(400)), "None", "903"])
    once = np.unique(x, axis=0)
    centred = once - once.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(once))
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = None
    for r in sorted((r for r in got if r.id is not None and r.id < 400), key=lambda r: r.id):
        want = (x[r.id] - once.mean(axis=0)) @ vectors[:, :3] / np.sqrt(values[:3])
        signs = np.sign(want * r.whitened) if signs is None else signs
        assert np.allclose(r.whitened, signs * want, atol=1e-9) and np.allclose(r.explained, values[:3] / values.sum(), rtol=1e-9)
        n, s = len(once), [int(v) for v in once.sum(axis=0)]
        assert r.n == n and int(r.deviation) == sum((n * int(v) - t) ** 2 for v, t in zip(x[r.id], s, strict=True)) and r.identity_error < 1e-9
    assert [list(r.whitened) for r in got if r.id == 903] == [[]]


def test_whitening_without_spread(spark):
    same = spark.createDataFrame([(1, [5, 5]), (2, [5, 5])], "id long, x array<long>")
    assert [(r.n, int(r.deviation), list(r.whitened), r.identity_error) for r in whitening.whiten(same).collect()] == [(1, 0, [], 0.0)] * 2
    line = spark.createDataFrame([(1, [0, 0]), (2, [2, 2])], "id long, x array<long>")
    assert [len(r.whitened) for r in whitening.whiten(line).collect()] == [1, 1]
    assert whitening.whiten(same.limit(0)).count() == 0
    f = whitening.Fit(10**9, [3], np.ones(1), np.ones((1, 1)), 1.0)
    assert whitening._deviations(np.array([[1 << 40]]), f) == [(10**9 * (1 << 40) - 3) ** 2]


def rows_of(df):
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries_c.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = queries_c.QUERIES[name](spark, str(DATA)).toPandas(), con.sql(queries_c.ORACLES[name]).df()
    assert rows_of(got) == rows_of(want) and len(got)


def test_whitening_query(spark):
    out = queries_c.QUERIES["op13_bit_sliced_whitening"](spark, str(DATA)).toPandas()
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = np.array([[math.floor(64 * v) for v in r[1]] for r in rows]) + 10**6
    once = np.unique(x, axis=0)
    n, s = len(once), once.sum(axis=0)
    values = np.linalg.eigvalsh((once - s / n).T @ (once - s / n) / n)[::-1]
    assert len(out) == 16 * len(rows) and set(out.n) == {n} and out.identity_error.max() < 1e-6
    first = out[out.component == 1].set_index("vec_id")
    assert [int(v) for v in first.deviation.loc[[r[0] for r in rows]]] == [int(((n * row - s) ** 2).sum()) for row in x]
    assert np.allclose(out.groupby("component").explained.first(), values[:16] / values.sum(), rtol=1e-9)
    white = out[~out.vec_id.isin([])].pivot(index="vec_id", columns="component", values="whitened").loc[[r[0] for r in rows]].to_numpy()
    _, first_of = np.unique(x, axis=0, return_index=True)
    assert np.allclose(white[first_of].T @ white[first_of] / n, np.eye(16), atol=1e-6)


def test_items_digest(spark):
    r = queries_c.QUERIES["op11_prefix_decontamination"](spark, str(DATA)).where("n_items = 0").first()
    assert r.items_sha256 == hashlib.sha256(b"").hexdigest() and not r.contaminated


def test_large_documents_do_not_decide_a_mix(spark):
    rng = np.random.Generator(np.random.PCG64(8))
    sizes = [5184, *(int(n) for n in rng.integers(4, 740, 49)), *(int(n) for n in rng.integers(4, 740, 50))]
    docs = spark.createDataFrame([(i, "w " * n, "ab"[i >= 50]) for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    for seed in range(3):
        out = mixing.mix(docs, seed=seed).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
        assert len(out) == 2 and all(abs(r.taken - r.target) <= 0.01 * r.target for r in out)


def test_large_documents_keep_their_odds():
    chunk = pd.DataFrame({"doc_id": range(30), "print": range(30), "rank": 1, "size": [900, 300, *range(60, 88)], "chunk": 0, "p": [0.4, 0.7, *[0.55] * 28]})
    runs = [mixing._meet(seed, False)(chunk).sort_values("doc_id")["p"].to_numpy() for seed in range(2000)]
    assert np.abs(np.mean(runs, axis=0) - chunk["p"].to_numpy()).max() < 0.05 and all(((r > 0) & (r < 1)).sum() <= 1 for r in runs)
    assert all((r * chunk["size"]).sum() == pytest.approx((chunk["p"] * chunk["size"]).sum()) for r in runs)
    assert all(r[0] in (0, 1) and r[1] in (0, 1) for r in runs)


def test_named_tokens_and_repeated_rows_in_packing(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BLOCK", 20)
    named = "<|endoftext|>"
    texts = ["end", f"a{named}b", named, f"{named}{named} x\n{named}", "<|endof", "text|>", f"not <|endoftext |> {named[:-1]}", *["same text"] * 200]
    docs = spark.createDataFrame([(min(i, 7), t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    out = packing.pack(docs, window=64).toPandas()
    assert len(out) == len(texts)
    for i, t in enumerate(texts[:7]):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        r = out[out.doc_id == i].iloc[0]
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    again = packing.pack(docs.repartition(5), window=64).toPandas()
    order = ["sequence_id", "offset"]
    assert out.sort_values(order).values.tolist() == again.sort_values(order).values.tolist()
    assert (out[out.doc_id == 7].sequence_id // 2**32).nunique() > 3  # repeated rows are dealt to many blocks


def test_repeated_rows_bring_each_anchor_once(spark):
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(5, text)] * 40 + [(1, text[: len(text) // 2]), (9, text)], "doc_id long, text string")
    whole = len(text[: len(text) // 2].rpartition(" ")[0].split()) + (text[len(text) // 2] == " ")  # a word that is cut is another word
    parsed = rlz.substring_dedup(docs, window=50, texts=False).collect()
    assert len(parsed) == 42 and {r.n_removed for r in parsed if r.doc_id == 5} == {whole}
    assert {r.n_removed for r in parsed if r.doc_id == 9} == {200}
