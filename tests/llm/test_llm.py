"""The text operators against brute force on small tables, with nulls, ties, repeats, long texts and clashing names."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import lattice, mixing, packing, pq, quality, rlz, setsketch, sharding, tools, toxicity
from gridloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def some_documents():
    rng = np.random.Generator(np.random.PCG64(5))
    vocabulary = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 6))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = make(70)
    texts = [make(int(n)) for n in rng.integers(1, 160, 40)]
    texts += [f"{make(20)} {passage}\n{make(30)}" for _ in range(6)]
    base = make(200)
    for k in range(5):
        w = base.split(" ")
        w[10 * k] = "changed"
        texts.append(" ".join(w))
    texts += [base, base, base.upper(), None, "", "   \n\t", "one", "one two", make(3000), "Same Line\n" * 30, passage, passage[: len(passage) // 2]]
    return [(i, t, "en", ["a", "b", None, "ü"][i % 4], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return some_documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, repeated rows, and columns named like the operators' own."""
    rows = [(None, "a b c d e f", None, None, None, 1, "x"), (None, None, None, None, None, None, None), (3, "a b c d e f", "en", "s", 1, 2, "y"), (3, "a b c d e f", "en", "s", 1, 2, "y"), (3, "other words", "en", "s", 1, 2, "y"), (1, "a b c d e f", "en", "t", 0, 0, "")]
    return spark.createDataFrame(rows, DOCUMENTS + ", size long, print string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (9, 9), (None, 1), (10, 11), (11, 12), (12, 13), (13, 10), (3, 14)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 14: 1, 4: 4, 5: 4, 10: 10, 11: 10, 12: 10, 13: 10}


# 1. Quality rules.


def test_quality_measures(spark, rows, docs):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        w, t = words(text), text or ""
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        covered = {k for j in range(len(w) - 7) if c[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        m = got[i].measures
        assert (m.n_words, m.word_chars, m.n_dup_lines, m.n_repeat_words) == (len(w), sum(map(len, w)), dup, len(covered)), i


def test_label_model_finds_junk():
    rng = np.random.Generator(np.random.PCG64(2))
    junk = rng.random(4000) < 0.15
    kind = rng.integers(0, 3, 4000)
    votes = np.where(rng.random((4000, 4)) < 0.1, 2, 1)
    for k in range(3):
        votes[junk & (kind == k), k] = 0
    votes[rng.random(4000) < 0.002, 3] = 0
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality.fit(patterns, counts.astype(float))
    like = np.array([[s * np.prod([r if v == 0 else 1 - r if v == 1 else 1 for v, r in zip(p, rates, strict=True)]) for s, rates in zip(model.shares, model.rates, strict=True)] for p in patterns])
    q = (like[:, 0] / like.sum(axis=1))[inverse.ravel()]
    assert (q[junk] < 0.5).mean() > 0.99 and (q[~junk] >= 0.5).mean() > 0.99


def test_quality_posterior_is_the_models(spark, docs):
    voted = quality.votes(quality.measured(docs.select("doc_id", "text"), "text", ("doc_id",)))
    model = quality.learn(voted)
    for r in voted.withColumn("q", model.posterior(F.col("votes"))).collect():
        like = [s * math.prod(p if v == 0 else 1 - p if v == 1 else 1 for v, p in zip(r.votes, rates, strict=True)) for s, rates in zip(model.shares, model.rates, strict=True)]
        assert r.q == pytest.approx(like[0] / sum(like), rel=1e-6, abs=1e-9)


def test_quality_edges(odd, empty):
    assert quality.quality(odd).count() == 6 and quality.quality(empty).count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and quality.keep_good(empty).count() == 0


# 2. Substring dedup.


def brute_substring(rows, window):
    first = {}
    for i, text, *_ in rows:
        w = words(text)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, text, *_ in rows:
        w = words(text)
        gone = {k for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < i for k in range(j, j + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [50, 8, 7])
def test_substring_dedup(docs, rows, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rlz.substring_dedup(docs, window).collect()}
    assert got == brute_substring(rows, window)
    assert sum(v[1] for v in got.values()) > 300


def test_substring_edges(odd, empty):
    got = rlz.substring_dedup(odd, 4)
    assert got.count() == 6 and rlz.substring_dedup(empty).count() == 0
    assert {(r.doc_id, r.n_removed) for r in got.collect()} == {(None, 0), (3, 6), (3, 0), (1, 0)}
    left = rlz.without_duplicates(odd, 4)
    assert left.columns == odd.columns and left.count() == 4


# 3. Sharding.


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_histogram_shards(docs, rows, shards):
    got = sharding.histogram_shards(docs, shards).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    text = {i: t for i, t, *_ in rows}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 8 and r.text_crc32 == (None if text[r.doc_id] is None else zlib.crc32(text[r.doc_id].encode())) for r in got)
    assert max(sizes.values()) - sum(sizes.values()) / shards <= max(r.size for r in got)


def test_hot_text_is_split(spark, empty, odd):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    sizes = sharding.histogram_shards(hot, 24).groupBy("shard").count().collect()
    assert len(sizes) == 24 and max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 4
    assert sharding.histogram_shards(empty).count() == 0 and sharding.histogram_shards(odd, 2).count() == 6


# 4. Mixing.


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, target = 1.5 * sum(sizes.values()), {}
    open_ = set(order)
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = {s for s in open_ if unit * w[s] > 2 * sizes[s]}
        if not full:
            return target | {s: unit * w[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
        left, open_ = left - sum(target[s] for s in full), open_ - full
    return target


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    want = brute_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}


def test_rounding_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 20)
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    out = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 40 for r in out)


def test_rounding_is_unbiased():
    import pandas as pd

    chunk = pd.DataFrame({"doc_id": range(9), "print": range(9), "rank": 1, "size": [5, 40, 1, 7, 7, 13, 2, 90, 30], "chunk": 0, "p": [0.5, 0.2, 0.9, 0.35, 0.35, 0.6, 0.1, 0.75, 0.5]})
    runs = [mixing._meet(seed, False)(chunk).sort_values("doc_id") for seed in range(1500)]
    mean, want = np.mean([r["p"].to_numpy() for r in runs], axis=0), chunk["p"].to_numpy()
    assert np.abs(mean - want).max() < 0.05 and all(((r["p"] > 0) & (r["p"] < 1)).sum() <= 1 for r in runs)
    assert all((r["p"] * r["size"]).sum() == pytest.approx((chunk["p"] * chunk["size"]).sum()) for r in runs)


def test_mixing_edges(odd, empty):
    assert mixing.mix(empty).count() == 0
    got = mixing.mix(odd).collect()
    assert sum(r.n_rows for r in got) == 6 and len(got) == 5


# 5. Embedding near-dedup.


def test_near_vectors(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    centres = rng.normal(size=(40, 16))
    x = [c + rng.normal(size=16) * s for c in centres for s in (0, 0.1, 0.2, 0.3, 0.3)]
    data = [(i, [float(c) for c in v], int(i % 3) if i % 2 else 0) for i, v in enumerate(x)]
    data += [(900 + k, data[5][1], data[5][2]) for k in range(3)]
    data += [(990, None, 1), (991, [0.0] * 16, 1), (992, [float("nan")] * 16, 1), (993, [None] * 16, 1), (994, data[0][1], None), (995, [1.0, 2.0], 1), (996, [1e-200] * 16, 0), (997, [1e200] * 16, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in pq.near_vectors(df).collect()}
    fine = {i: (np.array(v), lab) for i, v, lab in data if v and lab is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, (v, _) in fine.items()}
    links = {i: {j for j in fine if j != i and fine[i][1] == fine[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93} for i in fine}
    low = {i: i for i in got}
    for _ in range(len(got)):
        low |= {i: min([low[i], *(low[j] for j in links.get(i, ()))]) for i in low}
    assert sum(map(len, links.values())) > 50
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (len(links.get(i, ())), low[i], low[i] == i), i
    assert pq.near_vectors(df.limit(0)).count() == 0


# 6. Tool calls.


def test_tool_calls(spark):
    schema = {"add": (tools.Argument("b", "integer", most=9), tools.Argument("a", "number", required=False), tools.Argument("note", "string", required=False, most=3))}
    calls = spark.createDataFrame(
        [
            (1, 0, "x", "add", {"b": "3", "a": "1.5"}, None), (1, 1, "y", "add", {"b": "12", "note": 'é"'}, "x"), (1, 2, "z", "add", {"note": "long"}, "y"), (1, 2, "z", "add", {"note": "long"}, "x"),
            (1, 3, "y", "add", {"b": "1"}, None), (2, 0, None, "add", None, None), (2, 1, "c1", "nope", {}, "c2"), (2, 2, "c2", None, {}, "c1"), (3, 0, "w", "add", {"b": "x"}, "gone"),
        ],
        "conv_id long, turn long, call_id string, name string, arguments map<string,string>, depends_on string",
    )
    results = spark.createDataFrame([(1, 5, "x", "4.5"), (1, 6, "x", "late"), (1, 7, "q", "stray"), (1, 8, None, None), (1, 9, "y", None)], "conv_id long, turn long, call_id string, content string")
    got = tools.link_calls(calls, results, schema).collect()
    by = {(r.call_id, r.turn): r for r in got}
    assert [by["x", 0].level, by["y", 1].level, by["z", 2].level, by["w", 0].level, by["c1", 1].level] == [0, 1, 2, 0, None]
    assert by["x", 0].json == '{"arguments":{"a":1.5,"b":3},"id":"x","name":"add","result":"4.5"}' and by["x", 0].problems == ""
    assert by["y", 1].problems == "b: too large" and by["y", 3].status == "duplicate" and by["z", 2].problems == "b: missing; note: too large"
    assert by["w", 0].problems == "b: not of type integer" and by["w", 0].status == "unanswered" and by["c1", 1].problems == "unknown tool"
    assert by["q", 7].status == "orphan" and by[None, 8].status == "orphan"
    assert json.loads(by["y", 1].json)["arguments"]["note"] == 'é"'
    assert json.loads(by["w", 0].json)["arguments"] == {"b": "x"} and all(json.loads(r.json) is not None for r in got)
    assert by["x", 6].status == "extra" and json.loads(by["x", 6].json) == {"id": "x", "result": "late"}
    assert tools.link_calls(calls.limit(0), results.limit(0), schema).count() == 0


def test_tool_arguments_in_one_form(spark):
    schema = {"t": tuple(tools.Argument(k, k, required=False) for k in ("integer", "number", "boolean"))}
    given = [{"integer": "-0"}, {"integer": "01"}, {"number": "1e0"}, {"number": "1.0"}, {"number": "1e999"}, {"number": "2.50"}, {"boolean": "True"}, {"boolean": "true", "b": "x", "a": "\n"}, {"number": None}, {"integer": "123456789012345678901234567890"}]
    calls = spark.createDataFrame([(0, i, str(i), "t", g, None) for i, g in enumerate(given)] + [(0, 99, "99", "what", {"q": "1", "": "2"}, None)], "conv_id long, turn long, call_id string, name string, arguments map<string,string>, depends_on string")
    got = {r.turn: r for r in tools.link_calls(calls, calls.select("conv_id", "turn", "call_id", F.col("name").alias("content")).limit(0), schema).collect()}
    body = lambda k: got[k].json.partition('"arguments":')[2].partition(',"id"')[0]
    assert [body(k) for k in range(10)] == ['{"integer":0}', '{"integer":"01"}', '{"number":1}', '{"number":1}', '{"number":"1e999"}', '{"number":2.5}', '{"boolean":"True"}', '{"a":"\\n","b":"x","boolean":true}', "{}", '{"integer":123456789012345678901234567890}']
    assert got[1].problems == "integer: not of type integer" and got[4].problems == "number: not of type number" and got[7].problems == "a: not in the schema; b: not in the schema"
    assert body(99) == '{"":"2","q":"1"}' and got[99].problems == "unknown tool" and all(json.loads(r.json) for r in got.values())


# 7. Toxicity.


def test_chain_learns(spark):
    rng = np.random.Generator(np.random.PCG64(8))
    bad = ["vile", "awful", "nasty"]
    data, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = list(rng.choice([f"w{k}x" for k in range(400)], 40))
        if toxic:
            w[3:5] = rng.choice(bad, 2)
        if i % 7 == 0:
            w += ["spam"] * 3
        data.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, int(i % 7 == 0), int(toxic)))
    docs = spark.createDataFrame(data + [(None, None), (7000, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (1, None, None)], "doc_id long, low_quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lab).collect()}
    right = [got[i].toxic == (i % 5 == 0) for i in range(400, 600)]
    assert np.mean(right) > 0.97 and not got[7000].toxic and len(got) == 602
    assert np.mean([(got[i].p_low_quality >= 0.5) == (i % 7 == 0) for i in range(400, 600)]) > 0.97
    none = toxicity.toxicity(docs, lab.limit(0))
    assert none.count() == 602 and toxicity.toxicity(docs.limit(0), lab).count() == 0


def test_chain_uses_words_that_few_labelled_documents_have(spark):
    """600 toxic words, each in about four labelled documents: none is far off by itself, so none gets a weight of its own."""
    rng = np.random.Generator(np.random.PCG64(9))
    pool, plain = [f"bad{k}" for k in range(600)], [f"w{k}" for k in range(400)]
    letters = str.maketrans("0123456789", "abcdefghij")
    data, labels = [], []
    for i in range(1200):
        words = [*rng.choice(plain, 30), *(rng.choice(pool, 12) if i % 5 == 0 else [])]
        data.append((i, " ".join(words).translate(letters)))
        if i < 1000:
            labels.append((i, 0, int(i % 5 == 0)))
    docs, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, low_quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(docs, lab).collect()}
    assert np.mean([got[i] for i in range(1000, 1200, 5)]) > 0.9
    assert np.mean([got[i] for i in range(1000, 1200) if i % 5]) < 0.05


def test_chain_feeds_earlier_probabilities():
    rng = np.random.Generator(np.random.PCG64(1))
    x = (rng.random((500, 3)) < 0.4).astype(float)
    first = (rng.random(500) < np.where(x[:, 0] > 0, 0.95, 0.05)).astype(float)
    chain = toxicity.fit(x, np.stack([first, first], axis=1), ("one", "two"), np.arange(3, dtype=np.int32))
    assert len(chain.weights[0]) == 4 and len(chain.weights[1]) == 5 and chain.weights[1][3] > 0


# 8. Lattice.


def test_lattice_sums_all_segmentations():
    path = lattice.default_vocabulary()
    model = lattice.Lattice(path, lattice.vocabulary_logs(path))
    log = {p: model.logs[i] for i, p in enumerate(model.pieces) if p is not None}

    def total(s):
        if not s:
            return 1.0
        out = sum(math.exp(log[s[:k]]) * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in log)
        return out + (math.exp(sum(model.logs[model.of_byte[b]] for b in s[0].encode())) * total(s[1:]) if s[0] not in log else 0.0)

    some = ["the", "hello", "thndble", "é𝄞", "a", "zz\u0378"]
    assert model.words(some) == pytest.approx([math.log(total("▁" + w)) for w in some])


def test_scores(docs, rows, odd, empty):
    got = {r.doc_id: r for r in lattice.score(docs).collect()}
    tokens = {i: [w.decode() for w in (t or "").encode().lower().split()] + [None] for i, t, *_ in rows}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) and r.score < 0
    model = lattice.Lattice(lattice.default_vocabulary(), lattice.vocabulary_logs(lattice.default_vocabulary()))
    shares = lattice.Shares(n, v - 1, c[None], sum(x == 1 for w, x in c.items() if w), sum(x == 2 for w, x in c.items() if w))
    distinct = sorted({w for ws in tokens.values() for w in ws if w})
    log = dict(zip(distinct, model.words(distinct), strict=True))
    for i, ws in tokens.items():
        end = math.log10(shares.end())
        whole = sum(math.log10(max(c[w] - shares.discount, 0) / (n + 1) + (shares.discount * shares.v + 0.5) / (n + 1) * math.exp(log[w])) for w in ws if w)
        assert got[i].score == pytest.approx(whole + end)
        assert got[i].lattice_score == pytest.approx(sum(math.log10((1 - shares.end()) * math.exp(log[w])) for w in ws if w) + end)
    known = sum(max(x - shares.discount, 0) for w, x in c.items() if w) / (n + 1)
    assert known + (shares.discount * shares.v + 0.5) / (n + 1) + shares.end() == pytest.approx(1.0)
    assert lattice.score(empty).count() == 0 and lattice.score(odd).count() == 6


# 9. Packing.


def test_packing_round_trip(docs, rows, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    got = packing.pack(docs, window=256).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text, *_ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(sequences) <= 1.1 * sum(r.length for r in got) / 256 + 1
    assert packing.pack(empty).count() == 0 and packing.pack(odd).count() == 6


def test_parts_encode_as_the_whole():
    e = packing.Encoder(packing.default_tokenizer())
    texts = ["", " ", "  ", " a", "a ", "a  b", "a \n b", "don't  can't\tx 's", "a\u00a0 b", "x\u3000 y", "a \x1c b", "1 2  3\r\n 4", "<|endoftext|> a", "é   z", "a.\nB", ".\n\nB c,d", "it's ' s", "×a ÷b é.", "日本 語。a"]
    rng = np.random.Generator(np.random.PCG64(12))
    letters = list("ab'.,! \n\tzé×5|") + ["\u00a0", "\u3000", "日", "𝄞", " the", "\r\n", "'s"]
    texts += ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    ids, first = e.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_least_slack_fills_exactly_where_it_can():
    bins = packing.least_slack(np.array([7, 5, 5, 3, 3, 2, 2, 2, 1]), 10)
    assert sorted(i for b in bins for i in b) == list(range(9)) and len(bins) == 3


def test_least_slack_comes_nearest():
    """The first window holds the longest piece and, of all subsets of the others, one that fills it best; so do the next ones with what is left."""
    import itertools

    rng = np.random.Generator(np.random.PCG64(21))
    for _ in range(30):
        lengths = rng.integers(1, 40, 10)
        left = set(range(10))
        for b in packing.least_slack(lengths, 60):
            longest = max(left, key=lambda i: lengths[i])
            rest = left - {longest}
            best = max(sum(lengths[list(c)]) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if lengths[longest] + sum(lengths[list(c)]) <= 60) + lengths[longest]
            assert lengths[b].max() == lengths[longest] and lengths[b].sum() == best
            left -= set(b)
        assert not left


def test_encoder_forgets_within_its_room():
    texts = [f"w{i}x y{i}" for i in range(4000)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    small, large = packing.Encoder(packing.default_tokenizer(), room=1000), packing.Encoder(packing.default_tokenizer())
    for _ in range(2):
        a, b = (e.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)[0] for e in (small, large))
        assert (a == b).all()


# 10. Near-duplicates.


def brute_near(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1 if w else 0))}
    low = {i: i for i in sets}
    linked = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in linked:
            low[i] = low[j] = min(low[i], low[j])
    return {i: (len(sets[i]), low[i], low[i] == i) for i in sets}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in setsketch.near_duplicates(docs, k, percent).collect()}
    assert got == brute_near(rows, k, percent)


def test_large_groups_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "GROUP", 4)
    rng = np.random.Generator(np.random.PCG64(6))
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        for j in rng.choice(60, 1 + i % 3, replace=False):
            w[j] = f"n{i}"
        rows.append((i, " ".join(w), None, None, 0))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in setsketch.near_duplicates(spark.createDataFrame(rows, DOCUMENTS), 3, 85).collect()}
    assert got == brute_near(rows, 3, 85)


def test_near_edges(odd, empty):
    assert setsketch.near_duplicates(empty).count() == 0
    got = sorted(((r.doc_id or 0), r.component_id, r.kept) for r in setsketch.near_duplicates(odd).collect() if r.doc_id)
    assert got == [(1, 1, True), (3, 1, False), (3, 1, False), (3, 3, True)]


def test_estimate_and_merge():
    s = setsketch.Sketcher(128, 4)
    rng = np.random.Generator(np.random.PCG64(9))
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    a, b = x[:2000], x[500:2500]
    ra, rb = s.registers(a), s.registers(b)
    assert (np.maximum(ra, rb) == s.registers(x[:2500])).all()
    assert setsketch.estimate(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]))[0] == pytest.approx(0.6, abs=0.15)
    assert setsketch.band_rows(128, 0.85) == 5


def prose(rows):
    """The same texts with longer words and a full stop after every eighth word."""
    return [(i, t and re.sub(r"((?:\S+\s+){7}\S+)", r"\1.", re.sub(r"(\S+)", r"\1tion", t)), *rest) for i, t, *rest in rows]


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    rows = prose(rows)
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.count() > 40
        if name == "near_dedup":
            before = [tuple(r) for r in docs.collect()]
            near = brute_near(before, 5, 80)
            assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, v in near.items() if v[2])
        if name == "substring_dedup":
            want = brute_substring([tuple(r) for r in docs.collect()], 50)
            got = {r.doc_id: hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest() for r in after.collect()}
            assert got == {i: v[2] for i, v in want.items() if v[1] < v[0] or v[0] == 0}
        docs = after
    tokens = corpus_pipeline.run(spark, str(tmp_path))
    assert tokens.count() >= docs.count()


def test_pipeline_keeps_columns_whatever_their_names(spark, rows):
    import corpus_pipeline

    names = ["copies", "_d", "_p", "_s", "_copy", "_held", "_starts", "_text_to_measure", "measures", "votes", "quality", "row", "print", "held", "starts", "key"]
    docs = spark.createDataFrame(prose(rows), DOCUMENTS).select("*", *[F.lit(n).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        got = docs.collect()
        assert docs.columns == [*DOCUMENTS.replace(" long", "").replace(" string", "").split(", "), *names] and got, name
        assert all(r[n] == n for r in got for n in names)
        docs = spark.createDataFrame(got, docs.schema)


def test_pipeline_keeps_texts_that_share_an_id(spark):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "en", "a", 1), (1, long, "en", "a", 2), (1, "another text of its own", "en", "a", 3), (2, long, "en", "a", 4), (None, long, None, None, None), (None, long, None, None, None), (3, None, None, None, None)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCUMENTS), "").collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in got) == sorted([(1, long), (1, "another text of its own"), (0, long), (0, long), (3, "")])
    again = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows[::-1], DOCUMENTS), "").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_rlz_substring_dedup", "op6_tool_call_linking"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from gridloom.llm import registry

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    a, b = ([re.sub(r"(\d)\.0\b", r"\1", r) for r in rows(df)] for df in (got, want))
    assert a == b and len(a) > 0


def test_quality_query(spark):
    from gridloom.llm import registry

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = registry.QUERIES["op1_quality_rules"](spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        n, repeated = len(words(texts[r.doc_id])), r.n_repeat_words
        assert (r.n_words, r.n_symbols) == (n, sum(texts[r.doc_id].count(c) for c in "#*$%&|<>"))
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n) and r.kept == (not r.base_failed and r.quality_probability >= 0.5)
    assert 0 < sum(r.kept for r in got) < len(got)


@pytest.mark.parametrize("name", ["op3_histogram_shards", "op4_pivotal_mixing", "op5_pq_near_vectors", "op7_toxicity_chain", "op8_lattice_scores", "op10_setsketch_near_dedup"])
def test_queries_give_a_row_for_each_row(spark, name):
    from gridloom.llm import registry

    source, key = ("embeddings", "vec_id") if "op5" in name else ("documents", "doc_id")
    want = sorted(r[0] for r in spark.read.parquet(f"{DATA}/{source}.parquet").select(key).collect())
    assert sorted(r[key] for r in registry.QUERIES[name](spark, DATA).select(key).collect()) == want


def test_packing_query(spark):
    from gridloom.llm import registry

    got = registry.QUERIES["op9_slack_packing"](spark, DATA).toPandas()
    each = got.groupby("doc_id").agg(length=("length", "sum"), tokens=("doc_tokens", "first"))
    assert (each["length"] == each["tokens"]).all() and len(each) == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_registered(spark):
    import __spark_entry__

    from gridloom.plans import registry

    assert {n.split("_")[0] for n in __spark_entry__.queries() if n not in registry.QUERIES} == {f"op{k}" for k in range(1, 11)} | {"pipeline"}
    assert pa.__version__
