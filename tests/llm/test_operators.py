"""Operators against brute force, round trips and edge cases, on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import bits, chat, components, extraction, fingerprint, mixing, packing, quality, queries, scratch, shingles, substrings, text as texts_of, toxicity, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY = ["op1_relative_lz_dedup", "op3_harmonic_packing", "op4_multiset_fingerprints", "op9_source_mixing", "op10_prefix_tree_join"]


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, tiny, empty, null and long texts, and a column that clashes."""
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = text(45), text(120).split()
    rows = [text(rng.randint(5, 200)) for _ in range(40)]
    rows += [rows[0]] * 5 + [rows[1] + " tail"] + [None, "", " \t\n", "one", "one two three", "ONE two  Three", "a b c d", "A b c d"]
    for _ in range(30):
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        rows.append(" ".join(near))
    rows += [f"{text(30)} {passage} {text(30)}\n{passage}" for _ in range(12)]
    rows += ["x " * 400, " ".join(passage.split()[:20]), " ".join(passage.split()[:19]), text(6000)]
    rng.shuffle(rows)
    return pd.DataFrame({"doc_id": [7 * k + 3 for k in range(len(rows))], "text": rows, "lang": None, "source": [None if k % 9 == 0 else f"s{k % 4}" for k in range(len(rows))], "n_chars": [len(x or "") for x in rows]})


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [tuple(None if v is None or v != v else v for v in r) for r in corpus.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)).withColumn("runs", F.lit("x")).withColumn("node", F.lit(2)).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 1


def removed(rows, window=20):
    first, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        gone = set()
        for s in range(len(w) - window + 1):
            if first.setdefault(tuple(w[s : s + window]), (doc_id, s)) != (doc_id, s):
                gone.update(range(s, s + window))
        out[doc_id] = (len(w), len(gone), [x for i, x in enumerate(w) if i not in gone])
    return out


def test_substrings(docs, corpus):
    want = removed(zip(corpus.doc_id, corpus.text, strict=True))
    got = substrings.digest(docs).collect()
    assert len(got) == len(want) and sum(r["n_removed"] for r in got) > 0
    for r in got:
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_substrings_remove(docs, corpus):
    want = removed(zip(corpus.doc_id, corpus.text, strict=True))
    out = substrings.remove(docs)
    assert out.columns == docs.columns
    before = dict(zip(corpus.doc_id, corpus.text, strict=True))
    for r in out.collect():
        _, gone, kept = want[r["doc_id"]]
        assert r["text"] == (" ".join(kept) if gone else before[r["doc_id"]])
        assert r["n_chars"] == len(r["text"] or "")


def test_substrings_repeated_ids(spark):
    text = " ".join(f"a{k}" for k in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (1, "b " + text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.digest(df).collect())
    assert got == [(0, 0, 0), (0, 30, 0), (1, 30, 0), (1, 30, 30), (1, 31, 30)]


def test_substrings_remove_repeated_rows(spark):
    text = " ".join(f"a{k}" for k in range(30))
    short, other = "b c", " ".join(f"c{k}" for k in range(25))
    rows = [(1, text, "s"), (1, text, "s"), (1, text, "t"), (2, f"x {text}", "s"), (2, other, "s"), (3, short, "s"), (3, short, "s"), (None, text, "s"), (None, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit(7)).withColumn("runs", F.lit(8))
    out = substrings.remove(df)
    assert out.columns == df.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    assert got == [(0, ""), (0, text), (1, ""), (1, ""), (1, text), (2, other), (2, "x"), (3, short), (3, short)]
    assert {r["source"] for r in out.collect()} == {"s", "t"}
    again = [substrings.remove(df.repartition(n)).where("doc_id = 1 and text <> ''").first()["source"] for n in (2, 5)]
    assert again[0] == again[1]


def test_repeated_documents_stay_in_the_corpus(spark, small):
    import corpus_pipeline

    text = " ".join(f"a{k}" for k in range(30))
    other = " ".join(f"c{k}" for k in range(25))
    docs = spark.createDataFrame([(3, text, "en", "s", 9), (3, text, "en", "s", 9), (4, other, "en", "s", 9)], DOCS)
    # without the join of near copies, which is to leave one row of them
    out = corpus_pipeline.mix_sources(spark, scratch.keep(corpus_pipeline.cut_repeated_passages(spark, docs, small), "cut")[0], small).collect()
    assert {(r["doc_id"], r["text"]) for r in out} == {(3, text), (4, other)}


def test_factors_across_blocks_and_spans():
    # two blocks' factors with one source, a third with another source that begins inside
    got = substrings.parse(np.array([9, 0, 3]), np.array([2, 3, 2]), np.array([5, 7, 7]), np.array([0, 10, 13]), 3)
    assert got.tolist() == [[0, 7, 7, 10], [9, 4, 5, 0]]
    begin, end = substrings.covered(np.array([0, 2, 9]), np.array([4, 4, 3]))
    assert list(zip(begin, end, strict=True)) == [(0, 6), (9, 12)]


def test_factors_have_sources(docs, corpus):
    """Every factor's words stand at its source, earlier, and the factors cover what brute force removes."""
    text = {i: words(t) for i, t in zip(corpus.doc_id, corpus.text, strict=True)}
    want = removed(zip(corpus.doc_id, corpus.text, strict=True))
    gone = {i: set() for i in text}
    for r in substrings.factors(docs).collect():
        n, source = r["words"], text[r["source_id"]]
        assert n >= 20 and (r["source_id"], r["source_begin"]) < (r["doc_id"], r["begin"])
        assert text[r["doc_id"]][r["begin"] : r["begin"] + n] == source[r["source_begin"] : r["source_begin"] + n]
        gone[r["doc_id"]].update(range(r["begin"], r["begin"] + n))
    assert {i: len(x) for i, x in gone.items()} == {i: want[i][1] for i in text}


@pytest.mark.parametrize(("often", "most", "remembered"), [(2, 1 << 20, 400_000), (2, 0, 50), (64, 0, 400_000), (64, 1 << 20, 10)])
def test_substrings_by_every_way(docs, corpus, monkeypatch, often, most, remembered):
    monkeypatch.setattr(substrings, "REMEMBERED", remembered)
    monkeypatch.setattr(substrings, "ROW", 4)
    want = removed(zip(corpus.doc_id, corpus.text, strict=True))
    keyed = docs.select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("text"))
    gone = {i: set() for i in want}
    for r in substrings.matches(keyed, often=often, most_keys=most).collect():
        gone[r["key"]].update(range(r["begin"], r["begin"] + r["n"] + 19))
    assert {i: len(x) for i, x in gone.items()} == {i: x[1] for i, x in want.items()}


def test_filter_holds_all_keys(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("h"))
    filter_ = bits.build(df, "h")
    keys = np.array([r["h"] for r in df.collect()], np.int64).view(np.uint64)
    assert bits.holds(filter_, keys).all()
    assert bits.holds(filter_, keys + np.uint64(12345)).mean() < 0.01
    assert (shingles.spark_xxhash64([5, -7]).view(np.int64) == [r[0] for r in spark.createDataFrame([(5,), (-7,)], "x long").select(F.xxhash64("x")).collect()]).all()


# 2


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 8))
    x = np.concatenate([x, np.repeat(x[:4], 20, 0) + rng.normal(size=(80, 8)) * 0.12, x[:3], x[:2] * 5])
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in zip(rng.permutation(len(x)) * 3, x, strict=True)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0, None] + [0.0] * 6), (1004, [float("inf")] * 8), (1005, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("copy", F.lit("z"))
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows[: len(x)]]
    e = np.stack([v / np.linalg.norm(v) for _, v in good])
    link = e @ e.T >= 0.95
    np.fill_diagonal(link, False)
    union = components.Union(len(good))
    order = np.argsort([i for i, _ in good])
    rank = {int(k): p for p, k in enumerate(order)}
    for a, b in zip(*np.nonzero(link), strict=True):
        union.join(rank[int(a)], rank[int(b)])
    for interval in (4096, 16):
        got = {r["vec_id"]: r for r in vectors.link(df, interval=interval).collect()}
        assert len(got) == len(rows)
        for k, (i, _) in enumerate(good):
            root = good[order[union.root(rank[k])]][0]
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[k].sum(), root, i == root)
        for i in range(1000, 1006):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.link(none).count() == 0


def test_vectors_of_other_lengths(spark):
    rng = np.random.default_rng(12)
    vecs, k = [], 0
    for d, n in ((8, 60), (5, 40), (3, 12), (2, 2)):
        base = rng.normal(size=(4, d))
        for v in np.concatenate([base[rng.integers(0, 4, n - 1)] + rng.normal(size=(n - 1, d)) * 0.1, base[:1]]):
            vecs.append((k, v.astype(np.float32).tolist()))
            k += 1
    vecs += [(k, vecs[-1][1]), (k + 1, vecs[70][1]), (k + 2, [1.0]), (k + 3, [2.0]), (k + 4, [-1.0])]
    union, links = components.Union(len(vecs)), [0] * len(vecs)
    for i, x in vecs:
        for j, y in vecs:
            x_, y_ = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
            if i != j and len(x) == len(y) and x_ @ y_ / np.linalg.norm(x_) / np.linalg.norm(y_) >= 0.95:
                links[i] += 1
                union.join(i, j)
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    for interval in (4096, 16):
        got = sorted(tuple(r) for r in vectors.link(df, interval=interval).collect())
        assert got == [(i, links[i], union.root(i), union.root(i) == i) for i, _ in vecs]


def test_vectors_of_many_small_splits_and_intervals(spark, tmp_path, monkeypatch):
    """Splits without rows, ranges and gathered intervals of few vectors."""
    rng = np.random.default_rng(21)
    base = rng.normal(size=(30, 6))
    x = (base[rng.integers(0, 30, 300)] + rng.normal(size=(300, 6)) * 0.15).astype(np.float32)
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "v"))
    e = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = e @ e.T >= 0.95
    np.fill_diagonal(link, False)
    union = components.Union(300)
    for a, b in zip(*np.nonzero(link), strict=True):
        union.join(int(a), int(b))
    want = [(k, int(link[k].sum()), union.root(k), union.root(k) == k) for k in range(300)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        df = spark.read.parquet(str(tmp_path / "v"))
        assert df.rdd.getNumPartitions() > 4
        assert sorted(tuple(r) for r in vectors.link(df).collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    monkeypatch.setattr(vectors, "RANGE", 40)
    monkeypatch.setattr(vectors, "GATHER", 3)
    assert sorted(tuple(r) for r in vectors.link(df, interval=7).collect()) == want


# 3


def test_packing(docs, corpus):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs).toPandas()
    rows = {i: t for i, t in zip(corpus.doc_id, corpus.text, strict=True)}
    assert set(got.doc_id) == set(rows)
    for i, part in got.sort_values("start").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(rows[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert part.length.sum() == len(ids) and (part.doc_tokens == len(ids)).all()
        assert part.start.tolist() == [0, *part.length.cumsum().tolist()[:-1]]
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(part.start, part.length, strict=True)] == part.ids_crc32.tolist()
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 2048


def test_packing_places(spark):
    rng = np.random.default_rng(3)
    length = rng.choice([64, 32, 31, 7, 1, 2048, 1024], 3000)
    cut = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(3000), "start": 0, "length": length, "ids_crc32": 0, "doc_tokens": length}))
    got = packing.arrange(cut, 16).toPandas()
    total = got.groupby("sequence_id").length.sum()
    assert len(got) == 3000 and total.max() <= 2048
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in total) / total.sum() < 0.05


def test_chunk_ids_equal_the_tokenizer():
    path = packing.default_tokenizer()
    known = packing.ChunkIds(path)
    texts = ["Hello, wörld!! it's <|endoftext|> a<|endoftext|>,b İstanbul... x≠ ΑΣ, 'S'S' ### 12,3.", "", " a\u0085b\x1cc", "<|ENDOFTEXT|> don't.''", "日本語、テスト。 é,"]
    flat, at = known.ids(pa.array([x.encode() for x in texts], pa.binary()))
    for k, x in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == known.tokenizer.encode(x, add_special_tokens=False).ids


# 4


def naive_lanes(text):
    """(equal, near) lanes by paragraphs and words, one by one."""
    one = lambda data: int(texts_of.Words(pa.array([data], pa.binary())).hashes()[0])
    equal, near = [0] * fingerprint.EQUAL, [0] * fingerprint.NEAR
    for paragraph in text.encode().split(b"\n"):
        w = texts_of.Words.__new__(texts_of.Words)
        w.raw, w.start, w.end = np.frombuffer(paragraph + bytes(8), np.uint8), np.array([0]), np.array([len(paragraph)])
        h = w.hashes()[0]
        for k, lane in enumerate(fingerprint._LANES):
            equal[k] = (equal[k] + int(texts_of.mix(np.array([h ^ lane]))[0])) % 2**64
        before = 0
        for x in re.findall(rb"[^\x20\x09-\x0D]+", paragraph):
            h = one(x)
            pair = int(texts_of.join_hash(np.array([before], np.uint64), np.array([h], np.uint64))[0])
            near[pair % fingerprint.NEAR] += -1 if pair >> 40 & 1 else 1
            before = h
    return equal, near


def naive_likeness(a, b):
    if a == b:
        return 1.0
    x, y = np.array(a[1], float), np.array(b[1], float)
    size = np.sqrt((x @ x) * (y @ y))
    return float(np.clip(x @ y / size, 0, 1)) if size else 0.0


def naive_compared(rows):
    """rows in order: (doc_id, text) -> what compare_with_next gives for each."""
    lanes = [naive_lanes(t) for _, t in rows]
    out = []
    for k, (i, a) in enumerate(rows):
        b = rows[(k + 1) % len(rows)][1]
        changed = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        written = lambda x: fingerprint._write(fingerprint.to_bytes(np.array([x[0]], np.uint64), np.array([x[1]], np.int64).astype(np.uint32)))[0]
        c = naive_lanes(changed)
        out.append((i, len(a), hashlib.sha256(changed.encode()).hexdigest(), written(lanes[k]), written(c), naive_likeness(lanes[k], c), naive_likeness(lanes[k], lanes[(k + 1) % len(rows)])))
    return out


@pytest.mark.parametrize("size", [1, 4000, 1 << 20])
def test_fingerprints_against_brute_force(docs, corpus, size):
    rows = [(int(i), t or "") for i, t in sorted(zip(corpus.doc_id, corpus.text, strict=True), key=lambda r: r[0])]
    got = [tuple(r) for r in fingerprint.compare_with_next(docs, size).orderBy("doc_id").collect()]
    for x, y in zip(got, naive_compared(rows), strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:])
    long = [r for r in got if r[1] > 300]
    assert np.mean([r[5] for r in long]) > np.mean([r[6] for r in long]) + 0.4


def test_fingerprints_are_homomorphic():
    f = fingerprint.fingerprint
    assert f("a b\nc") == f("c\na b") and f("a b\nc") != f("b a\nc") and f(None) == f("")
    assert fingerprint.insert(f("a b\nc"), "c", -1) == f("a b") and fingerprint.insert(f("a b"), "c") == f("a b\nc")


def test_fingerprints_of_odd_ids(spark):
    """Null and repeated ids are in order of a hash of their texts; ranges cut through them."""
    rows = [(None, "n"), (None, "m o"), (None, None), (2, "b"), (2, "a"), (2, "b"), (5, None)] + [(7, f"t {k}") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash"))
    order = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("x")).orderBy(F.col("doc_id").asc_nulls_first(), "x").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5])
    for size, most in ((1, 1 << 17), (8, 3), (1 << 20, 1 << 17)):
        got = [tuple(r) for r in fingerprint.compare_with_next(df, size, most).collect()]
        for x, y in zip(sorted(got, key=key), sorted(naive_compared(order), key=key), strict=True):
            assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:])
    assert fingerprint.fingerprints(df).count() == len(rows)
    one = fingerprint.compare_with_next(spark.createDataFrame([(None, "n")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


# 5 and 7


@pytest.mark.parametrize(("name", "label", "folds", "held"), [("op5_pu_quality", "quality", 5, 0), ("op7_toxic_spans", "toxic", 4, 2)])
def test_held_out_accuracy(spark, name, label, folds, held):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, d).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert [zlib.crc32(str(i).encode()) % folds == held for i in got.doc_id] == got.held_out.tolist()
    both = got.merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    y, s = (both[both.held_out][c].to_numpy() for c in (label, "score"))
    assert (s[y == 1][:, None] > s[y == 0]).mean() > 0.85


def test_scores_of_odd_texts(spark, none):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    train = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(None, "a"), (1, None), (1, ""), (1, "x" * 100_000), (2, "!! " * 5000)], "doc_id long, text string").withColumn("score", F.lit(3)).withColumn("y", F.lit(1))
    for scored in (quality.score(odd, quality.fit(train, labels)[0]), toxicity.score(odd, toxicity.fit(train, labels))):
        assert scored.count() == 5 and scored.where("score is null or isnan(score)").count() == 0
    model, _ = quality.fit(none, labels)
    assert quality.score(odd, model).select("score").distinct().collect()[0][0] == 0.5
    assert toxicity.fit(none, labels) is None and toxicity.score(none, None).count() == 0
    assert quality.keep_good(odd, None).count() == 5


def naive_features(text):
    """quality.features of one text, word by word."""
    data, w = text.encode(), text.encode().split()
    out = np.zeros(quality.N_FEATURES)
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    stop, digit = set(b".,;:?!'\"-()"), set(b"0123456789")
    sign = lambda c: c >= 33 and not letter(c) and c not in stop and c not in digit
    if not w:
        return out
    for k, kind in enumerate((lambda c: 65 <= c <= 90, letter, lambda c: c in digit, lambda c: c in stop, sign)):
        out[k] = sum(map(kind, data)) / len(data)
    n = len(w)
    capital, letters = [sum(65 <= c <= 90 for c in x) for x in w], [sum(map(letter, x)) for x in w]
    out[5] = sum(a > 1 and a == b for a, b in zip(capital, letters, strict=True)) / n
    out[6] = sum(any(map(sign, x)) for x in w) / n
    out[7] = sum(a == b for a, b in zip(w, w[1:], strict=False)) / n
    out[8] = sum(b == 0 for b in letters) / n
    out[9] = np.log1p(sum(map(len, w)) / n)
    out[10] = len(set(w)) / n
    out[11] = out[10] * np.sqrt(n) / 10
    form = lambda c: 97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c
    for x in w:
        end = int.from_bytes(bytes(map(form, x[-3:])), "little")
        out[12 + int(texts_of.mix(np.array([end], np.uint64))[0] % np.uint64(quality.ENDINGS))] += 1 / n
    return np.sqrt(out)


def test_quality_scores_against_brute_force(spark, docs, corpus):
    d = "/root/testdata/sf0.001"
    train, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model, prior = quality.fit(train, labels)
    assert 0.05 <= prior <= 0.98
    # what is learned from: means and spreads of all unlabelled texts outside the held fold
    free = np.array([naive_features(r["text"] or "") for r in train.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5])
    assert np.allclose(model.mean, free.mean(0), atol=1e-4) and np.allclose(1 / model.scale, np.maximum(free.std(0), 0.02), atol=1e-3)
    for r in quality.score(docs, model).collect():
        x = naive_features(corpus.text[corpus.doc_id == r["doc_id"]].iloc[0] or "")
        z = ((x - model.mean) * model.scale) @ model.weight + model.bias
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(model.slope * z + model.shift))), abs=1e-3)


def test_risk_and_gradient_against_differences():
    rng = np.random.default_rng(14)
    p, u = rng.normal(1, 1, (50, 3)), rng.normal(0, 1, (80, 3))
    for prior in (0.3, 0.9):
        for v in rng.normal(size=(6, 4)) * 2:
            value, g = quality.risk(v, p, quality.negative_sums(u, v) / len(u), prior, 0.01)
            loss = lambda z: np.log1p(np.exp(-z)).mean()
            zp, zu = p @ v[:3] + v[3], u @ v[:3] + v[3]
            rest = loss(-zu) - prior * loss(-zp)
            assert value == pytest.approx(prior * loss(zp) + max(0, rest) + 0.005 * (v[:3] ** 2).sum())
            part = (lambda w: prior * loss(p @ w[:3] + w[3]) + loss(-(u @ w[:3] + w[3])) - prior * loss(-(p @ w[:3] + w[3]))) if rest >= 0 else (lambda w: -(loss(-(u @ w[:3] + w[3])) - prior * loss(-(p @ w[:3] + w[3]))))
            slope = [(part(v + e) - part(v - e)) / 2e-5 for e in np.eye(4) * 1e-5]
            assert np.allclose(g, np.array(slope) + 0.01 * np.append(v[:3], 0), atol=1e-5)


def test_sums_over_all_unlabelled_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    table = quality.feature_table(docs)
    x = quality._matrix(table.toArrow()["x"])
    v = np.random.default_rng(3).normal(size=quality.N_FEATURES + 1)
    assert np.allclose(quality._sums(table.repartition(5), lambda r: quality.negative_sums(r, v)), quality.negative_sums(x, v))


def test_toxic_scores_against_brute_force(spark, docs, corpus):
    """Tokens, features, chains, forward and backward sums and document scores, word by word."""
    d = "/root/testdata/sf0.01"
    field = toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    marks = set(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    lower = lambda x: bytes(c + 32 if 65 <= c <= 90 else c for c in x)

    def view(k, x):
        last, most = toxicity._VIEWS[k]
        w = texts_of.Words.__new__(texts_of.Words)
        x = x[-most:] if last else x[:most] if most else x
        w.raw, w.start, w.end = np.frombuffer(x + bytes(8), np.uint8), np.array([0]), np.array([len(x)])
        return texts_of.mix(w.hashes() ^ np.uint64(k << 56))[0]

    def scored(text):
        data, tokens, chains = text.encode(), [], []
        new = True
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", data):
            x = m[0]
            while len(x) > 1 and x[-1] in marks:
                x = x[:-1]
            while len(x) > 1 and x[0] in marks:
                x = x[1:]
            if new or len(chains[-1]) == toxicity.CHAIN:
                chains.append([])
            chains[-1].append(len(tokens))
            tokens.append(lower(x))
            new = m[0][-1] in b".!?" or data[m.end() : m.end() + 1] == b"\n"
        views = [[view(k, x) for k in range(len(toxicity._VIEWS))] for x in tokens]
        e = [sum(float(field.weight[int(v) & ((1 << toxicity.LOG_CELLS) - 1)]) for v in row) for row in views]
        p = [0.0] * len(tokens)
        t = np.exp(field.move)
        for chain in chains:
            f = [np.array([1.0, np.exp(e[chain[0]] + field.start)])]
            for k in chain[1:]:
                f.append((f[-1] @ t) * [1.0, np.exp(e[k])])
                f[-1] /= f[-1].sum()
            b = np.ones(2)
            for j in range(len(chain) - 1, -1, -1):
                both = f[j] * b
                p[chain[j]] = both[1] / both.sum()
                b = t @ (b * [1.0, np.exp(e[chain[j]])])
                b /= b.sum()
        most = np.clip(max(p, default=0.0), 1e-4, 1 - 1e-4)
        different = {}
        for x, q in zip(tokens, p, strict=True):
            if q > 0.02:
                different.setdefault(x, q)
        high, low = (sum(q for q in different.values() if (q > 0.5) == h) for h in (True, False))
        z = np.array([np.log(most / (1 - most)) / 4, np.log1p(high), np.log1p(low), 1.0]) @ field.document
        return 1 / (1 + np.exp(-z))

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").limit(80).collect()} | {int(i): t or "" for i, t in zip(corpus.doc_id + 10**6, corpus.text, strict=True)}
    got = toxicity.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), field).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["score"] == pytest.approx(scored(texts[r["doc_id"]]), abs=2e-3)


def test_toxic_sample_is_bounded_by_bytes(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen = []
    try:
        plain, toxicity.train = toxicity.train, lambda texts, toxic: seen.append((texts, toxic))
        toxicity.fit(docs, labels, most_bytes=20_000)
    finally:
        toxicity.train = plain
    texts, toxic = seen[0]
    for y in (True, False):
        mine = [len(x.as_py() or b"") for x, t in zip(texts, toxic, strict=True) if t == y]
        assert mine and (sum(mine) <= 20_000 or len(mine) == 1)


def test_class_prior_and_risk():
    rng = np.random.default_rng(4)
    positive, negative = rng.normal(1.5, 1, (3000, 2)), rng.normal(-1.5, 1, (3000, 2))
    mixed = np.concatenate([rng.normal(1.5, 1, (2100, 2)), negative[:900]])
    model, prior = quality.train(positive, mixed)
    assert 0.55 < prior < 0.8
    assert (model.output(positive) > 0).mean() > 0.9 and (model.output(negative) < 0).mean() > 0.9


def test_marginals_against_enumeration():
    import itertools

    rng = np.random.default_rng(5)
    emission, move, start = rng.normal(size=5), rng.normal(size=(2, 2)), 0.3
    weight = {y: np.exp(sum(e * v for e, v in zip(emission, y, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(y)) + start * y[0]) for y in itertools.product((0, 1), repeat=5)}
    total = sum(weight.values())
    want = [sum(w for y, w in weight.items() if y[k]) / total for k in range(5)]
    p, moves, first = toxicity.marginals(emission, np.array([0]), np.array([5]), move, start)
    assert np.allclose(p, want) and first[0] == pytest.approx(want[0])
    assert moves[1, 1] == pytest.approx(sum(w * sum(a and b for a, b in itertools.pairwise(y)) for y, w in weight.items()) / total)


def test_toxic_spans_are_offsets(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    field = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    text = spark.createDataFrame([(1, "Élan vital idiot, et çela.\nscum")], "doc_id long, text string")
    found = [(r["begin"], r["end"]) for r in toxicity.spans(text, field).orderBy("begin").collect()]
    assert (11, 16) in found and (27, 31) in found


# 6


def test_extraction_of_new_layouts():
    e = extraction.default_extractor()
    good = n = 0
    for page, main in extraction.page_maker(150, 77):
        got = set(e.extract([page])[0].split("\n")) - {""}
        good += got == main
        n += 1
    assert good / n > 0.95


def test_extraction_of_stored_pages(spark, small):
    import html

    for r in queries.op6_html_extraction(spark, small).join(spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"])


def test_extraction_edge_cases(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>"), (4, "u", "<nav><a href=x>a</a></nav>"), (None, "u", "<article><p>a &lt; b &amp\n c<br>d<p>e</article><script>x</p>"), (5, "u", "<" * 2000), (5, "u", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extraction.extract(df).collect()
    assert len(got) == 7 and all(r["text"] is not None for r in got)
    assert next(r for r in got if r["page_id"] is None)["text"] == "a < b & c d\ne"
    assert extraction.extract(df.limit(0)).count() == 0


def test_extraction_of_formulas_fallbacks_and_long_classes():
    text = [f"The {x} sentence of the story goes on for some words. And it has another one that ends here." for x in ("first", "second", "third", "last")]
    paragraphs = "".join(f"<p>{x}</p>" for x in text[:2])
    formula = "<p>We know that <math><mrow><mi>a</mi><mo>=</mo><mfrac><mn>1</mn><mi>b</mi></mfrac></mrow></math> holds in every case that we have seen.</p>"
    rest = f"<noscript><p>{text[2]}</p></noscript><object data=x><param name=y><p>{text[3]}</p></object>"
    utilities = " ".join(f"mt{k} flex" for k in range(8))
    aside = f'<div class="{utilities} sidebar widget"><p>Something else that nobody wants to read here.</p><ul><li><a href=/>One</a></li><li><a href=/>Two</a></li></ul></div>'
    page = f"<html><body><nav><a href=/>Home</a></nav><article><h1>A title of words</h1>{paragraphs}{formula}{rest}</article>{aside}</body></html>"
    want = ["A title of words", *text[:2], "We know that a=1b holds in every case that we have seen.", *text[2:]]
    assert extraction.default_extractor().extract([page])[0].split("\n") == want
    nodes, _ = extraction.read_page(aside)
    assert {"sidebar", "widget"} <= set(nodes[1].tokens)


def test_decoding_agrees_along_paths():
    rng = np.random.default_rng(6)
    nodes, _ = extraction.read_page("<div><p>a</p><section><p>b</p><p>c</p></section></div><div><p>d</p></div>")
    for _ in range(50):
        keep = extraction.decode(nodes, rng.normal(size=len(nodes)) * 4)
        assert all(keep[n.up] for k, n in enumerate(nodes) if k and keep[k])


# 8


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n<|im_sep|>", "\\<s>", "\\\\</s>\\", "", None, "\n<|im_next|>x", "[INST[INST]]", "é\U0001f600"]
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a<|im_sep|>b"]), rng.choice(nasty)) for c in range(30) for t in range(rng.randint(1, 7))] + [(None, 1, "user", "x"), (1, 0, "user", "again"), (1, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    digests = {r["conv_id"]: r for r in chat.digest(chat.format_chats(df)).collect()}
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, turns in groups.items():
        want = [(r, x) for _, _, r, x in sorted(turns)]
        assert [tuple(x) for x in got[c]["back"]] == want
        loss = "".join(x for r, x in want if r == "assistant")
        assert digests[c]["n_turns"] == len(want) and digests[c]["loss_chars"] == len(loss)
        assert digests[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert digests[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in want).encode()).hexdigest()
        assert len(got[c]["loss_mask"]) == sum(r == "assistant" for r, _ in want)
    assert chat.format_chats(df.limit(0)).count() == 0


# 9


def test_mixing(docs, corpus):
    got = mixing.mix(docs).toPandas()
    size = {i: len(words(t)) for i, t in zip(corpus.doc_id, corpus.text, strict=True)}
    assert [size[i] for i in got.doc_id] == got["size"].tolist()
    total = got.groupby("source", dropna=False).agg({"size": "sum", "target": "first", "taken": "sum", "source_size": "first"})
    assert total["target"].sum() == pytest.approx(total["size"].sum()) and (total["target"] <= 3 * total["size"] + 1e-6).all()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    largest = got.groupby("source", dropna=False)["size"].max()
    assert ((total["taken"] - total["target"]).abs() <= largest + 1).all()
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 1), (None, 500), ("é", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # weights by code point: a 1, b 2, c 3, é 1, null 2
    assert got["b"] == 30 and got["c"] == 3 and got["é"] == 0
    assert got["a"] == pytest.approx((1511 - 33) / 3) and got[None] == pytest.approx((1511 - 33) * 2 / 3)


def test_take_emits_copies(docs):
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    want = mixing.mix(docs).where("copies > 0").select("doc_id", "copies").collect()
    assert {r["doc_id"]: r["count"] for r in taken.groupBy("doc_id").count().collect()} == {r["doc_id"]: r["copies"] for r in want}
    twice = docs.unionByName(docs)
    assert mixing.take(twice).count() == mixing.mix(twice).agg(F.sum("copies")).first()[0]


# 10


def jaccard_components(rows, n=4, percent=85):
    sets = []
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    union = components.Union(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            o = len(sets[a][1] & sets[b][1])
            if o and 100 * o >= percent * len(sets[a][1] | sets[b][1]):
                union.join(a, b)
    return {i: (len(s), sets[union.root(k)][0]) for k, (i, s) in enumerate(sets)}


@pytest.mark.parametrize(("longest", "block"), [(64, 256), (3, 4), (2, 8)])
def test_shingles(docs, corpus, longest, block):
    want = jaccard_components(zip(corpus.doc_id, corpus.text, strict=True))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingles.link(docs, longest_list=longest, block=block).collect()}
    assert got == want


def test_trie_against_pairs():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 1 << 60, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(30, 58), False), rng.integers(0, 1 << 60, rng.integers(0, 5)).astype(np.uint64)])) for _ in range(80)]
    order = shingles.Order(base[:20], np.arange(20))
    trie = shingles.Trie()
    for k, s in enumerate(sets):
        trie.add(order.sort(s), k)
    for s in sets:
        want = [k for k, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 85 * len(np.union1d(s, t))]
        assert sorted(trie.partners(s)) == want


def test_cells_never_rule_out_a_link():
    rng = np.random.default_rng(9)
    for _ in range(300):
        base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400))).astype(np.uint64) * np.uint64(2))
        other = np.unique(np.concatenate([base[rng.random(len(base)) < rng.uniform(0.7, 1)], rng.integers(0, 1 << 63, int(rng.integers(0, 60))).astype(np.uint64)]))
        if len(other) and 100 * len(np.intersect1d(base, other)) >= 85 * len(np.union1d(base, other)):
            assert shingles.possible(shingles.cell_counts(base), shingles.cell_counts(other))
    assert not shingles.possible(shingles.cell_counts(base), shingles.cell_counts(base + np.uint64(1 << 55)))


def test_shingles_of_odd_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "q r s t u"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in shingles.link(df).collect())
    assert [x[0] for x in got] == [0, 1, 1, 2, 3] and got[0][2] is None and got[3] == (2, 0, 2) and got[4] == (3, 0, 3)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 100), (None, 3), (7, 7), (200, 201), (201, 200)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[201] == 200 and 100 not in got


# all


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables(spark, none, name, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def shares(sizes, cap=3.0):
    """Targets by sharing again and again what is above the caps."""
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {x: 1.0 + k % 3 for k, x in enumerate(names)}
    full, left, free = {}, float(sum(sizes.values())), set(names)
    while True:
        unit = left / sum(weight[x] for x in free) if free else 0
        over = {x for x in free if unit * weight[x] > cap * sizes[x]}
        if not over:
            return full | {x: unit * weight[x] for x in free}
        for x in over:
            full[x] = cap * sizes[x]
            left -= full[x]
        free -= over


def copies(rows, seed=20):
    """rows: (doc_id, source, size). How often each is taken."""
    sizes = {}
    for _, source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    target, out = shares(sizes), {}
    for source, total in sizes.items():
        u = int(hashlib.md5(f"{seed}:{'n' if source is None else 's' + source}".encode()).hexdigest()[:8], 16) / 2**32
        rate = target[source] / total if total else 0.0
        for k, (i, _, size) in enumerate(sorted((r for r in rows if r[1] == source), key=lambda r: (r[2], r[0] % mixing.SHARES, r[0])), 1):
            out[i] = int(np.floor(k * rate + u) - np.floor((k - 1) * rate + u)) if size else 0
    return out


def test_mixing_against_brute_force(docs, corpus):
    want = copies([(i, s, len(words(t))) for i, s, t in zip(corpus.doc_id, corpus.source, corpus.text, strict=True)])
    assert {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()} == want


def test_pipeline_against_brute_force(spark, small):
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    model, _ = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    one = lambda text: model.score(quality.features(pa.array([(text or "").encode()], pa.binary())).astype(float))[0]
    good = [i for i in rows if one(rows[i]["text"]) >= 0.3]
    group = jaccard_components([(i, rows[i]["text"]) for i in good])
    first = [i for i in good if group[i][1] == i]
    cut = removed([(i, rows[i]["text"]) for i in first])
    text = {i: " ".join(cut[i][2]) if cut[i][1] else rows[i]["text"] or "" for i in first}
    taken = copies([(i, rows[i]["source"], len(words(text[i]))) for i in first])
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = {i: (len(tokenizer.encode(text[i], add_special_tokens=False).ids) + 1, n) for i, n in taken.items() if n}
    out = corpus_pipeline.run(spark, small).toPandas()
    assert {i: (part.doc_tokens.iloc[0], (part.start == 0).sum()) for i, part in out.groupby("doc_id")} == want
    assert {i: part.length.sum() for i, part in out.groupby("doc_id")} == {i: n * k for i, (n, k) in want.items()}
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 2048


def test_pipeline_keeps_one_row_of_near_copies(spark, small):
    import corpus_pipeline

    one, two, three, other = (" ".join(f"{x}{k}" for k in range(60)) for x in "pqrs")
    rows = [(1, one), (1, one), (3, two), (5, f"{two} tail"), (5, other), (7, f"{three} tail"), (8, one), (8, three), (9, "u v"), (9, ""), (None, one), (None, one), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("kept_key", F.lit(2))
    out = corpus_pipeline.keep_one_of_near_copies(spark, docs, small)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    assert got == [(0, ""), (0, one), (0, one), (1, one), (3, two), (5, other), (7, f"{three} tail"), (9, ""), (9, "u v")]


def test_few_links_are_united_in_one_task(spark, docs, corpus, monkeypatch):
    rng = np.random.default_rng(12)
    pairs = [(int(a) - 300, int(b) - 300) for a, b in rng.integers(0, 600, (350, 2))] + [(None, 1), (2, None), (5, 5)]
    links = spark.createDataFrame(pairs, "a long, b long")
    want = sorted(tuple(r) for r in components.components(links).collect())
    assert sorted(tuple(r) for r in components.components(links, few=len(pairs)).collect()) == want
    assert components.components(links.limit(0), few=9).count() == 0
    saved, save = [], components.save
    monkeypatch.setattr(components, "save", lambda df, name: saved.append(name) or save(df, name))
    components.components(links, few=len(pairs) - 1)
    assert "edges" in saved
    saved.clear()
    want = jaccard_components(zip(corpus.doc_id, corpus.text, strict=True))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingles.link(docs).collect()} == want
    assert set(saved) == {"labels"} and len(saved) <= 3
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingles.link(docs, few_links=0).collect()} == want


@pytest.mark.parametrize("log_bits", [15, 20])
def test_rows_without_keys_that_go(spark, monkeypatch, log_bits):
    """The smaller filter holds many keys that stay."""
    monkeypatch.setattr(bits, "log_bits_for", lambda n: log_bits)
    rows = spark.range(20_000).select(F.when(F.col("id") % 1000 != 1, F.col("id")).alias("k"), F.col("id").cast("string").alias("text"))
    gone = spark.range(0, 20_000, 4).select(F.col("id").alias("g"))
    got = [tuple(r) for r in substrings.without_keys(rows, "k", gone).collect()]
    assert sorted(got, key=lambda r: int(r[1])) == [(None if i % 1000 == 1 else i, str(i)) for i in range(20_000) if i % 4]
    assert substrings.without_keys(rows, "k", gone.limit(0)).count() == 20_000 and substrings.without_keys(rows.limit(0), "k", gone).count() == 0


def test_pipeline_near_copies_sends_no_texts_that_stay(spark, small):
    import time

    import corpus_pipeline

    def shuffled():
        time.sleep(1)  # the listener's queue
        all_ = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(all_.apply(k).totalShuffleWrite() for k in range(all_.size()))

    rng = np.random.default_rng(3)
    rows = [(i, rng.bytes(5_000).hex() + " " + " ".join(f"w{i}x{k}" for k in range(20)), None, None, 0) for i in range(300)]
    docs = spark.createDataFrame([*rows, (1000, rows[0][1], None, None, 0)], DOCS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.keep_one_of_near_copies(spark, docs, small)
        before = shuffled()
        assert sorted(r["doc_id"] for r in out.select("doc_id", "text").collect()) == list(range(300))
        assert shuffled() - before < 300_000  # of 3 MB of text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pipeline_near_copies_against_brute_force(spark, corpus, docs, small):
    import corpus_pipeline

    w = [f"n{k}" for k in range(126)]
    added = [(9001, " ".join(w[:100])), (9002, " ".join(w[:120])), (9003, " ".join(w))]  # 0.83 and 0.79 of the first, 0.95 of one another
    added += [(9011, " ".join(w[60:90])), (9012, " ".join(w[60:99]))]  # 26 of 35
    rows = [*zip(corpus.doc_id, corpus.text, strict=True), *added]
    more = docs.unionByName(spark.createDataFrame([(i, t, None, None, len(t)) for i, t in added], DOCS), allowMissingColumns=True)
    group = jaccard_components(rows, 5, 80)
    got = sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_near_copies(spark, more, small).select("doc_id").collect())
    assert got == sorted(i for i, _ in rows if group[i][1] == i)
    assert [i for i in got if i > 9000] == [9001, 9011, 9012]
    assert [i for i, (_, c) in jaccard_components(rows).items() if i > 9000 and c == i] == [9001, 9002, 9011, 9012]


def test_pipeline_keeps_good_documents(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.01"
    kept = {r["doc_id"] for r in corpus_pipeline.keep_good(spark, spark.read.parquet(f"{d}/documents.parquet"), d).select("doc_id").collect()}
    y = spark.read.parquet(f"{d}/labels.parquet").toPandas().set_index("doc_id").quality
    assert np.mean([i in kept for i in y[y == 1].index]) > 0.97 and np.mean([i in kept for i in y[y == 0].index]) < 0.3


ODD = [
    (None, "a good sentence of words", "en", None, 3), (None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, " \t\n", None, None, 3), (3, "One two three. " * 30, "en", "s", 9), (3, "One two three. " * 30, "en", "s", 9),
    (3, "Other words stand here, in a line of their own.", "en", "t", 9), (4, "long " * 30_000, "en", "t", 9), (5, "Ünï cödé \U0001f600 words", "en", "é", 9), (2**62, "last one", "en", "s", 8),
]


def odd(spark, rows=ODD):
    clashes = ["x", "score", "key", "kept_key", "runs", "node", "_copies", "_d", "copies", "component_id", "Size"]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in clashes})


@pytest.mark.parametrize("name", [n for n, _ in __import__("corpus_pipeline").STAGES])
def test_pipeline_stages_on_odd_and_empty_tables(spark, small, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd(spark)
    out = scratch.keep(stage(spark, docs, small), "odd")[0]
    got = sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=repr) if "text" in out.columns else out.collect()
    plain = [(r[0], r[1]) for r in ODD]
    if name == "quality classifier":
        model, _ = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
        good = lambda t: model is None or model.score(quality.features(pa.array([(t or "").encode()], pa.binary())).astype(float))[0] >= 0.3
        assert got == sorted([r for r in plain if good(r[1])], key=repr)
    elif name == "n-gram Jaccard join":
        assert got == sorted([*plain[:5], plain[5], *plain[7:]], key=repr)
    elif name == "substring dedup":
        # all windows of the two repeating texts but the first of each period start earlier; equal rows lose all
        first, again = removed([(0, plain[5][1]), (1, plain[5][1])]).values()
        rest = removed([(0, plain[8][1])])[0]
        want = [*plain[:5], (3, " ".join(first[2])), (3, " ".join(again[2])), plain[7], (4, " ".join(rest[2])), *plain[9:]]
        assert got == sorted(want, key=repr) and again[2] == []
    elif name == "mixing sources to target weights":
        assert len(got) == mixing.mix(docs).agg(F.sum("copies")).first()[0] and all(words(t) for _, t in got)
    else:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(packing.default_tokenizer())
        total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in plain)
        assert sum(r["length"] for r in got) == total and sum(r["start"] == 0 for r in got) == len(plain)
    if name != "packing":
        assert out.columns == docs.columns and all(r["x"] == 7 and r["Size"] == 7 for r in out.collect())
    assert stage(spark, odd(spark, []), small).count() == 0


def test_links_of_shared_ids_against_brute_force(spark):
    """Texts link, not ids: what shares an id with a linked text stays apart."""
    text = " ".join(f"a{k}" for k in range(40))
    rows = [(1, text), (2, text + " tail"), (2, " ".join(f"u{k}" for k in range(30))), (3, " ".join(f"u{k}" for k in range(30))), (4, "q r"), (4, "q r"), (4, text), (0, "q r")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in shingles.link(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    keyed = [((i, k), t) for k, (i, t) in enumerate(rows)]
    want = sorted((i[0], n, root[0]) for i, (n, root) in jaccard_components(keyed).items())
    assert got == want


def test_shingles_without_filters(docs, corpus):
    want = jaccard_components(zip(corpus.doc_id, corpus.text, strict=True))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingles.link(docs, most_keys=0).collect()} == want


def test_hostile_pages_take_linear_time():
    import time

    pages = ["<a " * 350_000, '<a "" ' * 150_000 + "'>", '<a ">" ' * 150_000, "<svg>" * 200_000, "<select>" * 120_000, "<!" * 400_000, "<!--" * 200_000, "<div>" * 80_000 + "</q></x>" * 80_000, "<div>" * 40_000 + "<li>" * 40_000, "<p title='x>" * 80_000, "&" * 900_000]
    began = time.perf_counter()
    for page in pages:
        extraction.read_page(page)
    assert time.perf_counter() - began < 12
    assert extraction.read_page("<p>a <b title=\"x>y\">c</b> < d <3</p><i title='open>f</i><p>g <a")[1][0][1] == "a c < d <3"
    assert [t for _, t in extraction.read_page("<p>one</p><p>two <a href='x'")[1]] == ["one", "two <a href='x'"]


NEWS = """<body bgcolor=white><table width=100%><tr><td colspan=2><font size=5>The Daily Sample</font> | <a href=/>Home</a> | <a href=/w>World</a> | <a href=/s>Sport</a></td></tr>
<tr><td class=leftnav width=120><a href=/1>Politics</a><br><a href=/2>Business</a><br><a href=/3>Weather</a></td>
<td class="maincontent"><h1>Harbour opens after long repairs</h1><p>The harbour of the old town opened again on Monday, after two years of work on its walls. Boats came in from the early morning on.</p>
<p>Many visitors had come to see them. The mayor thanked the workers, who had been there in every weather.</p><div class=advert><p>Buy two lamps and pay for one! Only this week.</p></div>
<p>The next step is the lighthouse, which is to be painted in the spring.</p></td></tr></table><div class=footer>&copy; The Daily Sample. All rights reserved. <a href=/imprint>Imprint</a></div></body>"""
BLOG = """<body><div id="top-bar"><div class="logo">my notes</div><ul class="nav-links"><li><a href=/a>about</a></li><li><a href=/b>archive</a></li></ul></div>
<div class="wrap"><div class="post-body"><h2>Bread without much work</h2><p>I have baked this bread every week for a year now. It needs four things and a night of rest.</p><ul><li>Mix the flour and the water in the evening, and add the salt.</li><li>Let it stand in a warm place until the morning comes.</li></ul><blockquote>Good bread takes its time, my teacher used to say to us.</blockquote></div>
<div id="respond-comments" class="comments-area"><h3>2 comments</h3><div class="comment"><p>I tried it and it was great. Thank you so much!</p></div><div class="comment"><p>Mine did not rise at all. What could be wrong?</p></div></div></div>
<div class="widget sidebar"><h4>Recent</h4><ul><li><a href=/1>Soup</a></li><li><a href=/2>Beans</a></li></ul></div></body>"""
WIKI = """<body class="mw"><nav id=site-nav><ul><li><a href=/>Main page</a></li><li><a href=/r>Random</a></li></ul></nav><main id=content><h1>Stone bridge</h1><p>A <b>stone bridge</b> is a <a href=/bridge>bridge</a> that is built of <a href=/stone>stone</a>. It stands for a long time, if its feet do.</p>
<h2>History</h2><p>The oldest of them are more than three thousand years old. Some can still be walked on today.</p><table><tr><td>Name of the bridge</td><td>Year it was built</td></tr></table></main>
<form action=/search><label>Search</label><input name=q><button>Go</button></form><footer><p>Text is free to use. See the terms for details.</p></footer><script>var x = "<p>no</p>";</script></body>"""


@pytest.mark.parametrize(("page", "inside", "outside"), [
    (NEWS, ["Harbour opens after long repairs", "Boats came in", "the lighthouse, which"], ["Buy two lamps", "Politics", "All rights", "Sport"]),
    (BLOG, ["Bread without much work", "four things", "Mix the flour", "takes its time"], ["tried it", "did not rise", "archive", "Soup"]),
    (WIKI, ["Stone bridge", "is a bridge that is built of stone.", "History", "three thousand", "Name of the bridge"], ["Random", "Search", "free to use", "no"]),
])
def test_extraction_of_pages_written_by_hand(page, inside, outside):
    text = extraction.default_extractor().extract([page])[0]
    assert all(x in text for x in inside), text
    assert not any(x in text.split() or len(x) > 3 and x in text for x in outside), text


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch, tmp_path):
    class Context:
        def __init__(self, local, folder=None):
            self.local, self.given = local, folder

        isLocal = lambda self: self.local
        getCheckpointDir = lambda self: type("Option", (), {"isDefined": lambda _: self.given is not None, "get": lambda _: self.given})()

    def session(context):
        jsc = type("J", (), {"sc": lambda _: context})()
        return type("S", (), {"conf": type("C", (), {"get": lambda _, k, d: d})(), "sparkContext": type("X", (), {"_jsc": jsc})()})()

    with pytest.raises(RuntimeError):
        scratch.folder(session(Context(False)))
    assert scratch.folder(session(Context(False, "hdfs://shared"))) == "hdfs://shared"
    assert scratch.folder(session(Context(True))).startswith("file://")


def test_long_conversations_are_linear(spark):
    import time

    df = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 < 2, "user").otherwise("assistant").alias("role"), F.lit("é </s> word").alias("text"))
    chat.digest(chat.format_chats(df.limit(10))).collect()
    began = time.perf_counter()
    chats = chat.format_chats(df)
    r = chat.digest(chats).collect()[0]
    assert (r["n_turns"], r["loss_chars"]) == (20_000, 11 * 6666) and time.perf_counter() - began < 20
    row = chats.collect()[0]
    data = row["formatted"].encode()
    assert all(row["formatted"][m["begin"] : m["end"]] == data[m["first_byte"] : m["last_byte"]].decode() == "é \\</s> word" for m in row["loss_mask"])
