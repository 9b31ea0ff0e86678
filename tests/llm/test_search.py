"""Ranked search, divergence audit and decontamination against brute force, and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from riskloom.llm import decontamination, divergence, ranking, wavelets
from riskloom.llm.text import LETTERS, LETTERS_DIGITS, Vocabulary, Words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, term string, item_id long"
ITEMS = "item_id long, text string, score string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM, ALPHA = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words(text, rule=ALNUM):
    return [w.translate(LOWER) for w in rule.findall(text or "")]


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text, lang, source): copies, passages, null and empty texts, repeated and null ids, odd bytes."""
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "kLmñ漢" for b in "aeiO" for c in ("", "x9", "ßt", "rest of words that are long")]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice((12, 40, 80))]) for _ in range(n))
    passage = text(40)
    rows = [text(rng.randint(1, 160)) for _ in range(60)] + [None, "", " \t--", "a", "ÀÉ É", "x" * 70_000, text(9000)]
    rows += [rows[0]] * 6 + [f"{text(9)}\n{passage}, {text(20)}; {passage.upper()}" for _ in range(9)] + [passage]
    out = [(3 * k, t, rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "c", "Z", "ü", None])) for k, t in enumerate(rows)]
    return [*out, (0, rows[3], "en", "a"), (0, rows[3], "en", "a"), (None, rows[4], "en", "b"), (None, rows[4], "en", "b"), (7, "- 9", "fr", "s"), (8, None, "fr", "t"), (9, "solo", "xx", "s")]


@pytest.fixture(scope="module")
def items(corpus):
    rng = random.Random(6)
    out = []
    for k in range(14):
        w = words(rng.choice([r[1] for r in corpus if len(words(r[1])) > 60 and len(r[1]) < 60_000]))
        a = rng.randrange(len(w) - 30)
        out.append((100 - k, " ".join(w[a : a + rng.choice((3, 9, 10, 11, 25))]).upper(), "x"))
    long = next(r[1] for r in corpus if len(words(r[1])) > 8000)
    return [*out, (1, None, "y"), (2, " ,", "y"), (3, "words nobody wrote here at all in any of the texts", "y"), (99, "another text of one item", "y"), (None, out[0][1], "y"), (5, long, "z")]


@pytest.fixture(scope="module")
def tables(spark, corpus, items):
    return spark.createDataFrame([(*r, 1, 2, "t", 9) for r in corpus], DOCS).repartition(3).persist(), spark.createDataFrame(items, ITEMS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)


# wavelets, words


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (50, 2), (300, 37), (500, 64)):
        x = rng.integers(0, top, n)
        carry = rng.integers(0, 99, n)
        tree = wavelets.WaveletMatrix(x, max(1, int(top - 1).bit_length()), carry)
        assert (tree.access(np.arange(n)) == x).all()
        s, at = rng.integers(0, top, 200), rng.integers(0, n + 1, 200)
        assert tree.rank(s, at).tolist() == [int((x[:b] == a).sum()) for a, b in zip(s, at, strict=True)]
        turned = np.array([int(f"{v:0{tree.depth}b}"[::-1], 2) for v in x.tolist()])
        assert (tree.carried[-1] == carry[np.argsort(turned, kind="stable")]).all()


def test_words_by_table_and_vocabulary(corpus):
    texts = [r[1] for r in corpus]
    for inside, rule in ((LETTERS, ALPHA), (LETTERS_DIGITS, ALNUM)):
        w = Words(pa.array(texts), True, inside)
        flat = [x for t in texts for x in words(t, rule)]
        assert w.array(np.arange(len(w))).to_pylist() == flat
        known = Vocabulary([x.encode() for x in flat[::7]])
        assert [known.terms[i].decode() if i >= 0 else None for i in known.find(w)] == [x if x in set(flat[::7]) else None for x in flat]


def test_xxh64_and_groups_by_bytes(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abñ漢") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    w = Words(pa.array(texts * 2), True, LETTERS)
    assert divergence.xxh64(w, np.arange(800), 7).tolist() == [xxhash.xxh64_intdigest(t.encode(), 7) for t in texts]
    monkeypatch.setattr(divergence, "xxh64", lambda words, i, seed=0: (words.raw[words.start[i]] + np.uint64(seed)).astype(np.uint64))
    number, first = divergence.grouped(w)  # all hashes collide
    assert len(set(zip(number.tolist(), texts * 2, strict=True))) == len(set(texts)) == len(first) == number.max() + 1


# 11


def ranked(corpus, items, top):
    each = [(i, Counter(words(t)), len(words(t))) for i, t, *_ in corpus]
    n, length = sum(1 for e in each if e[2]), sum(e[2] for e in each)
    df = Counter(t for e in each for t in e[1])
    asked = {}
    for item, text, _ in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, tf, size in each:
            m = 50 + 50 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, doc) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:top])]
    return out


@pytest.mark.parametrize(("top", "shard", "at_once", "block"), [(50, 1_000_000, 8192, 200_000), (7, 300, 3, 40)])
def test_ranked_search(tables, corpus, items, monkeypatch, top, shard, at_once, block):
    """Small shards, single nodes and several passes give the same documents."""
    monkeypatch.setattr(ranking, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(ranking, "AT_ONCE", at_once)
    found = ranking.search(*tables, top=top, block_terms=block)
    assert Counter(map(tuple, found.collect())) == Counter(ranked(corpus, items, top))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_leaves_out_nodes_that_cannot_matter():
    """A document far better than the others is found without a look at most of the tree."""
    n = 4096
    doc, term, impact = np.arange(n), np.zeros(n, np.int64), np.full(n, 5)
    impact[1234] = 900
    index = ranking.DualSorted(np.arange(n) * 2, doc, term, impact, 1)
    best = ranking.Best(1)
    monkeypatch_at_once, ranking.AT_ONCE = ranking.AT_ONCE, 1
    try:
        taken = index.search(np.array([0]), np.array([3]), best)
    finally:
        ranking.AT_ONCE = monkeypatch_at_once
    assert best.id.tolist() == [2468] and best.score.tolist() == [2700] and taken < 40


def test_search_of_empty_tables(tables, none):
    assert ranking.search(none[0], tables[1]).count() == ranking.search(tables[0], none[1]).count() == 0


# 12


def audited(corpus, least, top):
    rows = [(lang or "", source or "", words(t, ALPHA)) for _, t, lang, source in corpus]
    df = Counter((lang, t) for lang, _, w in rows for t in set(w))
    out = []
    share = lambda c, total: 1 + divergence.SCALE * (c + 2) // total
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {r[0] for r in rows}:
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= least)
        count = {s: Counter() for x, s, _ in rows if x == lang}
        for x, s, w in rows:
            if x == lang:
                count[s].update(t for t in w if t in set(kept))
        total = {s: sum(c.values()) + 2 * len(kept) for s, c in count.items()}
        everywhere = sum(count.values(), Counter())
        q = {t: share(everywhere[t], sum(everywhere.values()) + 2 * len(kept)) for t in kept}
        for s in count:
            p = {t: share(count[s][t], total[s]) for t in kept}
            pairs = [(o, sum(f(p[t], share(count[o][t], total[o])) for t in kept)) for o in count if o != s]
            terms = [(t, f(p[t], q[t])) for t in kept if count[s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found[:most])]
    return out


@pytest.mark.parametrize(("least", "held", "entries"), [(10, 900_000, 200_000), (2, 50, 20), (10_000, 900_000, 200_000)])
def test_audit(tables, corpus, monkeypatch, least, held, entries):
    """Few held rows, many shards, and no kept terms at all."""
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "PASSED", held // 2)
    monkeypatch.setattr(divergence, "SHARD_ENTRIES", entries)
    found = divergence.audit(tables[0], least, 10)
    assert sorted(map(tuple, found.collect())) == sorted(audited(corpus, least, 10))


def test_audit_of_an_empty_table(none):
    assert divergence.audit(none[0]).count() == 0


def test_shares_are_exact_where_products_pass_64_bits():
    counts, total = [0, 12_345, 3 * 10**14, 9 * 10**14 - 3], 9 * 10**14 + 7
    assert divergence.share(np.array(counts), total).tolist() == [1 + divergence.SCALE * (c + 2) // total for c in counts]


# 13


def contaminated(corpus, items, window=10):
    phrases = {}
    for item, text, _ in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).add(item)
    sizes = {len(p) for p in phrases}
    out = []
    for doc, text, *_ in corpus:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in phrases:
                    hit.update(range(k, k + n))
                    found |= phrases[tuple(w[k : k + n])] - {None}
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize(("symbols", "rows", "block", "piece"), [(1_000_000, 50_000, 1_000_000, 4096), (150, 50_000, 700, 64), (1_000_000, 1, 1_000_000, 16)])
def test_decontamination(tables, corpus, items, monkeypatch, symbols, rows, block, piece):
    """Small shards, several passes and items in pieces give the same words."""
    monkeypatch.setattr(decontamination, "SHARD_SYMBOLS", symbols)
    monkeypatch.setattr(decontamination, "SHARD_ROWS", rows)
    monkeypatch.setattr(decontamination, "PIECE_WORDS", piece)
    found = decontamination.find(*tables, block_words=block)
    assert Counter(map(tuple, decontamination.digest(found).collect())) == Counter(contaminated(corpus, items))


def test_spans_are_places_in_the_text(tables, corpus):
    text = {r[0]: r[1] for r in corpus if r[0] not in (None, 0)}
    for r in decontamination.find(*tables).where("size(spans) > 0").collect():
        if r["doc_id"] in text:
            raw = text[r["doc_id"]].encode()
            for s in r["spans"]:
                assert words(raw[s["first_byte"] : s["last_byte"]].decode()) == words(text[r["doc_id"]])[s["begin"] : s["end"]]


def test_decontamination_of_empty_tables(tables, none):
    assert decontamination.find(none[0], tables[1]).count() == 0
    clean = decontamination.digest(decontamination.find(tables[0], none[1]))
    assert clean.where("contaminated").count() == 0 and clean.count() == tables[0].count()


def test_index_of_repeats():
    """Copies and runs of one word, whose suffixes are long alike."""
    rng = np.random.default_rng(3)
    base = rng.integers(1, 4, 60)
    symbols = np.concatenate([[0], base, [0], base, [0], np.ones(90, np.int64), [0], base[5:50], [0]])
    stops = np.flatnonzero(symbols == 0)
    named = symbols + len(stops)
    named[stops] = np.arange(len(stops))
    suffixes = [tuple(named[k:]) for k in range(len(symbols))]
    assert decontamination.suffix_order(symbols).tolist() == sorted(range(len(symbols)), key=suffixes.__getitem__)
    index = decontamination.FMIndex(symbols)
    for size in (1, 2, 5, 10):
        phrases = [symbols[k : k + size] for k in range(len(symbols) - size) if (symbols[k : k + size] > 0).all()]
        rows = np.zeros((len(phrases), 10), np.int64)
        for k, p in enumerate(phrases):
            rows[k, :size] = p[::-1]
        low, high = index.search(rows)
        for p, a, b in zip(phrases, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [k for k in range(len(symbols) - size + 1) if (symbols[k : k + size] == p).all()]
