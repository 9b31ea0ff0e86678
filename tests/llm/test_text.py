import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from riskloom.llm.components import Union, forest
from riskloom.llm.text import Words, grams, slices, starts_in

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\né \u0085\x1c", max_size=40)), min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words(rows):
    w = Words(pa.array([None if x is None else x.encode() for x in rows], pa.binary()))
    want = [WORD.findall(x or "") for x in rows]
    assert w.counts.tolist() == [len(x) for x in want]
    flat = [x.encode() for row in want for x in row]
    assert [w.raw[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)] == flat
    names = {}
    for word, h in zip(flat, w.hashes().tolist(), strict=True):
        assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


def test_grams_name_sequences():
    w = Words(pa.array([b"a b c d e f a b c d e", None, b"b c d e f"], pa.binary()))
    for n in (1, 2, 3, 4, 5, 7):
        g = grams(w.hashes(), n)
        at = starts_in(w.first, n)
        words = [w.raw[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
        seen = {}
        for i in at.tolist():
            assert seen.setdefault(tuple(words[i : i + n]), g[i]) == g[i]
        assert len(set(seen.values())) == len(seen)


def test_slices_keep_rows():
    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * k for k in range(50)], pa.binary())], ["text"])
    parts = list(slices(iter([batch]), "text", 100))
    assert len(parts) > 5 and [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_long_word():
    w = Words(pa.array([b"x" * 5000, b"x" * 4999 + b"y"], pa.binary()))
    assert len(set(w.hashes().tolist())) == 2


def test_forest_holds_groups_together():
    nodes, roots = np.arange(500), np.repeat([0, 200], [200, 300])
    a, b = forest(nodes, roots)
    u = Union(500)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u.join(x, y)
    assert (u.roots() == roots).all() and len(a) == 498
    assert np.bincount(np.concatenate([a, b])).max() <= 33


def test_workers_let_go_of_the_tokenizer(spark):
    """Tasks of another operator do not carry the tables of packing in their workers; pipeline stages bound their batches."""
    import corpus_pipeline
    from riskloom.llm import packing, quality

    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(40)], "doc_id long, text string").repartition(4).persist()

    def held(batches):
        import sys

        for b in batches:
            yield pa.RecordBatch.from_pydict({"held": ["_riskloom_chunk_ids" in sys.modules] * b.num_rows})

    look = lambda: {r[0] for r in docs.mapInArrow(held, "held boolean").collect()}
    packing.pieces(docs, packing.default_tokenizer()).count()
    packing.pieces(docs, packing.default_tokenizer()).collect()
    assert True in look()
    quality.feature_rows(docs, "doc_id").collect()
    assert look() == {False}
    corpus_pipeline._begin(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == corpus_pipeline.BATCH_BYTES
