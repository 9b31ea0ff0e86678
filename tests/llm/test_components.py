"""Components of links that are too many for one task, against disjoint sets."""

import numpy as np
import pytest

from riskloom.llm import components, vectors


def wanted(pairs):
    pairs = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    nodes = sorted({x for p in pairs for x in p})
    at = {x: k for k, x in enumerate(nodes)}
    union = components.Union(len(nodes))
    for a, b in pairs:
        union.join(at[a], at[b])
    return {x: nodes[union.root(k)] for x, k in at.items()}


def graphs():
    rng = np.random.default_rng(31)
    order = rng.permutation(400).tolist()
    yield "chain", list(zip(order, order[1:], strict=False))
    yield "greatest in the middle", [(1000, k) for k in range(300)]
    yield "least in the middle", [(-5, k) for k in range(300)] + [(None, 3), (4, None), (7, 7)]
    yield "two hubs", [(500 + k % 2, k) for k in range(200)] + [(500, 501)] * 40
    yield "pairs", [(3 * k, 3 * k + 1) for k in range(200)]
    yield "random", [(int(a), int(b)) for a, b in rng.integers(-200, 200, (260, 2))]


@pytest.mark.parametrize(("name", "pairs"), list(graphs()))
def test_more_links_than_one_task_unites(spark, tmp_path, monkeypatch, name, pairs):
    monkeypatch.setattr(components, "LEAST_SLICE", 40)
    spark.createDataFrame(pairs, "a long, b long").repartition(3).write.parquet(str(tmp_path / "links"))
    links = spark.read.parquet(str(tmp_path / "links"))
    saved, save = [], components.save
    monkeypatch.setattr(components, "save", lambda df, kind: saved.append(kind) or save(df, kind))
    got = components.components(links, few=100).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["component"] for r in got} == wanted(pairs)
    assert "edges" in saved and ("joined" in saved or name == "random")
    saved.clear()
    assert {r["node"]: r["component"] for r in components.components(links).collect()} == wanted(pairs) and saved == ["labels"]


def test_links_are_contracted_to_none(spark):
    pairs = [(k, k + 1) for k in range(12)]
    assert {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long"), few=0).collect()} == wanted(pairs)


def test_boxes_meet_level_by_level(spark, monkeypatch):
    """Intervals of four levels of gathered boxes meet as all pairs of boxes do."""
    monkeypatch.setattr(vectors, "GATHER", 3)
    rng = np.random.default_rng(4)
    low = np.sort(rng.random((70, 2)) * 4, axis=0)
    high = low + rng.random((70, 2)) * 0.2
    boxes = spark.createDataFrame([(k, low[k].tolist(), high[k].tolist()) for k in range(70)], vectors.BOX)
    got = sorted(tuple(r) for r in vectors._near(boxes, 0.1, 70).collect())
    near = [(i, j) for i in range(70) for j in range(i, 70) if not vectors.far(low[i], high[i], low[j], high[j], 0.1)]
    assert got == near and 70 < len(near) < 1500
