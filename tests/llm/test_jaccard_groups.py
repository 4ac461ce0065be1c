"""Groups of texts that are similar to each other but not to a common least one."""

import random

import numpy as np
import pytest

from musterbook.llm import ngram_jaccard as join


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def groups(rows):
    """Least id reachable by links, by comparing all pairs."""
    sets = {k: shingles(t) for k, t in rows}
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: root(k) for k in sets}


def edited(count, words, edits, seed):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for k in range(count):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(words)] = f"x{k}y{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    return rows


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_copies_of_one_text(spark, edits):
    rows = edited(160, 120, edits, edits)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in join.similar_components(df).collect()}
    assert found == groups(rows)


def test_links_of_a_group_stay_few(spark, monkeypatch):
    """About half of all pairs are links, and the leaders of the first pass are strangers; the second pass still gets few."""
    rows = edited(300, 130, 1, 7)
    handed = []
    real = join.components

    def spy(edges, name="links"):
        handed.append((name, edges.count()))
        return real(edges, name)

    monkeypatch.setattr(join, "components", spy)
    monkeypatch.setattr(join, "first_pairs", lambda blocks: blocks.sparkSession.createDataFrame([], "a long, b long"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in join.similar_components(df).collect()}
    assert found == groups(rows) and set(found.values()) == {0}
    assert max(n for _, n in handed) <= 6 * len(rows)


def test_tiles_equal_brute_force(spark, monkeypatch):
    """Groups that are near the threshold, over several parts: candidates are no rows, and links stay as they are."""
    rows = edited(150, 120, 2, 3) + [(1000 + k, t.replace("b", "c")) for k, t in edited(90, 100, 1, 4)]
    rows += [(2000 + k, " ".join(f"d{k}w{i}" for i in range(30))) for k in range(40)]
    monkeypatch.setattr(join, "PART", 20 * join.LIGHTEST)
    monkeypatch.setattr(join, "STRIP", 64)
    seen = {}
    for name in ("tiles", "later_pairs"):
        monkeypatch.setattr(join, name, lambda *a, _real=getattr(join, name), _n=name: seen.setdefault(_n, _real(*a)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in join.similar_components(df).collect()}
    assert found == groups(rows)
    assert seen["tiles"].agg({"parts": "max"}).first()[0] > 3
    assert seen["later_pairs"].count() <= join.BUSY * len(rows)


def test_spanning_forest():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 40):
        linked = rng.random((n, n)) < 1.2 / max(n, 1)
        linked |= linked.T
        roots, nodes = join.spanning_forest(linked)
        reach = linked | np.eye(n, dtype=bool)
        for _ in range(n):
            reach = reach @ reach
        assert len(set(nodes.tolist())) == len(nodes) == n - len({tuple(r) for r in reach})
        assert all(reach[a, b] and a < b for a, b in zip(roots, nodes))
