"""Hard negatives against all scores, on odd, tied and large vectors."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from musterbook.llm import hard_negatives as mining

SCHEMA = "vec_id long, embedding array<double>, label int, row string, home string, norm string, score string"


def model(rows, every=100):
    """Rows of (vec_id, embedding, label)."""
    known = []
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * x) for x in vector]
        if sum(float(x) * x for x in whole) < 2.0**62:
            known.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, whole))
    out = []
    for i, (anchor, label, own) in enumerate(known):
        if anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(own, q)), v, k == label) for j, (v, k, q) in enumerate(known) if j != i]
        for minus, positive, _ in sorted(s for s in scored if s[2])[:5]:
            fits = sorted(s for s in scored if not s[2] and 80 * -minus <= 100 * -s[0] <= 100 * -minus)
            out += [(anchor, positive, rank, v, -minus, -m) for rank, (m, v, _) in enumerate(fits[:5], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "r", "h", "n", "s") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in mining.hard_negatives(df, **options).collect())


def clustered(count, width, seed, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [
        (k, (centres[k % 6] + spread * rng.normal(size=width)).tolist(), int(rng.integers(10)) if k % 3 else k % 6) for k in range(count)
    ]


def test_clusters_with_ties_and_copies(spark):
    rows = clustered(900, 8, 1)
    rows += [(k + 1000, rows[k % 40][1], k % 4) for k in range(260)]
    assert mined(spark, rows, every=20) == model(rows, 20)


def test_odd_rows(spark):
    rng = random.Random(5)
    good = [(k, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)], rng.randrange(3)) for k in range(-210, 210)]
    odd = [
        (None, [1.0, 1.0, 1.0], 1), (1000, None, 1), (1100, [1.0, None], 1), (1200, [float("nan")], 1), (1300, [float("inf"), 1.0], 1),
        (1400, [1.0, 1.0, 1.0], None), (1500, [], 1), (1600, [1.0], 1), (1700, [1e300, 1.0], 1), (1800, [-1e7, 2.0, 1e7], 2), (1801, [-1e7, 2.0, 1e7], 2),
        (1802, [-9e6, 2.0, 1e7], 1), (0, [1.0, 1.0, 1.0], 1), (0, [1.0, 1.0, 1.0], 1), (1900, [0.0, 0.0, 0.0], 2), (1901, [0.0], 0),
    ]
    assert mined(spark, good + odd) == model(good + odd)


def test_empty_and_alone(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(100, None, 1), (200, [float("nan")], 1)]) == []


def test_chunks_of_anchors_change_nothing(spark):
    rows = clustered(400, 5, 2)
    assert mined(spark, rows, every=10, chunk_bytes=2000) == mined(spark, rows, every=10) == model(rows, 10)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([2, 3, 7]), st.sampled_from([0.0, 0.05, 0.6]), st.sampled_from([1, 300, 10**6]))
def test_bounds_lose_nothing(seed, width, spread, size):
    """A search with references equals one over all rows, whatever the order of blocks."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, width)) * size
    vectors = np.round(centres[rng.integers(3, size=90)] + spread * size * rng.normal(size=(90, width))).astype(np.int32)
    norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
    directions = mining.references(vectors, 4)
    angles = mining.angles_to(vectors.astype(float), norms, directions)
    label, ids = rng.integers(3, size=90), rng.permutation(90)
    home, near = angles.argmin(1) if angles.size else np.zeros(90, int), angles.min(1) if angles.size else np.zeros(90)
    whole = {"vec_id": ids, "label": label, "row": np.arange(90), "home": home, "angle": near, "norm": norms, "vector": vectors}
    anchors = {k: v[:20] for k, v in whole.items()} | {"angles": angles[:20]}
    score = vectors[:20].astype(np.int64) @ vectors.T.astype(np.int64)
    low = np.stack([np.quantile(score, 0.6, axis=1), np.quantile(score, 0.9, axis=1)], 1).astype(np.int64)
    state = mining.Search(anchors, low, low + size * size, False, 3)
    for home_ in rng.permutation(np.unique(home)):
        own = np.flatnonzero(home == home_)
        own = own[np.lexsort((own, near[own]))]
        for part in np.array_split(own, 3):
            if len(part):
                state.add({k: v[part] for k, v in whole.items()} | {"low": angles[part].min(0), "high": angles[part].max(0)})
    for a in range(20):
        for k in range(2):
            fits = [(-score[a, j], ids[j]) for j in range(90) if label[j] != label[a] and low[a, k] <= score[a, j] <= low[a, k] + size * size]
            want = sorted((int(m), int(v)) for m, v in fits)[:3]
            got = [(-int(s), int(v)) for s, v in zip(state.score[a, k], state.vec_id[a, k]) if s != mining.NONE]
            assert got == want


def test_far_blocks_are_not_scored():
    """Tight clusters: blocks of another cluster are skipped once an anchor's window is narrow."""
    rng = np.random.default_rng(0)
    centres = np.eye(8) * 4000
    vectors = np.concatenate([c + rng.integers(-60, 60, (200, 8)) for c in centres]).astype(np.int32)
    norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
    angles = mining.angles_to(vectors.astype(float), norms, mining.references(vectors, 8))
    home = angles.argmin(1)
    whole = {"vec_id": np.arange(1600), "label": np.ones(1600, int), "row": np.arange(1600), "home": home, "angle": angles.min(1), "norm": norms, "vector": vectors}
    anchors = {k: v[::100] for k, v in whole.items()} | {"angles": angles[::100]}
    state = mining.Search(anchors, np.full((16, 1), 14_000_000), np.full((16, 1), 10**12), True, 5)
    for h in range(8):
        own = np.flatnonzero(home == h)
        own = own[np.argsort(angles.min(1)[own])]
        state.add({k: v[own] for k, v in whole.items()} | {"low": angles[own].min(0), "high": angles[own].max(0)})
    assert 0 < state.scored <= 16 * 1600 / 4


@pytest.mark.parametrize("kind", [np.int32])
def test_integer_path_is_exact(kind):
    """Products beyond 2^53 are taken in 64-bit integers."""
    vectors = np.array([[2**30 + 1, 3], [2**30 + 2, 5], [2**30 + 1, 4]], kind)
    norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
    whole = {"vec_id": np.arange(3), "label": np.ones(3, int), "row": np.arange(3), "home": np.zeros(3, int), "angle": np.zeros(3), "norm": norms, "vector": vectors}
    anchors = {k: v[:1] for k, v in whole.items()} | {"angles": np.zeros((1, 0))}
    state = mining.Search(anchors, np.full((1, 1), mining.NONE + 1), np.full((1, 1), np.iinfo(np.int64).max), True, 2)
    state.add(whole | {"low": np.zeros(0), "high": np.zeros(0)})
    assert state.score[0, 0].tolist() == [(2**30 + 1) * (2**30 + 2) + 15, (2**30 + 1) ** 2 + 12]
