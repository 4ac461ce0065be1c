import collections
import hashlib
import random
import re

import corpus_pipeline
import numpy as np
from conftest_llm import FOLDER, LONG, ODD
from musterbook.llm import decontamination, ngram_jaccard, suffix_dedup
from musterbook.llm.components import components
from pyspark.sql import functions as F


def dedup(docs, size=50):
    """Expected (bytes, removed, spans, digest) by looking up every string."""
    last = 2**63 - 1
    docs = [(last if i is None else i, (t or "").encode()) for i, t, *_ in docs]
    first = {}
    for i, b in docs:
        for k in range(len(b) - size + 1):
            first[b[k : k + size]] = min(first.get(b[k : k + size], last), i)
    out = collections.Counter()
    for i, b in docs:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < i:
                gone[k : k + size] = b"\1" * size
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[(None if i == last else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def removed(df):
    return collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def repeats_corpus():
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("ab é\n\0") for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 60, 200)]
    docs = [(i, text(rng.randint(0, 80)) + rng.choice(shared) + text(rng.randint(0, 80)) + rng.choice(shared)) for i in range(60)]
    docs += [(100, "xy" * 400), (101, "q" + "xy" * 300), (102, "xy" * 24), (103, "xy" * 25), (104, shared[4]), (105, shared[4])]
    docs += [(106, "a" * 300), (107, "b" + "a" * 100 + "b"), (108, shared[4][:120] + shared[4][60:])]
    return docs


def test_dedup(make_docs, real_docs):
    df, docs = real_docs
    assert removed(suffix_dedup.remove_repeats(df)) == dedup(docs)
    docs = repeats_corpus()
    assert removed(suffix_dedup.remove_repeats(make_docs(docs).repartition(3))) == dedup(docs)
    odd = [d for d in ODD if d[1] != LONG] + [(30, LONG), (31, LONG[5000:9000]), (31, LONG[100:400]), (None, LONG[:300])]
    assert removed(suffix_dedup.remove_repeats(make_docs(odd))) == dedup(odd)
    assert suffix_dedup.remove_repeats(make_docs([])).collect() == []


def test_dedup_sends_one_row_of_a_piece_to_a_task(make_docs, monkeypatch):
    docs = make_docs(repeats_corpus()).repartition(3)
    tasks, frame = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), type(docs)
    sent, dealt = [], {name: getattr(frame, name) for name in ("repartition", "repartitionById")}
    for name in dealt:
        monkeypatch.setattr(frame, name, lambda self, *a, name=name: sent.append((self, a[0])) or dealt[name](self, *a))
    suffix_dedup.remove_repeats(docs)
    assert [n for _, n in sent] == [suffix_dedup.BLOCKS * tasks] * 2
    for packed, n in sent:
        # The texts of a partition are one piece here; each of its rows goes to another task.
        rows = packed.select(F.spark_partition_id().alias("p"), "bucket").collect()
        assert rows and len(set(rows)) == len(rows) and all(0 <= r.bucket < n for r in rows)
        assert max(collections.Counter(r.p for r in rows).values()) <= 2 * tasks


def test_united_spans_of_documents():
    rng = np.random.default_rng(5)
    for n, hashes in ((0, 1), (1, 1), (400, 30), (400, 2)):
        # Documents differ in id or in hash; one hash may stand for two ids.
        ids, fps = rng.integers(0, 3, n), rng.integers(-hashes, hashes, n) * 2**56
        start, length, first = rng.integers(0, 2000, n), rng.integers(50, 90, n), rng.integers(0, 9, n)
        expected = collections.defaultdict(lambda: (set(), {}))
        for i, f, s, k, least in zip(*(c.tolist() for c in (ids, fps, start, length, first))):
            # Edges, so spans that touch are one.
            expected[i, f][0].update(range(s, s + k))
            expected[i, f][1][s] = min(least, expected[i, f][1].get(s, least))
        want = set()
        for (i, f), (places, leasts) in expected.items():
            for head in sorted(x for x in places if x - 1 not in places):
                end = next(x for x in range(head, 4000) if x not in places)
                want.add((i, f, head, end - head, min(v for s, v in leasts.items() if head <= s < end)))
        got = suffix_dedup._united([ids, fps, start, length, first])
        assert collections.Counter(zip(*(c.tolist() for c in got))) == collections.Counter(want)


def test_tree_intervals():
    words = sorted(s[k:] for s in ["banana", "bandana"] for k in range(len(s)))
    common = np.array([next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(words, words[1:])])
    got = {(d, a, b) for d, a, b in suffix_dedup.tree_intervals(common, 1)}
    want = set()
    for a in range(len(words)):
        for b in range(a + 1, len(words)):
            d = common[a:b].min()
            if d >= 1 and (a == 0 or common[a - 1] < d) and (b == len(words) - 1 or common[b] < d):
                want.add((int(d), a, b))
    assert got == want


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def similar(docs):
    last = 2**63 - 1
    rows = [(last if i is None else i, shingles(t)) for i, t, *_ in docs]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            both = len(a & b)
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    null = lambda x: None if x == last else x
    return collections.Counter((null(i), len(s), null(find(i))) for i, s in rows)


def linked(df):
    return collections.Counter(tuple(r) for r in df.collect())


def near_copies():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(100)]
    docs = []
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(100)] = rng.choice(words)
        docs.append((i, " ".join(copy)))
    passage = " ".join(rng.choice(words) for _ in range(30))
    docs += [(50 + i, " ".join([rng.choice(words) for _ in range(rng.randint(5, 60))] + [passage])) for i in range(40)]
    edge = [f"e{k}" for k in range(49)]
    docs += [(100, " ".join(edge[:45])), (101, " ".join(edge[:40])), (102, " ".join(edge)), (103, "A b\tC"), (104, "a B c"), (105, "a b")]
    return docs


def test_jaccard(make_docs, real_docs):
    df, docs = real_docs
    assert linked(ngram_jaccard.similar_components(df)) == similar(docs)
    docs = near_copies()
    assert linked(ngram_jaccard.similar_components(make_docs(docs).repartition(5))) == similar(docs)
    assert linked(ngram_jaccard.similar_components(make_docs(ODD))) == similar(ODD)
    assert ngram_jaccard.similar_components(make_docs([])).collect() == []


def test_one_per_component(make_docs):
    docs = near_copies() + [(4, None), (4, "other words that stand alone here"), (None, None), (None, "w")]
    kept = ngram_jaccard.one_per_component(make_docs(docs))
    assert kept.columns == make_docs(docs).columns
    want = {i for (i, _, c) in similar(docs) if i == c}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)


def test_rows_without_an_id_or_with_a_repeated_one_are_kept(spark, make_docs):
    texts = [" ".join(f"t{k}w{n}" for n in range(30)) for k in range(6)]
    docs = [(4, None), (4, texts[0]), (4, texts[1]), (4, texts[1] + " more"), (None, texts[2]), (None, texts[3]), (None, "")]
    docs += [(9, texts[2]), (8, texts[2] + " more"), (None, texts[4]), (None, texts[4]), (5, texts[5]), (5, texts[5])]
    kept = corpus_pipeline.near_duplicates(spark, make_docs(docs), FOLDER)
    assert kept.columns == make_docs(docs).columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    for t in (texts[1], texts[1] + " more"):
        if got.pop((4, t), 0):
            got["either"] += 1
    want = [(4, None), (4, texts[0]), "either", (8, texts[2] + " more"), (None, texts[3]), (None, ""), (None, texts[4]), (5, texts[5])]
    assert got == collections.Counter(want)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_leaks_of_real_tables(spark, real_docs):
    df, docs = real_docs
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    want = {(d[0], r.item_id) for d in docs for r in items.collect() if r.text in (d[1] or "")}
    got = decontamination.leaks(df, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    clean = {r.doc_id for r in decontamination.without_leaks(df, items).collect()}
    assert clean == {d[0] for d in docs} - {i for i, _ in want}


def edits(p, t):
    """Least edits of ``p`` against any part of ``t``."""
    row = np.zeros(len(t) + 1, int)
    for i, c in enumerate(p, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + np.array([c != x for x in t]))
        row = np.concatenate([[i], new])
        row = np.minimum.accumulate(row - np.arange(len(t) + 1)) + np.arange(len(t) + 1)
    return int(row.min())


def test_leaks_within_the_budget(spark, make_docs):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    items = [(k, text(rng.choice([40, 80, 96]))) for k in range(12)]
    docs = []
    for i in range(120):
        k, item = rng.choice(items)
        part = list(item)
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice([[], [rng.choice("xyz")], [part[at], "x"]])
        docs.append((i, text(rng.randint(0, 50)) + "".join(part) + text(rng.randint(0, 50))))
    docs += [(200, None), (201, ""), (201, ""), (None, items[0][1].upper()), (202, LONG), (203, items[1][1].replace(" ", "\n"))]
    benchmark = spark.createDataFrame([*items, (90, None), (91, "short"), (0, items[0][1])], "item_id long, text string")
    fold = str.maketrans("\n\t", "  ")
    want = set()
    for i, t in docs:
        for k, item in items:
            if t and len(t) < 10_000 and edits(item, t.lower().translate(fold)) <= int(decontamination.RATE * len(item)):
                want.add((i, k))
    got = decontamination.leaks(make_docs(docs), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 30
    kept = decontamination.without_leaks(make_docs(docs), benchmark)
    assert kept.columns == make_docs(docs).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(make_docs(docs), none).collect() == []
    assert decontamination.without_leaks(make_docs(docs), none).count() == len(docs)
    assert decontamination.leaks(make_docs([]), benchmark).collect() == []


def test_leaks_of_runs_at_every_offset_and_short_items(spark, make_docs):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate((64, 100, 230, 301))] + [(10, text(10)), (11, text(19)), (12, text(31))]
    size = decontamination.RUN
    runs = [(k, t[at : at + size]) for k, t in items for at in range(len(t) - size + 1)]
    runs += [(k, t) for k, t in items[4:]]
    docs = [(i, text(30) + "XYZ" + run + "XYZ" + text(30)) for i, (_, run) in enumerate(runs)]
    docs += [(len(runs), text(500)), (len(runs) + 1, items[3][1][100:120] + "XYZ" + items[3][1][120:140])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(make_docs(docs), benchmark).collect()}
    assert set(got) == {(i, k) for i, (k, _) in enumerate(runs)}
    assert all(r.start_byte <= 33 and r.end_byte >= 33 + len(runs[i][1]) and r.edits == 0 for (i, _), r in got.items())
    kept = {r.doc_id for r in decontamination.without_leaks(make_docs(docs), benchmark).collect()}
    assert kept == {len(runs), len(runs) + 1}


def test_benchmark_blocks(spark):
    items = spark.createDataFrame([(k, "x" * 100) for k in range(10)], "item_id long, text string")
    blocks = list(decontamination.benchmark_blocks(items, size=250))
    assert sorted(len(b) for b in blocks) == [2] * 5
