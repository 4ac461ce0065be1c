"""The divergence audit against a plain model, on odd, tied and empty input."""

import re
from collections import Counter, defaultdict

import pytest

from conftest_llm import LONG, ODD
from musterbook.llm import source_divergence as audit

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def model(rows, least=3, top=200):
    """Rows of (text, lang, source)."""
    held, groups = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [lower(w) for w in WORD.findall(text or "")]
        groups[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = sorted(w for w, d in held[lang].items() if d >= least)
        own = {s: {w: c[w] for w in kept} for (g, s), c in groups.items() if g == lang}
        whole = {w: sum(c[w] for c in own.values()) for w in kept}

        def shares(counts):
            total = sum(counts.values()) + len(kept)
            return {w: 1 + 1_000_000_000 * (counts[w] + 1) // total for w in kept}

        p, q = shares(own[source]), shares(whole)
        pairs = []
        for other in own:
            if other != source:
                r = shares(own[other])
                pairs.append((-sum((p[w] - r[w]) ** 2 // r[w] for w in kept), other.encode()))
        terms = [(-((p[w] - q[w]) ** 2 // q[w]), w.encode()) for w in kept if own[source][w] and p[w] > q[w]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_words_as_defined():
    table = audit.letters()
    for text in ("Ab-Cd_e", "Äb é\U0001f600x[y]", "\x7f\x00a"):
        raw = bytes(table[list(text.encode())]) if text else b""
        assert raw.decode().split(" ") and [w for w in raw.decode().split(" ") if w] == [lower(w) for w in WORD.findall(text)]


def test_odd_rows(make_docs):
    rows = []
    for n, (doc_id, text) in enumerate([r for r in ODD if r[1] is not LONG] * 3):
        rows.append((doc_id, text, [None, "", "en"][n % 3], ["s", None, "", "t"][n % 4]))
    rows += [(100 + k, "One tied pair two Two été", "xx", s) for k, s in enumerate("abab")]
    rows += [(200, None, "zz", "a"), (201, "once", "zz", "b"), (300, LONG, "en", "t"), (301, LONG, "en", "s")]
    found = rows_of(audit.audit(make_docs(rows)))
    assert found == model([r[1:] for r in rows])
    # A language without kept terms still lists its pairs.
    assert [r for r in found if r[0] == "zz"] == [("zz", "a", "pair", "b", 0, 1), ("zz", "b", "pair", "a", 0, 1)]


@pytest.mark.parametrize("top", [1, 3, 7])
def test_cut_within_ties(make_docs, top):
    """Cells of one value are merged; the cut goes through the middle of one."""
    rows = [(k, " ".join(f"w{chr(97 + i)}" for i in range(12) if (i + k) % 4), "en", "ab"[k % 2]) for k in range(12)]
    rows += [(90 + k, "same same other", "en", "c") for k in range(3)]
    assert rows_of(audit.audit(make_docs(rows), top=top)) == model([r[1:] for r in rows], top=top)


def test_real_documents(real_docs):
    df, rows = real_docs
    assert rows_of(audit.audit(df)) == model([r[1:] for r in rows])


def test_no_documents(make_docs):
    assert rows_of(audit.audit(make_docs([]))) == []


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(3 * 10**12, 10**13, 70_000)], "n long, total long, v long")
    got = row.select(audit.share(F.col("n"), F.col("total"), F.col("v"))).first()[0]
    assert got == 1 + 1_000_000_000 * (3 * 10**12 + 1) // (10**13 + 70_000)
