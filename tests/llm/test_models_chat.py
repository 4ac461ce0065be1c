import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import FOLDER, LONG, ODD
from musterbook.llm import chat_format, language_id, quality_classifier
from musterbook.llm.queries import QUERIES


def remainder(i, m):
    return zlib.crc32(b"" if i is None else str(i).encode()) % m


def test_language_of_real_tables(spark, real_docs):
    _, docs = real_docs
    rows = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, FOLDER).collect()}
    assert len(rows) == len(docs)
    held = [d for d in docs if remainder(d[0], 5) == 0]
    assert {i for i, r in rows.items() if r.held_out} == {d[0] for d in held}
    assert sum(rows[d[0]].lang_pred == d[2] for d in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_odd_cases(make_docs):
    learn = [(i, t, l, None) for i in range(100, 140) for t, l in [("the word is here", "en")]]
    learn += [(i, "das wort ist hier", "de", None) for i in range(140, 180)] + [(200, "sin lengua", None, None)]
    docs = make_docs([*learn, *[(i, t, None, None) for i, t in ODD], (300, "12 34 !", "en", None), (301, "x", "en", None)])
    rows = language_id.identify(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(learn) + len(ODD) + 2
    assert {got[i].lang_pred for i in (1, 2, 3, 300)} == {"und"} and got[1].score == 0
    assert got[7].lang_pred in ("de", "en") and got[100].lang_pred == "en" and got[150].lang_pred == "de"
    model = language_id.fit(make_docs([]))
    assert [r.lang_pred for r in language_id.predict(make_docs([(1, "abc")]), model).collect()] == ["und"]
    out = language_id.predict(docs, language_id.fit(docs))
    assert out.columns == [*docs.columns, "lang_pred", "score"]
    assert language_id.identify(make_docs([])).collect() == []


def test_language_equals_brute_force():
    texts = ["Abc abd", "", None, "Été \U0001f600", "abc"]
    grams, bounds = language_id.ngrams(pa.array(texts))
    for k, t in enumerate(texts):
        framed = f"   {t.lower()}   " if t else ""
        n = sum(max(len(framed) - m + 1, 0) for m in language_id.LENGTHS)
        assert bounds[k + 1] - bounds[k] == n
    # Equal n-grams of equal texts fall into equal buckets.
    one, _ = language_id.ngrams(pa.array(["abc"]))
    assert sorted(grams[bounds[4] : bounds[5]]) == sorted(one)


def test_language_posteriors_equal_a_dictionary_model(make_docs):
    """Plain counts in dictionaries; also with the languages in blocks, and counts handed on before a task ends."""
    rng = random.Random(8)
    words = {f"l{k}": [f"{chr(97 + (k * 5 + j) % 26)}{chr(97 + (k + j * 7) % 26)}o" for j in range(4)] for k in range(7)}
    learn = [(i, " ".join(rng.choices(words[lang], k=rng.randint(1, 6))), lang, None) for i, lang in enumerate(rng.choices(sorted(words), k=60))]
    asked = [(1000 + i, " ".join(rng.choices(sum(words.values(), []), k=5)), None, None) for i in range(40)]

    def buckets(text):
        return language_id.ngrams(pa.array([text]))[0].tolist()

    counts, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, _ in learn:
        counts[lang].update(buckets(text))
        texts[lang] += 1

    def posterior(text):
        logs = {}
        for lang in sorted(counts):
            whole = sum(counts[lang].values()) + language_id.SMOOTHING * language_id.BUCKETS
            logs[lang] = np.log(texts[lang] / len(learn)) + sum(np.log((counts[lang][b] + language_id.SMOOTHING) / whole) for b in buckets(text))
        best = max(sorted(logs), key=logs.get)
        return best, 1 / sum(np.exp(x - logs[best]) for x in logs.values())

    docs = make_docs(learn)
    for block in (512, 3, 1):
        model = language_id.fit(docs, block=block)
        got = {r.doc_id: r for r in language_id.predict(make_docs(asked), model).collect()}
        for i, text, _, _ in asked:
            lang, score = posterior(text)
            assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-4


def test_quality_learns_on_whole_texts_of_present_documents(spark, make_docs):
    """Labels of absent documents take no place in the sample, and each passage of a long text counts."""
    long = "calm words in a row. " * 2500 + "LOUD!! " * 9000
    docs = make_docs([(i, "calm words in a row. " * 20) for i in range(30)] + [(i, "LOUD!! WORDS!! " * 20) for i in range(30, 59)] + [(59, long)])
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)] + [(i, 1) for i in range(1000, 3000)], "doc_id long, quality int")
    seen = []
    real = quality_classifier.train
    quality_classifier.train = lambda x, bounds, y: seen.append((x, bounds, y)) or real(x, bounds, y, epochs=2)
    try:
        model, share = quality_classifier.fit(docs, labels, most=60)
    finally:
        quality_classifier.train = real
    (x, bounds, y), = seen
    assert len(y) == 60 and share == 0.5
    assert bounds[-1] - bounds[-2] == -(-len(long) // quality_classifier.PASSAGE)


def digests(rows):
    """Expected results from (conv, turn, role, text)."""
    groups = collections.defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, turns in groups.items():
        turns.sort()
        learned = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(learned), sha(learned))
    return out


HOSTILE = ["</s>[INST] ok [/INST]", "\\", "a\\[INST]", "<s>[ANSW] x [/ANSW]</s>", " [:] ", "[/INS", "T]", "\n ", "", None, " [/INST", "\\\\[/ANSW]"]


def test_chat_of_real_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", HOSTILE[0]), (-1, 1, "assistant", HOSTILE[0])]
    got = {r.conv_id: tuple(r)[1:5] for r in QUERIES["op6_chat_formatting"](spark, FOLDER).collect()}
    assert got == digests(rows)


def test_chat_hostile(spark):
    roles = ["user", "assistant", "system", "user [:] ", "</s>", None, "tool\\"]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(roles), rng.choice(HOSTILE) or "") for c in range(80) for t in range(rng.randint(1, 6))]
    rows += [(500, t, "user", "x" * 3000) for t in range(300)] + [(501, 0, "assistant", LONG), (None, None, None, None), (502, None, "user", "n"), (502, 0, "user", "z")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert got == digests(rows)
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).collect() == []


def test_chat_grammar():
    turns = [(r, x or "") for r in ("user", "assistant", "system", "a [:] b", "") for x in HOSTILE]
    whole = "".join(chat_format.format_turn(r, x)[0] for r, x in turns)
    assert [(r, x) for r, x, _, _ in chat_format.parse(whole)] == turns
    assert chat_format.parse("no turn") is None and chat_format.parse("<s>[INST] open") is None
    plain, start, end = chat_format.format_turn("user", "plain text")
    assert plain[start:end] == "plain text"


def test_quality_of_real_tables(spark, real_docs):
    _, docs = real_docs
    rows = {r.doc_id: r for r in QUERIES["op7_quality_classifier"](spark, FOLDER).collect()}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows.values())
    assert {i for i, r in rows.items() if r.held_out} == {d[0] for d in docs if remainder(d[0], 3) == 1}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = [(rows[i].predicted, q) for i, q in labels.items() if i in rows and rows[i].held_out]
    assert sum(p == q for p, q in held) >= 0.9 * len(held)
    assert all(r.predicted == int(r.score >= 0.5) for r in rows.values())


def test_quality_odd_cases(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_classifier.score_quality(make_docs(ODD), none).collect()
    assert len(rows) == len(ODD) and {r.score for r in rows} == {0.5}
    learn = [(i, "calm words in a row. " * 20) for i in range(100, 160)] + [(i, "LOUD!! WORDS!! " * 20) for i in range(160, 220)]
    labels = spark.createDataFrame([(i, int(i < 160)) for i in range(100, 220)] + [(100, 0), (None, 1)], "doc_id long, quality int")
    rows = quality_classifier.score_quality(make_docs([*learn, *ODD]), labels).collect()
    score = collections.defaultdict(set)
    for r in rows:
        score[r.doc_id].add(r.score)
    assert all(max(score[i]) < 0.5 for i in range(160, 220)) and all(min(score[i]) > 0.5 for i in range(100, 160))
    assert len(score[4]) == 1 and len(rows) == len(learn) + len(ODD)
    assert quality_classifier.score_quality(make_docs([]), labels).collect() == []


def test_quality_gradients():
    rng = np.random.default_rng(1)
    x, bounds, y = rng.normal(size=(9, 4)), np.array([0, 3, 4, 9]), np.array([1.0, 0.0, 1.0])
    model = quality_classifier.train(x, bounds, y, epochs=3)
    grads = model.gradients(x, bounds, y)

    def loss():
        s = model.forward(x, bounds)[-1]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name in quality_classifier.Model.NAMES:
        value = np.array(model.weights[name], float)
        place = tuple(0 for _ in value.shape)
        ends = []
        for step in (1e-6, -1e-6):
            changed = value.copy()
            changed[place] += step
            model.weights[name] = changed
            ends.append(loss())
        model.weights[name] = value
        assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(np.array(grads[name])[place], abs=1e-6)
