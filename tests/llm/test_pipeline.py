import corpus_pipeline
from conftest_llm import FOLDER, ODD
from musterbook.llm import mixing
from test_duplicates_leaks import similar
from test_rules_mix_urls_secrets import base_of, check_mix, counts_of


def stage_results(spark, docs, folder):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], folder).cache())
    return out


def test_stages_against_brute_force(spark, real_docs):
    df, _ = real_docs
    results = stage_results(spark, df, FOLDER)
    for frame in results[1:-1]:
        assert frame.columns == df.columns
    rows = [{r.doc_id: r for r in frame.collect()} for frame in results]
    assert all(not counts_of(rows[0][i].text)[5] for i in rows[1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = [i for i, r in rows[0].items() if labels.get(i) == 1 and not counts_of(r.text)[5]]
    assert sum(i in rows[1] for i in good) >= 0.95 * len(good)
    assert set(rows[2]) == {i for i, _, c in similar([(i, r.text) for i, r in rows[1].items()]) if i == c}
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert set(rows[3]) == {i for i, r in rows[2].items() if not any(t in r.text for t in items)}
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        assert not base_of(r.text) and r.n_chars == len(r.text)
        assert (r.text == rows[3][i].text) == ("[SECRET]" not in r.text)
    docs = [(i, r.text, r.lang, r.source) for i, r in rows[4].items()]
    check_mix(mixing.mix_sources(results[4]).collect(), docs)
    assert all(r.taken > 0 for r in rows[5].values())
    assert sorted(corpus_pipeline.run(spark, FOLDER).collect()) == sorted(results[5].collect())


def test_stages_on_odd_and_empty_tables(spark, make_docs):
    for docs in (make_docs(ODD), make_docs([])):
        results = stage_results(spark, docs, FOLDER)
        assert all(r.columns == docs.columns for r in results[:-1])
        assert [r.count() for r in results][1:] == sorted([r.count() for r in results][1:], reverse=True)
