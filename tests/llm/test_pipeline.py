"""The pipeline's stages against plain versions on their own inputs."""

from collections import Counter

import corpus_pipeline
from rasterloom.llm import language_id, quality

from .test_operators import DATA, ODD, ROWS, brute_components, brute_measures, brute_targets, texts_of, words


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    (_, good), (_, lang), (_, near), (_, mixed), (_, packed) = corpus_pipeline.STAGES
    first = good(spark, docs, DATA).cache()
    model = quality.train(spark, docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    kept = {r.doc_id for r in quality.score(docs, model).where("kept").collect()}
    assert {r.doc_id for r in first.collect()} == kept and first.columns == columns
    for _, t in texts_of(first):
        n, _, _, _, repeated = brute_measures(t)
        assert n >= 50 and 100 * repeated <= 50 * n
    second = lang(spark, first, DATA).cache()
    learned = language_id.train(first, language_id.in_training())
    tools = learned.compressors()
    want = {i for i, t in texts_of(first) if learned.classify(t, tools)[1] >= language_id.LEAST_MARGIN}
    assert {r.doc_id for r in second.collect()} == want and second.columns == columns
    third = near(spark, second, DATA).cache()
    assert {r.doc_id for r in third.collect()} == {i for i, (_, c) in brute_components(texts_of(second)).items() if i == c}
    assert third.columns == columns
    fourth = mixed(spark, third, DATA).cache()
    assert fourth.columns == columns
    sizes = Counter()
    for r in third.collect():
        sizes[r.source] += len(words(r.text))
    taken = Counter()
    for r in fourth.collect():
        taken[r.source] += len(words(r.text))
    largest = max(len(words(t)) for _, t in texts_of(third))
    assert all(abs(taken[s] - t) <= largest for s, t in brute_targets(sizes).items())
    assert max(Counter(r.doc_id for r in fourth.collect()).values()) <= 3
    last = packed(spark, fourth, DATA)
    assert last.count() == fourth.count()


def test_run_and_odd_tables(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    for rows in ([], ROWS):
        docs = spark.createDataFrame(rows, ODD)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, DATA).columns == docs.columns, name
            stage(spark, docs, DATA).collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == len(rows)


def test_rows_without_id_stay_in_the_join(spark):
    text = "one two three four five six seven"
    rows = [(None, text, None, "a"), (None, text, None, "a"), (2, text, None, "a"), (1, text, None, "b"), (3, None, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    near = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    assert sorted((r.doc_id or 0) for r in near(spark, docs, DATA).collect()) == [0, 0, 1, 3]


def test_other_texts_of_one_id_stay(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(3, a, "x", "s"), (5, a, "x", "s"), (5, b, "x", "s"), (5, b, "x", "s"), (6, "", "x", "s"), (6, None, "x", "s"), (6, None, "x", "s"), (7, b + " fourteen more words that are of no one else", "x", "s")]
    near = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for parts in (1, 3, 7):
        got = sorted((r.doc_id, str(r.text)) for r in near(spark, docs.repartition(parts), DATA).collect())
        assert got == [(3, a), (5, b), (6, ""), (6, "None"), (7, rows[-1][1])]


def test_reruns_agree(spark):
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(corpus_pipeline.run(spark, DATA)) == key(corpus_pipeline.run(spark, DATA))
