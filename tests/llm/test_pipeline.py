"""The stages in a row, each held against what it must do to planted rows of its own input."""

import random

import corpus_pipeline
from chronocore.llm import mixing
from chronocore.plans.storage import stored

R = random.Random(8)
SYLLABLES = {"en": "the and of th ing er on".split(), "de": "der die und sch ein ü ge".split()}


def text(n, lang="en"):
    return " ".join("".join(R.choices(SYLLABLES[lang], k=R.randint(2, 4))) for _ in range(n))


def table(spark, folder, rows, items):
    spark.createDataFrame([(i, t, lang, f"src{(i or 0) % 20}", len(t or ""), "x") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    clean = [(i, text(R.randint(30, 90), lang), lang) for i, lang in enumerate(["en", "de"] * 60)]
    items = [(i, text(25)) for i in range(5)] + [(9, None)]
    rows = clean + [(200, None, "en"), (201, "", "en"), (202, "12 34 !!", None)]
    rows += [(300 + i, clean[2 * i][1].upper(), "en") for i in range(10)]
    rows += [(400 + i, clean[20 + i][1] + " the", "en") for i in range(10)]
    rows += [(500 + i, f"{text(30)} {items[i][1]} {text(30)}", "en") for i in range(5)]
    rows += [(None, text(40), None), (0, clean[0][1], "en")]
    table(spark, folder, rows, items)
    docs, after = spark.read.parquet(f"{folder}/documents.parquet"), []
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder))
        after.append(docs)
    assert all(d.columns == names for d in after[:-1])
    ids = [sorted(r.doc_id for r in d.collect() if r.doc_id is not None) for d in after]
    base = [i for i in range(120) if i >= 20 or i % 2]
    assert ids[0] == sorted([0, *range(120), *range(300, 310), *range(400, 410), *range(500, 505)])
    assert ids[1] == sorted([*base, *range(300, 310), *range(400, 410), *range(500, 505)])
    assert ids[2] == sorted([*base, *range(300, 310), *range(500, 505)])
    assert ids[3] == sorted([*base, *range(300, 310)])
    assert [d.filter("doc_id is null").count() for d in after[:4]] == [1] * 4
    # Leaves hold a few documents here, and a prefix ends with a whole one.
    total = sum(len(r.text.split()) for r in after[3].collect())
    taken = sum(r.n_tokens for r in after[4].collect())
    assert 0.4 * total < taken <= total * mixing.Mix().percent / 100
    assert set(ids[4]) <= set(ids[3])
    run = corpus_pipeline.run(spark, folder)
    assert sorted(str(tuple(r)) for r in run.collect()) == sorted(str(tuple(r)) for r in after[4].collect())


def test_empty_tables(spark, tmp_path):
    table(spark, str(tmp_path), [(1, "x", "en")], [(1, "x")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)))
        assert docs.count() == 0
