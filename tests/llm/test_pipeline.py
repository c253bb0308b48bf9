"""The pipeline against what its stages should do, on a small folder of tables."""

import random

import corpus_pipeline
from codeloom.llm import common


def test_pipeline(spark, tmp_path):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    text = lambda n=40: " ".join(r.choice(words) for _ in range(n))
    texts = [text() + (" grumbot snarfle" if i % 5 == 0 else "") for i in range(200)]
    leak = text(12)
    texts += [texts[1], texts[1], text(20) + " " + leak, None]
    boiler = "All rights reserved by nobody"
    texts = [t and (f"{t}\n{boiler}" if i % 3 == 0 else t) for i, t in enumerate(texts)]
    texts[200] = texts[201] = texts[1]
    spark.createDataFrame([(i, t, "en", f"src{i % 40}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs = corpus_pipeline.materialize(docs, "test")
        seen[name] = {x.doc_id: x.text for x in docs.collect()}
    toxic = {i for i in range(200) if i % 5 == 0}
    assert set(seen["toxicity"]) == set(range(204)) - toxic
    first = min(i for i in seen["toxicity"] if i % 3 == 0)
    assert all((boiler in (t or "")) == (i == first) for i, t in seen["line_dedup"].items())
    assert set(seen["near_dedup"]) == set(seen["line_dedup"]) - {200, 201}
    assert set(seen["decontamination"]) == set(seen["near_dedup"]) - {202}
    before = common.tables()
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert len(common.tables() - before) == 1  # only the result's own table is left
    out = result.collect()
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").count() == len(texts)
    assert {x.doc_id for x in out} == set(seen["decontamination"]) and all(len(x.ids) == x.n_tokens for x in out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_boilerplate_goes_whatever_its_share(spark):
    short = [f"All rights reserved, whoever reads this.\nown {i}" for i in range(12)]
    copied = "Home | News\nContact us here"  # one text on 12 sites
    texts = [*short, *[copied] * 12]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 12}", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, docs, "").collect()}
    assert got == {0: short[0]} | {i: f"own {i}" for i in range(1, 12)} | {i: copied for i in range(12, 24)}


def test_copies_without_id_go_and_other_texts_of_one_id_stay(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, words(0)), (None, words(0)), (None, words(0)), (None, words(1)), (5, words(2)), (5, words(3)), (5, words(3)), (6, words(3)), (7, words(4)), (None, words(4))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(None, words(0)), (None, words(1)), (5, words(2)), (5, words(3)), (7, words(4))], key=str)


def test_near_copies_go(spark):
    r = random.Random(2)
    draw = lambda: [f"w{r.randint(0, 9999)}" for _ in range(400)]
    base = [draw() for _ in range(20)]
    near = [[*b[:200], "changed", *b[201:]] for b in base]
    texts = [" ".join(t) for t in [*base, *near]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    left = {x.doc_id for x in corpus_pipeline.drop_copies(spark, docs, "").collect()}
    assert set(range(20)) <= left and len(left) <= 22
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        assert stage(spark, empty, "").count() == 0, name
