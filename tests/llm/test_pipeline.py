"""The pipeline's stages on small tables with awkward rows, each against what it promises."""

import random

import corpus_pipeline
from sparkweave.llm import registry


def write(spark, path):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, item = text(80), text(30)
    docs = [(i, text(rng.randint(20, 200)), "en", f"s{i % 2}", 0) for i in range(120)]
    docs += [(i, docs[i - 200][1] + " end", "en", "s0", 0) for i in range(200, 210)]
    docs += [(300, f"{text(60)} {passage} {text(50)}", "en", "s1", 0), (301, f"{text(70)} {passage} {text(40)}", "en", "s1", 0)]
    docs += [(400, f"{text(50)} {item} {text(50)}", "en", "s1", 0)]
    docs += [(500 + i, text(60) + " snarfle you snarfling snarf snarfles", "en", "s1", 0) for i in range(60)]
    docs += [(600, None, None, None, None), (601, "", "en", "s0", 0), (None, text(40), "en", "s0", 0)]
    labels = [(i, 1, 0) for i in range(120)] + [(500 + i, 1, 1) for i in range(50)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return passage


def test_stages(spark, tmp_path):
    passage = write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    ids = lambda df: {r[0] for r in df.select("doc_id").distinct().collect()}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["toxicity"](spark, docs, str(tmp_path))
    assert one.columns == columns and not {*range(500, 560)} & ids(one) and len(ids(docs) - ids(one)) <= 62
    two = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert two.columns == columns and ids(docs) - ids(two) >= {*range(200, 210)} and {*range(120), 300, 301, 400, 600, 601, None} <= ids(two)
    three = stages["repeated_passages"](spark, docs, str(tmp_path))
    assert three.columns == columns and three.count() == docs.count()
    texts = {r.doc_id: r.text for r in three.collect()}
    assert passage[:150] not in texts[300] and texts[600] is None and len(texts[300]) > 200
    four = stages["decontamination"](spark, docs, str(tmp_path))
    assert four.columns == columns and ids(docs) - ids(four) == {400}
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert not {400, *range(500, 560), *range(200, 210)} & ids(run) and {300, 301, 600, 601} <= ids(run)


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text, 1, "a"), (7, text, 2, "b"), (None, text + " z", 3, None), (None, "other words that stand alone here", 4, "c"), (None, "other words that stand alone here", 5, "c")]
    rows += [(9, None, 6, "d"), (9, None, 7, "d"), (None, None, 8, "e"), (10, "", 9, "f"), (10, "", 10, "f"), (3, text, 11, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, __id string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    out = stage(spark, docs, None)
    kept = {r.row for r in out.collect()}
    assert out.columns == docs.columns and out.count() == len(kept)
    assert kept - {4, 5} == {6, 7, 8, 9, 10, 11} and len(kept & {4, 5}) == 1
    assert stage(spark, docs.limit(0), None).count() == 0


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry_has_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES if k != "quality_rules_base") == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
