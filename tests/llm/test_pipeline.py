"""The pipeline's stages one by one, on small tables in Parquet."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(31)
    words = lambda n: " ".join(rng.choice("abcdefghij") + "".join(rng.choice("aeiounrst") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    item = words(30)
    data = [(k, words(90), "en", f"s{k % 3}", 0) for k in range(120)]
    data += [(200 + k, words(40) + " idiot " + words(40) + " idiot scum", "en", "s0", 0) for k in range(40)]
    data += [(300 + k, data[k][1] + " end", "en", "s1", 0) for k in range(10)]
    data += [(400, words(40) + " " + item + " " + words(40), "en", "s2", 0)]
    data += [(500 + k, " ".join(w + "###" for w in words(80).split()), "en", "s1", 0) for k in range(15)]
    data += [(600, None, None, None, None), (601, "", "en", "s0", 0), (602, "short", "en", "s0", 0), data[0], (None, words(70), "en", None, 0)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(data, DOCS).withColumn("_quality", F.lit("mine")).withColumn("votes", F.lit(2)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(200 <= k < 240)) for k in [*range(0, 120, 2), *range(200, 240, 2)]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r[1] for r in data}


def test_stages(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda frame: sorted(r.doc_id if r.doc_id is not None else -1 for r in frame.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "toxicity", "near_dedup", "decontamination", "mixing"]
    good = stages["quality_rules"](spark, docs, folder)
    assert good.columns == docs.columns and set(ids(docs)) - set(ids(good)) == {*range(500, 515), 600, 601, 602}
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns and set(ids(docs)) - set(ids(clean)) == set(range(200, 240))
    single = stages["near_dedup"](spark, docs, folder)
    assert single.columns == docs.columns and ids(single) == sorted(set(ids(docs)) - set(range(300, 310)))
    safe = stages["decontamination"](spark, docs, folder)
    assert safe.columns == docs.columns and set(ids(docs)) - set(ids(safe)) == {400}
    mixed = stages["mixing"](spark, docs, folder)
    assert mixed.columns == ["position", "doc_id", "source", "size", "text"] and set(ids(mixed)) <= set(ids(docs))
    none = docs.filter("false")
    for name, stage in stages.items():
        assert stage(spark, none, folder).count() == 0, name


def test_run(spark, tables):
    folder, texts = tables
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    assert ids <= {*range(120), None} and len(ids) > 100
    assert all(r.text == texts[r.doc_id] for r in rows) and max(sum(r.doc_id == i for r in rows) for i in ids) <= 2
