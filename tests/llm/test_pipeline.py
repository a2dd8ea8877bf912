"""The pipeline's stages: what must go goes, clean documents stay, columns stay."""

import random
import uuid

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from strandloom.llm.packing import pack


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    rows, labels = [], []
    for i in range(150):
        words = [word() for _ in range(90)]
        bad = i % 6 == 0
        if bad:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "moron"]))
        if i in (1, 2):
            words[40:40] = passage.split()
        if i == 3:
            words.append("write to someone@example.org")
        rows.append((i, " ".join(words), "en", "src1", 0))
        labels.append((i, 1, int(bad)))
    rows.append((500, rows[7][1], "en", "src2", 0))
    near = rows[8][1].split()
    near[50] = "different"
    rows.append((501, " ".join(near), "en", "src2", 0))
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top, passage


def test_stages(spark, folder, tmp_path):
    top, passage = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, top).write.parquet(path := str(tmp_path / uuid.uuid4().hex))
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(seen["toxicity"]) == [i for i in [*range(150), 500, 501] if i % 6 or i >= 500]
    assert sorted(seen["simhash near-dedup"]) == [i for i in range(150) if i % 6]
    assert passage in seen["suffix-array dedup"][1] and passage not in seen["suffix-array dedup"][2]
    assert "[EMAIL]" in seen["pii"][3] and "someone" not in seen["pii"][3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, top)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert pack.__name__ == "pack" and packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
