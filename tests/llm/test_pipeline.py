"""The pipeline on a small table equals its stages done by brute force."""

import corpus_pipeline
from parcel.llm import toxic
from tests.llm.test_linedup import brute as brute_lines
from tests.llm.test_minhash import brute as brute_near
from tests.llm.util import frame, prose, rows

INSULTS = ["idiot", "moron", "pathetic"]


def table(spark, folder):
    passage = "\n".join(prose(700 + k, 9) for k in range(8))        # over 50 words in all
    pairs = rows()
    pairs += [(100 + k, f"{prose(k, 30)}\n{passage}\n{prose(k + 40, 20)}") for k in range(6)]
    for k in range(120):
        words = prose(k + 300, 40).split()
        if k % 4 == 0:
            words[5], words[15], words[25] = INSULTS
        pairs.append((200 + k, " ".join(words)))
    base = prose(999, 120).split()
    pairs += [(400 + k, " ".join([*base[:100], f"tail{k}", *base[100:]])) for k in range(4)]
    frame(spark, pairs).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    labels = [(200 + k, 1, int(k % 4 == 0)) for k in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    return pairs


def test_stages_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    pairs = table(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "minhash", "packing"]

    def step(k, df):
        path = f"{folder}/out{k}"
        corpus_pipeline.STAGES[k][1](spark, df, folder).write.parquet(path)
        return spark.read.parquet(path)

    one = step(0, docs)
    predicted = toxic.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = tally((r.doc_id for r in predicted.where("predicted = 0").collect()))
    assert tally(r.doc_id for r in one.collect()) == clean
    assert all(d in dict(clean) for d, t in pairs if d is not None and not any(
        w in (t or "") for w in INSULTS))
    assert one.columns == docs.columns

    two = step(1, one)
    texts = [(r.doc_id, r.text) for r in one.collect()]
    assert sorted(((r.doc_id, r.text) for r in two.collect()), key=repr) == sorted(
        ((d, t) for d, t, _ in brute_lines(texts, 50)), key=repr)

    three = step(2, two)
    texts = [(r.doc_id, r.text) for r in two.collect()]
    groups = brute_near(texts)
    want = {(d, t) for d, t in texts if groups[(d, t)][1] == (-1 << 63 if d is None else d)}
    assert sorted(((r.doc_id, r.text) for r in three.collect()), key=repr) == sorted(want, key=repr)
    assert three.columns == docs.columns

    four = step(3, three)
    assert tally(r.doc_id for r in four.where("piece = 0").collect()) == tally(
        r.doc_id for r in three.collect())
    per = four.groupBy("sequence_id").agg({"length": "sum"})
    assert per.where("`sum(length)` > 1024").count() == 0


def test_run_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    table(spark, folder)
    assert corpus_pipeline.run(spark, folder).columns[:2] == ["doc_id", "piece"]
    empty = str(tmp_path / "empty")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def tally(values):
    from collections import Counter
    return sorted(Counter(values).items(), key=repr)
