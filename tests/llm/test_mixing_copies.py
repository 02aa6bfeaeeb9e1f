from pyspark.sql import functions as F

from alphaline.llm import mixing


def test_unrelated_texts_with_equal_least_hashes_all_count(spark):
    pool = spark.createDataFrame([(f"w{k}",) for k in range(2000)], "w string")
    least = [pool.orderBy(F.xxhash64("w", F.lit(salt))).first().w for salt in (1, 2)]
    others = [f"w{k}" for k in range(1900) if f"w{k}" not in least]
    texts = [" ".join([*least, *others[20 * k : 20 * k + 20], *(["evil"] if k < 25 else [])]) for k in range(60)]
    rows = [*enumerate(texts), (60, texts[59])]  # a true copy
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 25)) for i, _ in rows], "doc_id long, quality int, toxic int")
    found = mixing.labelled_texts(docs, labels)
    assert found.count() == 60
    assert {r.domain: r.weight for r in found.groupBy("domain").agg(F.sum("weight").alias("weight")).collect()} == {2: 36, 3: 25}
    words = {word: (h, w) for word, h, w in mixing.evidence_words(found)}
    assert "evil" in words and words["evil"][1][3] > 0 > words["evil"][1][2]
