"""Edited texts stay near their originals where a text is very frequent, or has common terms only."""

import random
from statistics import mean

from loomfield.llm import imatch


def rows(spark, folder):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    common = [word() for _ in range(160)]
    rare = [word() for _ in range(1500)]
    hot = " ".join(word() for _ in range(90))
    docs = []
    for i in range(240):
        kind = ("hot", "plain", "common", "plain")[i % 4]
        docs.append((i, hot if kind == "hot" else " ".join(rng.sample(common, 90) if kind == "common" else rng.sample(rare, 50) + rng.sample(common, 40))))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    out = imatch.op1_imatch(spark, str(folder)).collect()
    return {k: ([r.near_edited for r in out if r.doc_id % 4 == i], [r.near_next for r in out if r.doc_id % 4 == i]) for k, i in (("hot", 0), ("common", 2), ("plain", 1))}


def test_edited_stay_near(spark, tmp_path):
    found = rows(spark, tmp_path)
    print({k: (round(mean(a), 3), round(mean(b), 3)) for k, (a, b) in found.items()})
    for edited, following in found.values():
        assert mean(edited) > 0.1 and mean(edited) > 2 * mean(following)
