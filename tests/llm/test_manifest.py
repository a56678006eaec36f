"""The Merkle manifest against a plain tree."""

import random

import pytest
from pyspark.sql import functions as F

from exposure.llm import merkle, ranks
from tests.llm import brute

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, tree string, pos string, root double, `node` int"


def documents(n, seed=0):
    rng = random.Random(seed)
    rows = [
        {"doc_id": rng.choice([None, 2**53 + 1, -5, *range(n)]), "source": rng.choice(["s", None, ""]), "lang": rng.choice(["en", "en", "en", "é", "", None, "z"]), "n_chars": rng.choice([None, 0, 2**63 - 1, 9]), "text": rng.choice(["", None, "é x", "y" * 5000])}
        for _ in range(n)
    ]
    return rows + rows[: n // 4]  # rows alike in every field


def frame(spark, rows):
    return spark.createDataFrame([(*r.values(), 1, "t", "p", 0.5, 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("n,fanout,levels", [(0, 2, 2), (1, 2, 3), (2, 2, 1), (90, 2, 2), (70, 3, 1), (61, 4, 5)])
def test_manifest_equals_a_plain_tree(spark, n, fanout, levels):
    rows = documents(n)
    got = merkle.manifest(frame(spark, rows), fanout=fanout, levels=levels, proofs=True)
    found = got.collect()
    assert sorted((tuple(r)[:7] for r in found), key=str) == brute.manifest(rows, fanout)
    assert all(merkle.fold(r.leaf, r.proof) == r.root for r in found)  # a proof holds for the untampered leaf


def test_only_changed_documents_fail(spark):
    rows = [{"doc_id": i, "source": "s", "lang": "en", "n_chars": 1, "text": str(i)} for i in range(100)]
    found = merkle.manifest(frame(spark, rows), levels=3).collect()
    bent = {r.doc_id for r in spark.range(100).where(merkle.every_seventh(F.col("id"))).withColumnRenamed("id", "doc_id").collect()}
    assert bent and {r.doc_id for r in found if not r.verified} == bent
    assert all(r.verified for r in merkle.manifest(frame(spark, rows), levels=3, tampered=lambda _: F.lit(False)).collect())


def test_no_task_numbers_a_whole_language(spark, monkeypatch):
    rows = ranks.stored(spark.range(5000).select(F.lit(0).cast("long").alias("tree"), F.lit(1).alias("same"), F.col("id")), "ranked")
    written, stored = {}, ranks.stored
    monkeypatch.setattr(ranks, "stored", lambda df, name: written.setdefault(name, stored(df, name)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranks.numbered(rows, "tree", ["same", "id"], "numbered")
        assert out.where("pos <> id or n <> 5000").count() == 0 and out.count() == 5000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    per_task = [r["count"] for r in written["numbered"].groupBy("part").count().collect()]
    assert len(per_task) == 4 and max(per_task) < 2500
