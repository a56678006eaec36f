"""Objects read in splits against the whole object."""

import json
import random

import pytest

from exposure.sources import objects, tags, vulndb

WORDS = ['a', '"', '\\', '}', '{', ']', '[', ',', ':', '\\"', ' ', 'é', '\n', '\\u007d', '"]}', '']


def entry(rng):
    return {"cve": f"CVE-{rng.randrange(99)}", "cvss": 1.5, "desc": "".join(rng.choices(WORDS, k=rng.randrange(12)))}


def database(seed, size):
    rng = random.Random(seed)
    return {f"cpe:{n}{''.join(rng.choices(WORDS, k=3))}": [entry(rng) for _ in range(rng.choice([0, 1, 1, 4]))] for n in range(size)}


def read_back(df):
    return {k: v for r in df.collect() for k, v in json.loads(r.value).items()}


@pytest.mark.parametrize("seed,indent", [(1, None), (2, 1), (3, None)])
def test_entries_equal_the_object(spark, tmp_path, seed, indent):
    whole = {}
    for n, size in enumerate([60, 0, 1]):
        part = {f"{n}{k}": v for k, v in database(seed + 10 * n, size).items()}
        whole.update(part)
        (tmp_path / f"{n}.json").write_text(json.dumps(part, indent=indent, ensure_ascii=seed == 1) + "\n" * n)
    (tmp_path / "empty.json").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = objects.read_entries(spark, str(tmp_path), "]")
        assert spark.read.option("lineSep", "]").text(str(tmp_path)).rdd.getNumPartitions() > 5
        assert read_back(found) == whole and found.count() >= 55
        split, together = vulndb.read_split(spark, str(tmp_path)), vulndb.read_documents(spark, str(tmp_path))
        assert sorted(map(repr, split.collect())) == sorted(map(repr, together.where("cpe IS NOT NULL").collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_both_forms_of_tags(spark, tmp_path):
    rng = random.Random(5)
    body = {}
    for n in range(40):
        text = "".join(rng.choices(WORDS, k=5)) + "."
        body[f"mac:{n}"] = [text, "x"] if n % 3 == 0 else {"labels": [text], "owner": text, "lastIp": f"10.0.0.{n}", "lastSeen": "2024-01-01T00:00:00Z"}
    body["10.0.0.1"] = ["last", "old form"]
    (tmp_path / "tags.json").write_text(json.dumps(body, indent=2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        split = tags.read_split(spark, str(tmp_path))
        assert sorted(map(repr, split.collect())) == sorted(map(repr, tags.read_documents(spark, str(tmp_path)).collect()))
        assert split.count() == 41
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_objects_in_a_row_and_broken_ends(spark, tmp_path):
    path = tmp_path / "lines.json"
    path.write_text('﻿{"a": [1], "b": [[2, "]"], 3]}\n{}\n{"c": []}\n{"d": [4], "e": [5, "')
    assert read_back(objects.read_entries(spark, str(path), "]").where("value NOT LIKE '%\"e\"%'")) == {"a": [1], "b": [[2, "]"], 3], "c": [], "d": [4]}
    with pytest.raises(ValueError):
        objects.read_entries(spark, str(path), ",")
