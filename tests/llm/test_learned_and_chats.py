"""Trained operators on held-out labels of the given tables, tool calls on hand-made chats, and the pipeline."""

import json
import zlib

import duckdb
import numpy as np
import pytest


import corpus_pipeline
from exposure.llm import perplexity, quality, statistics, tool_calls, toxicity
from exposure.llm.filters import one_of_each, without
from exposure.llm.queries import ORACLES, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def fold(i):
    return zlib.crc32(str(i).encode()) % 3


def test_quality_of_held_out_labels(spark, labels):
    rows = {r.doc_id: r for r in QUERIES["op9_fourier_ridge"](spark, SF).collect()}
    assert len(rows) == 1000 and all(r.held_out == (fold(i) == 1) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [i for i in labels if fold(i) == 1]
    assert np.mean([rows[i].predicted == labels[i].quality for i in held]) > 0.95


def test_quality_learns_only_outside_the_held_out_fold(spark, docs_of):
    docs = docs_of([(i, ("good words here. " if i % 2 else "BAD!! ### 123 ") * (i % 7 + 3)) for i in range(90)] + [(None, "x"), (500, ""), (501, None)])
    truth = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    spoiled = spark.createDataFrame([(i, i % 2 if fold(i) != 1 else 1 - i % 2) for i in range(90)], "doc_id long, quality int")
    a, b = ({(r.doc_id): round(r.score, 9) for r in quality.score(docs, t, features=32).collect()} for t in (truth, spoiled))
    assert a == b and len(a) == 93
    assert all((a[i] >= 0.5) == bool(i % 2) for i in range(90))


@pytest.mark.parametrize("rows", [[], [(1, 1), (2, 1)], [(1, None)]])
def test_quality_without_two_classes(spark, docs_of, rows):
    docs = docs_of([(1, "a b"), (2, ""), (3, None)])
    out = quality.score(docs, spark.createDataFrame(rows, "doc_id long, quality int"), features=8).collect()
    assert len(out) == 3 and len({r.score for r in out}) == 1


def test_figures_ignore_other_texts_of_the_batch():
    import pyarrow as pa

    from exposure.llm import arrow_text as at

    texts = ["One two. three\nOne two.", "", "ALL CAPS!! 12", "a a a a a", "é|ß", "\n\n", "x"]
    together = statistics.figures(at.text_column(pa.array(texts)))
    for t, row in zip(texts, together):
        assert np.allclose(statistics.figures(at.text_column(pa.array([t])))[0], row)
    assert not together[1].any() and not together[5].any()


def test_figures_do_not_depend_on_the_number_of_short_texts():
    import pyarrow as pa

    from exposure.llm import arrow_text as at

    many = statistics.figures(at.text_column(pa.array(["ab cd", "zz"] * 35_000)))
    alone = statistics.figures(at.text_column(pa.array(["ab cd", "zz"])))
    assert alone[0, statistics.NAMES.index("entropy")] > 2 and np.allclose(many, np.tile(alone, (35_000, 1)))


def test_isotonic_regression():
    good, total = np.array([0, 5, 1, 0, 8, 10.0]), np.array([10, 10, 10, 0, 10, 10.0])
    out = quality.pooled(good, total)
    assert (np.diff(out) >= -1e-12).all() and out[1] == pytest.approx(out[2]) and 0 < out[0] < 0.1 < 0.9 < out[5] < 1


def test_toxic_words_are_found_in_held_out_documents(spark, docs_of):
    fill = lambda i: " ".join(f"w{(i * 31 + j * 17) % 90}" for j in range(12))
    docs = docs_of([(i, fill(i) + (" You MORONIC thing" if i % 5 == 0 else " kind thing") + " idiót" * (i % 10 == 0)) for i in range(400)] + [(900, None), (901, "")])
    truth = spark.createDataFrame([(i, int(i % 5 == 0), int(i % 10 == 0)) for i in range(400)], "doc_id long, toxic int, severe int")
    rows = {r.doc_id: r for r in toxicity.score(docs, truth, ["toxic", "severe"], "toxic").collect()}
    assert len(rows) == 402 and not rows[900].toxic and not rows[901].toxic
    for i in (i for i in range(400) if fold(i) == 1):
        assert rows[i].toxic == (i % 5 == 0) and (rows[i].p_severe > 0.5) == (i % 10 == 0)


@pytest.mark.parametrize("rows", [[], [(1, 1, 0)]])
def test_toxicity_without_two_classes(spark, docs_of, rows):
    out = toxicity.score(docs_of([(1, "a b"), (2, "c")]), spark.createDataFrame(rows, "doc_id long, toxic int, severe int"), ["severe", "toxic"], "toxic").collect()
    assert len(out) == 2 and all(0 <= r.p_toxic <= 1 for r in out)


def test_perplexity_bands_reject_odd_texts_on_both_sides(spark):
    rng = np.random.default_rng(3)
    prose = lambda: " ".join(rng.choice([a + b for a in ("the", "rain", "in", "spa", "of", "fall") for b in ("", "s", "ing", "er", "ly")], 80))
    rows = [(i, prose(), "en") for i in range(120)] + [(200, "".join(chr(33 + x) for x in rng.integers(0, 90, 600)).replace("5", " ") + " z q" * 30, "en"), (201, " ".join(f"qzx{i}#" for i in range(90)), "en"), (202, None, None), (203, prose(), None)]
    out = {r.doc_id: r for r in perplexity.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spread=6.0).collect()}
    assert all(out[i].kept for i in range(120)) and out[203].kept
    assert not out[201].base_failed and not out[201].kept and out[202].base_failed and not out[202].kept
    assert out[201].log_perplexity < out[201].lower and out[200].log_perplexity > out[200].upper


def test_perplexity_rejects_real_words_in_meaningless_order(spark):
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(200)]

    def prose():
        at, out = int(rng.integers(200)), []
        for _ in range(150):
            out.append(names[at])
            at = (at * 7 + int(rng.integers(3))) % 200  # one of three words follows each
        return out

    rows = [(i, " ".join(prose()), "en") for i in range(150)] + [(1000 + i, " ".join(rng.permutation(prose())), "en") for i in range(8)]
    rows += [(3000, " ".join(prose()), None), (3001, "", "en")]
    out = {r.doc_id: r for r in perplexity.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spread=6.0).collect()}
    assert len(out) == len(rows)
    assert [i for i in [*range(150), 3000] if not out[i].kept] == []
    for i in range(1000, 1008):
        assert not out[i].base_failed and not out[i].kept and out[i].order_log_perplexity > out[i].order_upper


def test_word_trigrams_grow_with_the_input_and_sum_to_one(spark):
    from pyspark.sql import functions as F

    from exposure.llm import word_order

    docs = spark.range(4000).select(F.col("id").alias("key"), F.concat_ws(" ", *(F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(j)), F.lit(500))) for j in range(6))).alias("text"))
    some, more = (word_order.counts(docs.where(f"key < {n}")).cache() for n in (400, 4000))
    assert more.count() > 9 * some.count()
    p = word_order.probabilities(some)
    seen = p.join(some, "gram").groupBy("context").agg(*(F.sum(f"p{h}").alias(f"p{h}") for h in (0, 1)))
    assert p.count() == some.count() and not p.where("not (p0 > 0 and p0 <= 1 and p1 > 0 and p1 <= 1)").count()
    assert not seen.where("p0 > 1.0001 or p1 > 1.0001").count()


CALLS = "conv_id long, position long, call_id string, tool string, arguments string, needs array<string>"


def link(spark, calls, results):
    schemas = tool_calls.schema_table(spark, {"f": {"a": ("integer", True), "b": ("string", False)}, "g": {"x": ("number", True), "y": ("array", False), "z": ("object", False)}})
    return tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv_id long, position long, call_id string, content string"), schemas).collect()


def test_calls_are_linked_ordered_checked_and_written(spark):
    rows = link(
        spark,
        [
            (1, 5, "a", "f", '{"b": "é\\n", "a": 1}', ["c"]), (1, 6, "b", "f", '{"a":"1","c":2}', ["a", "x"]), (1, 7, "c", "g", '{"x":1.5,"y":[ 1,{"k":2,"j":1}],"z":{}}', []),
            (1, 8, "p", "f", "[1]", ["q"]), (1, 9, "q", "f", "no json", ["p"]), (1, 10, "r", "h", "{}", ["q"]), (2, 1, "a", "f", None, None), (2, 2, None, "g", '{"x":"1"}', ["a"]), (3, 1, "d", "f", '{"a":1}', []), (3, 2, "d", "f", '{"a":2}', []),
        ],
        [(1, 11, "a", 'say "hi"'), (1, 12, "a", "again"), (1, 13, "nobody", None), (2, 3, None, "lost"), (2, 4, "a", "t")],
    )
    calls = {(r.conv_id, r.position): r for r in rows if r.kind == "call"}
    assert [calls[1, p].ord for p in (7, 5, 6, 8, 9, 10)] == [0, 1, 2, 3, 4, 5]
    assert [calls[1, p].level for p in (7, 5, 6, 8, 9, 10)] == [0, 1, 2, None, None, None]
    a = calls[1, 5]
    assert a.valid and a.n_results == 2
    assert a.json == '{"arguments":{"a":1,"b":"é\\n"},"id":"a","needs":["c"],"result":"say \\"hi\\"","tool":"f"}'
    assert calls[1, 6].errors == ["a is not integer", "unknown c", "needs unknown call x"]
    assert calls[1, 7].valid and json.loads(calls[1, 7].json)["arguments"] == {"x": 1.5, "y": [1, {"j": 1, "k": 2}], "z": {}}
    assert calls[1, 8].errors == ["arguments are not a JSON object", "needs itself"]
    assert calls[1, 10].errors == ["unknown tool", "needs itself"]
    assert calls[2, 1].errors == ["arguments are not a JSON object"] and json.loads(calls[2, 1].json)["arguments"] is None
    assert calls[2, 2].errors == ["x is not number"] and calls[2, 2].n_results == 0
    assert calls[3, 1].errors == ["repeated call_id"] and calls[3, 2].ord == 1
    orphans = {(r.conv_id, r.position): r.json for r in rows if r.kind == "orphan"}
    assert orphans == {(1, 13): '{"id":"nobody","result":null}', (2, 3): '{"id":null,"result":"lost"}'}
    assert all(json.loads(r.json) for r in rows)
    assert link(spark, [], []) == []


def test_derived_calls_follow_the_chats(spark):
    rows = QUERIES["op3_tool_calls"](spark, SF).collect()
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    users = {(r.conv_id, r.turn): r for r in turns if r.role == "user"}
    answers = {(r.conv_id, r.turn) for r in turns if r.role == "assistant"}
    calls = {(r.conv_id, r.position): r for r in rows if r.kind == "call"}
    assert calls.keys() == users.keys()
    assert {(r.conv_id, r.position) for r in rows if r.kind == "orphan"} == {(c, t) for c, t in answers if (c, t - 1) not in users}
    for (c, t), r in calls.items():
        n = len(users[c, t].text)
        assert r.n_results == ((c, t + 1) in answers)
        bad = n % 13 == 0 or n % 17 == 0 or (n % 11 == 0 and (c, t + 2) not in users) or (t >= 2 and (c, t - 2) not in users) or r.level is None
        if n % 3 != 2:
            assert r.valid == (not bad), (n, r.errors)
        if n % 13:
            assert json.loads(r.json)["id"] == f"call_{t}"


def test_filters_judge_rows_of_one_id_together(spark, docs_of):
    docs = docs_of([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "d"), (3, None), (3, None)])
    decisions = spark.createDataFrame([(1, True), (1, False), (2, False), (None, False), (3, True)], "doc_id long, kept boolean")
    out = one_of_each(without(docs, decisions))
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, "a"), (1, "b"), (3, "")]


def test_pipeline_stages_against_plain_versions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    quality_, near, repeats, clean, packed = (f for _, f in corpus_pipeline.STAGES)
    sf = "/root/testdata/sf0.001"
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    first = quality_(spark, docs, sf).cache()
    scores = {r.doc_id: r.predicted for r in QUERIES["op9_fourier_ridge"](spark, sf).collect()}
    assert {i for i, _ in pairs(first)} == {i for i, p in scores.items() if p} and first.columns == docs.columns

    second = near(spark, first, sf).cache()
    groups = brute.near_groups(pairs(first), 5, 80)
    assert {i for i, _ in pairs(second)} == {i for i, (_, c) in groups.items() if i == c} and second.columns == docs.columns

    third = repeats(spark, second, sf).cache()
    gone = brute.repeated_bytes(pairs(second), keep="first")
    before = dict(pairs(second))
    for i, t in pairs(third):
        assert (t == before[i]) == (gone[i][1] == 0)

    fourth = clean(spark, third, sf).cache()
    items = pairs(spark.read.parquet(f"{sf}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))
    assert {i for i, _ in pairs(fourth)} == {r[0] for r in brute.contamination(pairs(third), items) if not r[2]}

    rows = packed(spark, fourth, sf).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in pairs(fourth)}
    fills = {}
    for r in rows:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 2048


@pytest.mark.parametrize("shared", [70_007, None])
def test_pipeline_judges_each_row_of_a_shared_id(spark, docs_of, shared):
    sf = "/root/testdata/sf0.001"
    quality_, near, _, clean, _ = (f for _, f in corpus_pipeline.STAGES)
    item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(r.text.split()) >= 12)
    words = [f"word{i}" for i in range(80)]
    one, two, other = " ".join(words), " ".join([*words[:-1], "changed"]), " ".join(f"term{i}" for i in range(60))
    texts = lambda df: sorted((r.text or "") for r in df.collect())
    found = texts(near(spark, docs_of([(shared, one), (shared, two), (shared, other), (shared, other), (shared, None), (shared, "")]), sf))
    assert len(found) == 4 and other in found and (one in found) != (two in found)
    smallest = near(spark, docs_of([(shared, one), (3, two), (shared, other)]), sf).collect()
    assert sorted(r.text for r in smallest) == sorted([two, other])
    assert texts(clean(spark, docs_of([(shared, f"see {item} here"), (shared, other)]), sf)) == [other]

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {r.doc_id: r.score for r in QUERIES["op9_fourier_ridge"](spark, sf).collect()}
    good, bad = (pick(docs.collect(), key=lambda r: scores[r.doc_id]) for pick in (max, min))
    both = docs.unionByName(spark.createDataFrame([(shared, good.text), (shared, bad.text)], "doc_id long, text string"), allowMissingColumns=True)
    left = [r.text for r in quality_(spark, both, sf).collect() if r.doc_id == shared]
    assert good.text in left and bad.text not in left


def test_pipeline_takes_odd_rows(spark, docs_of):
    docs = docs_of([(1, None), (1, None), (None, ""), (2, "x " * 400), (3, "x " * 400), (4, "some plain words. " * 30)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
    assert "kept" in docs.columns and corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 0
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0



@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    found = QUERIES[name](spark, sf)
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(cursor.fetchall())
