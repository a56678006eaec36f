"""Operators on texts against plain versions, over hand-made and random documents."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from exposure.llm import arrow_text as at
from exposure.llm import components, dac, decontamination, minhash, packing, perplexity, prefix_counts, suffixes, tokens
from exposure.llm.queries import vocabulary
from tests.llm import brute

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")

ODD = [
    "", None, " ", "\n\n", "a", "é", "two words", "Same text here\nSame text here\n", "x" * 3000, "tab\tand\x0bmore\x0c\r\n", "<|endoftext|> in <|startoftext|>x", "don't we'll 'RE",
    "é  x   y　 z\xa0\xa0q", "日本語 テスト 🎉🎉", "\x00 nul \x1c sep", "ÀÉÎ× ÷ ß ﬁ Σας İ", "!!!---???", "123 45.6e7",
]


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["the", "on", "éa", "st", "ing", "er"], k=rng.randint(1, 3)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passage, base = prose(70), [prose(120) for _ in range(4)]
    texts = [t for t in ODD]
    for i in range(n):
        kind = i % 6
        if kind == 0:
            texts.append(prose(rng.randint(1, 150)))
        elif kind == 1:
            texts.append(rng.choice(base))
        elif kind == 2:
            w = rng.choice(base).split()
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        elif kind == 3:
            texts.append(prose(20) + " " + passage + "\n" + prose(20))
        elif kind == 4:
            texts.append(prose(5) + "é" * rng.randint(90, 130) + prose(5))
        else:
            texts.append(prose(rng.randint(1, 12)).upper())
    texts += texts[20:26]
    return [(i * 7 % 1000, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def pairs():
    return corpus()


def test_piece_ids_equal_those_of_whole_texts(pairs):
    texts = at.text_column(pa.array([t for _, t in pairs], pa.string()))
    for path in (BYTE, WORD):
        values, edges = tokens.id_table(path).values(*at.buffer_of(texts))
        whole = Tokenizer.from_file(path).encode_batch([t or "" for _, t in pairs], add_special_tokens=False)
        assert [values[a:b].tolist() for a, b in zip(edges, edges[1:])] == [e.ids for e in whole]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "'", "s", "re", "ll", "é", "1", "!", "<|endoftext|>", "<|", "-", "\xa0", "T", "tion", "\t", "🎉"]), max_size=12))
def test_prefix_counts_equal_those_of_encoded_prefixes(parts):
    text = "".join(parts)
    table, tokenizer = prefix_counts.prefix_table(BYTE), tokens.vocabulary(BYTE).tokenizer
    buf, offsets = at.buffer_of(at.text_column(pa.array([text])))
    _, entries, before, _ = prefix_counts.totals(table, buf, offsets)
    found = [int(b + c) for e, b in zip(entries, before) for c in table.flat[table.at[e] : table.at[e] + table.count[e]]]
    raw, want, last = text.encode(), [], 0
    for i in range(1, len(raw) + 1):
        try:
            last = len(tokenizer.encode(raw[:i].decode(), add_special_tokens=False).ids)
        except UnicodeDecodeError:
            pass
        want.append(last)
    assert found == want


@pytest.mark.parametrize("unit", ["a", "abc", "-", "=-", "thequickbrownfox", "日本語", None])
def test_long_words_in_spans_equal_the_walk_and_the_library(unit):
    counter, tokenizer = prefix_counts.prefix_table(BYTE).make.__self__, tokens.vocabulary(BYTE).tokenizer
    rng = random.Random(3)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9000)) if unit is None else (unit * 9000)[:9000]
    found = counter._spans(word.encode())
    assert np.array_equal(found, counter._one(word.encode()))
    for cut in (1, 255, 256, 257, 2049, 6500, 9000):
        assert found[len(word[:cut].encode()) - 1] == len(tokenizer.encode(word[:cut], add_special_tokens=False).ids)


def test_token_counts_limits_and_stored_prefixes(docs_of, pairs):
    tokenizer = Tokenizer.from_file(BYTE)
    rows = {(r.doc_id): r for r in prefix_counts.counted(docs_of(pairs), BYTE, limit=20).collect()}
    stored = {r.doc_id: np.frombuffer(r.prefixes, "<i4") for r in prefix_counts.with_prefixes(docs_of(pairs), BYTE).collect()}
    for i, t in pairs:
        r, n = rows[i], len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n, n > 20)
        good = np.flatnonzero(stored[i] <= 20)
        assert r.fit_bytes == (good[-1] + 1 if len(good) else 0)
        assert len(stored[i]) == r.n_bytes and (not r.n_bytes or stored[i][-1] == n)


def test_documents_without_an_id_are_spread_over_shards(spark, docs_of, tmp_path):
    path = str(tmp_path / "codes")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tables of this size would be one partition
    try:
        dac.write(docs_of([(None if n % 3 else n, f"text {n}") for n in range(1200)]).repartition(8), path, BYTE, end_id=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n for r in spark.read.parquet(path).groupBy("shard").agg(F.sum(F.length("doc_nulls")).alias("n")).collect()]
    assert sum(sizes) == 1200 and max(sizes) <= 600
    found = sorted(dac.documents_at(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None] * 800 + list(range(0, 1200, 3))


def test_codes_give_any_token_back():
    rng = np.random.default_rng(1)
    for top in (200, 60_000, 70_000):
        ids = rng.integers(0, top, 5000)
        ids[::7] = rng.integers(0, 200, len(ids[::7]))
        codes = dac.Codes.of(ids)
        again = dac.Codes.from_row(codes.row())
        where = rng.permutation(len(ids))
        assert again.get(where).tolist() == ids[where].tolist()
    assert dac.Codes.of(np.zeros(0, np.int64)).get(np.zeros(0, np.int64)).tolist() == []


def test_code_files_hold_every_document_in_order(spark, docs_of, pairs, tmp_path):
    path, tokenizer = str(tmp_path / "codes"), Tokenizer.from_file(BYTE)
    rows = [*pairs, (None, "no id")]
    dac.write(docs_of(rows), path, BYTE, end_id=2)
    found = sorted(dac.documents_at(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in found] == want
    everything = [x for w in want for x in w[4]]
    asked = [0, 5, len(everything) - 1, len(everything), 17]
    got = {r.position: r.id for r in dac.tokens_at(spark, path, spark.createDataFrame([(p,) for p in asked], "position long")).collect()}
    assert got == {p: everything[p] if p < len(everything) else None for p in asked}


def test_packing_places_every_id_once(docs_of, pairs):
    tokenizer = Tokenizer.from_file(WORD)
    rows = packing.pack(docs_of(pairs), WORD, end_id=1, capacity=64, with_ids=True)
    pieces, found = {}, {}
    for r in rows.collect():
        pieces.setdefault(r.doc_id, []).append(r)
        found.setdefault(r.sequence_id, []).append(r)
    for i, t in pairs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist() == ids
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in own)
    for own in found.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert sum(r.length for r in own) <= 64
    assert sorted(found) == list(range(len(found)))
    for s in packing.sequences(rows, 64).collect():
        n = s.n_ids
        assert len(s.ids) == 4 * (n if n & (n - 1) == 0 else 64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=25), st.integers(0, 40))
def test_least_slack_finds_the_fullest_multiset(lengths, room):
    counts = {k: lengths.count(k) for k in lengths}
    chosen = packing.least_slack(counts, sorted(counts, reverse=True), room)
    sums = {0}
    for k in lengths:
        sums |= {s + k for s in sums if s + k <= room}
    assert sum(k * n for k, n in chosen) == max(sums)
    assert all(n <= counts[k] for k, n in chosen)


def test_packing_wastes_little():
    rng = np.random.default_rng(2)
    lengths = np.minimum(2047, rng.lognormal(6, 1, 20_000).astype(int) + 1)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.plan(counts, 2048)
    assert lengths.sum() / (2048 * sum(p.times for p in plan)) > 0.999


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=60).map(lambda b: bytes(x % 3 for x in b)), st.integers(8, 20))
def test_previous_factors(raw, depth):
    text = np.frombuffer(raw, np.uint8)
    levels = suffixes.ranks(text + 1, depth)
    order = np.argsort(levels[-1][1], kind="stable")
    for later in (False, True):
        found = np.zeros(len(raw), int)
        found[order] = suffixes.previous_factors(levels, text + 1, order, later)
        for i in range(len(raw)):
            others = range(i + 1, len(raw)) if later else range(i)
            best = 0
            for j in others:
                n = 0
                while n < depth and max(i, j) + n < len(raw) and raw[i + n] == raw[j + n]:
                    n += 1
                best = max(best, n)
            assert found[i] == best


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("crowd", [suffixes.CROWD, 1])
def test_repeats_against_all_windows(docs_of, pairs, keep, crowd, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    want = brute.repeated_bytes(pairs, keep=keep)
    rows = suffixes.deduplicate(docs_of(pairs), keep=keep).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want
    assert sum(w[1] for w in want.values()) > 1000


def test_cut_texts_stay_valid(docs_of, pairs):
    docs = docs_of(pairs)
    out = suffixes.without_repeats(docs, chars_col="n_chars")
    assert out.schema == docs.schema
    rows = {r.doc_id: r for r in out.collect()}
    want = brute.repeated_bytes(pairs, keep="first")
    for i, t in pairs:
        if want[i][1] == 0:
            assert rows[i].text == t
        elif i in rows:
            assert rows[i].n_chars == len(rows[i].text) < len(t)
            assert 0 <= len(rows[i].text.encode()) - (want[i][0] - want[i][1]) <= 6 * want[i][2]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_groups_against_all_pairs(docs_of, pairs, k, percent):
    want = brute.near_groups(pairs, k, percent)
    rows = minhash.near_duplicates(docs_of(pairs), k, percent, h=3, m=13).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert sum(not r.kept for r in rows) > 10


def test_large_families_are_compared_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    pairs = []
    for i in range(70):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        pairs.append((i, " ".join(w)))
    want = brute.near_groups(pairs, 3, 85)
    rows = minhash.near_duplicates(docs_of(pairs), 3, 85, h=2, m=16).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (7, 3), (5, 5), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    rows = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert rows == {1: 1, 2: 1, 3: 1, 7: 1, 10: 10, 11: 10} | {100 + i: 100 for i in range(41)}


def test_contamination_against_all_windows(spark, docs_of, pairs):
    long = next(t for _, t in pairs if t and len(t.split()) > 100)
    items = [(1, " ".join(long.split()[10:40])), (2, "two words"), (30, long.upper()), (4, ""), (5, None), (6, "nowhere at all"), (2, "two words"), (None, " ".join(long.split()[50:65])), (7, "the")]
    docs = [*pairs, (5000, "Two,words! and the two words"), (None, long), (5000, "another")]
    benchmark = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc int, term int")
    want = sorted(brute.contamination(docs, items), key=str)
    rows = decontamination.decontaminate(docs_of(docs), benchmark).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows), key=str) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in rows)


def test_proximity(spark, docs_of):
    docs = docs_of([(1, "alpha x x beta"), (2, "beta " + "x " * 30 + "alpha"), (3, "alpha"), (4, "beta y alpha y alpha")])
    benchmark = spark.createDataFrame([(9, "Alpha beta")], "item_id long, text string")
    rows = decontamination.proximity(docs, benchmark, terms_per_item=2, span=5).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, "9"), (4, "9")}


def test_empty_tables(spark, docs_of):
    none, benchmark = docs_of([]), spark.createDataFrame([], "item_id long, text string")
    assert minhash.near_duplicates(none).count() == 0
    assert suffixes.deduplicate(none).count() == 0
    assert packing.pack(none, WORD, 1).count() == 0
    assert prefix_counts.counted(none, BYTE).count() == 0
    assert decontamination.decontaminate(none, benchmark).count() == 0
    assert decontamination.decontaminate(docs_of([(1, "a b")]), benchmark).first().contaminated is False
    assert perplexity.rules(none).count() == 0


def test_base_figures():
    for raw, want in {
        b"": (0, 0, 0, 0, 0), b"a b c a b c x": (7, 7, 0, 0, 6), "é| <\n\né| <\n".encode(): (4, 6, 4, 1, 0), b"x x x x": (4, 4, 0, 0, 4), b"a\x0bb\x1cc": (2, 4, 0, 0, 0),
    }.items():
        assert perplexity.base_figures(raw) == want


def test_kneser_ney_is_a_distribution_and_prefers_what_it_saw():
    texts = at.text_column(pa.array(["the rain in the plain", "the cat, the hat"] * 3))
    codes = perplexity.grams(*perplexity.symbols(*at.buffer_of(texts)), perplexity.ORDER)
    found, n = np.unique(codes, return_counts=True)
    model, base = perplexity.Model(found, n), perplexity.SYMBOLS
    for context in [*found[:10] // base, 12345, 0]:
        assert np.exp(model.log_p(context * base + np.arange(base), perplexity.ORDER)).sum() == pytest.approx(1, abs=1e-4)
    seen = perplexity.grams(*perplexity.symbols(*at.buffer_of(at.text_column(pa.array(["the rain"])))), perplexity.ORDER)
    odd = perplexity.grams(*perplexity.symbols(*at.buffer_of(at.text_column(pa.array(["xq#zv1kj"])))), perplexity.ORDER)
    assert model.log_p(seen, perplexity.ORDER).mean() > model.log_p(odd, perplexity.ORDER).mean() + 1


def test_hash_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == brute.contamination([(1, None)], [])[0][4]


@pytest.mark.parametrize("ids", [(None, 7), (3, 7), (7, None), (None, None), (5, 5), (-(1 << 63), None)])
def test_repeats_with_null_and_reused_ids(spark, docs_of, ids):
    """The first of two copies keeps the passage, whatever their ids; every copy goes with keep="none"."""
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, texts = prose(260), []
    for k in range(len(ids)):
        texts.append(prose(149) + str(k) + passage + str(k) + prose(149))
    docs = docs_of(list(zip(ids, texts)))
    none = sorted((r.n_bytes, r.n_removed) for r in suffixes.deduplicate(docs, keep="none").collect())
    assert none == [(560, 260), (560, 260)]
    first = suffixes.deduplicate(docs, keep="first").collect()
    assert sorted(r.n_removed for r in first) == [0, 260] and {r.doc_id for r in first} == set(ids)
    if ids[0] is None and ids[1] is not None:
        assert [r.n_removed for r in first if r.doc_id is None] == [0]
    left = [r.text for r in suffixes.without_repeats(docs, keep="first").collect()]
    assert sum(passage in t for t in left) == 1


def with_crc32(raw, wanted):
    """``raw`` and six letters of ASCII that give it a CRC-32: the checksum is linear in the bits that may be flipped."""
    base = raw + b"@" * 8  # bits 0 to 4 of each byte are free and keep it a letter or a mark
    start = zlib.crc32(base)
    flips = [(at_, 1 << bit) for at_ in range(len(raw), len(base)) for bit in range(5)]
    rows = []
    for n, (at_, bit) in enumerate(flips):
        other = bytearray(base)
        other[at_] ^= bit
        rows.append((zlib.crc32(bytes(other)) ^ start, 1 << n))
    left, chosen = start ^ wanted, 0
    for k in range(32):
        pivot = next(((v, m) for v, m in rows if v >> k & 1), None)
        if pivot is None:
            assert not left >> k & 1
            continue
        rows = [(v ^ pivot[0], m ^ pivot[1]) if v >> k & 1 else (v, m) for v, m in rows]
        if left >> k & 1:
            left, chosen = left ^ pivot[0], chosen ^ pivot[1]
    out = bytearray(base)
    for n, (at_, bit) in enumerate(flips):
        if chosen >> n & 1:
            out[at_] ^= bit
    return bytes(out)


def test_texts_of_one_id_and_equal_crc32_are_different_texts(spark, docs_of):
    """Two texts under a null id whose CRC-32 agrees: only the one that repeats something loses it."""
    rng = random.Random(8)
    passage, other = "".join(rng.choices("abcdefgh ", k=260)), "".join(rng.choices("abcdefgh ", k=400))
    linked = "x" * 100 + passage + "y" * 40
    forged = with_crc32(other.encode(), zlib.crc32(linked.encode())).decode()
    assert zlib.crc32(forged.encode()) == zlib.crc32(linked.encode()) and forged != linked
    docs = docs_of([(None, linked), (None, forged), (1, "z" * 30 + passage)])
    removed = {r.n_bytes: r.n_removed for r in suffixes.deduplicate(docs, keep="none").collect()}
    assert removed == {len(linked): 260, len(forged): 0, 290: 260}


def test_kept_tables_go_before_other_operators_run():
    at.forget()  # what tests before this one kept
    path = vocabulary("word_bpe_49k.json")
    texts = pa.RecordBatch.from_arrays([pa.array(["some words here"])], ["text"])
    encode = lambda batches: (b for b in batches if len(tokens.id_table(path).values(*at.buffer_of(at.text_column(b.column(0))))[0]))
    assert list(at.lean(encode, tables=True)([texts])) == [texts]
    assert list(at.lean(encode, tables=True)([texts])) == [texts]
    assert tokens.id_table.cache_info().currsize == 1 and tokens.id_table.cache_info().hits
    assert list(at.lean(iter)([texts])) == [texts]
    assert tokens.id_table.cache_info().currsize == tokens.vocabulary.cache_info().currsize == 0


def test_powers_of_long_buffers_are_not_kept():
    buf = np.random.default_rng(1).integers(97, 100, 9000, np.uint8)
    long = suffixes.Rolling(buf).all(40)
    assert len(suffixes.Rolling._up) < len(buf)
    assert (long[:100] == suffixes.Rolling(buf[:139]).all(40)).all()


@pytest.mark.parametrize("keep", ["none", "first"])
def test_equal_contexts_meet_no_join(spark, docs_of, plan_of, keep):
    """A passage that many texts share, cut off at different places: its contexts are told by sums, and no join hands them on one by one."""
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = prose(900)
    pairs = [(i, prose(40) + passage[i % 7 * 30 : 900 - i % 5 * 40] + prose(40)) for i in range(60)]
    docs = docs_of(pairs)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        lines = plan_of(suffixes.repeated(suffixes.keyed(docs, "doc_id", "text"), keep)).splitlines()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*("))
    scans = [k for k, line in enumerate(lines) if "/repeated-" in line]
    assert scans
    for k in scans:
        deep = depth(lines[k])
        for line in reversed(lines[:k]):
            if depth(line) < deep:
                deep = depth(line)
                assert "Join" not in line, line
    rows = suffixes.deduplicate(docs, keep=keep).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute.repeated_bytes(pairs, keep=keep)
