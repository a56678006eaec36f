"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

The index holds a posting (term, doc, doc_id, pos) for every occurrence in the training texts of a word that the benchmark
uses; postings of other words would never be read. It is written by the tasks that read the texts, without a shuffle, as
one segment each. A posting of the term ``END`` closes every text and holds its number of words.

A window of an item can only occur where its rarest term does. The postings of that term, shifted by its offset, are
intersected with those of the window's second rarest term; the few places left are intersected with the postings of all
the item's terms. On one diagonal (text position less item position) the positions found then fall into runs, and a run of
a whole window or more is an exact match of each of its windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A null or empty text has no words: such a
document is returned clean and such an item matches nothing. An item whose item_id is null marks words as hit but is not
listed or counted among the items. Repeated document rows are judged one by one; repeated item rows add nothing. Extra
columns are not read. An empty benchmark leaves every document clean; an empty documents table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure.llm.shared import small, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END = -1


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), "")


def item_terms(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One stored row per item word: item, item_id, n (words of the item), p, word."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).distinct()
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "items")
    return items.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("p", "word"))


def vocabulary(items: DataFrame) -> DataFrame:
    """A stored number for every benchmark word, and ``END`` for the empty word that closes a text."""
    terms = items.select("word").distinct().withColumn("term", F.monotonically_increasing_id())
    end = items.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(END).cast("long").alias("term"))
    return stored(terms.union(end), "terms")


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored postings of ``terms`` in whole texts: term, doc (a number of the row), doc_id, pos."""
    texts = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("doc_id"), F.concat(words(F.col(text_col)), F.array(F.lit(""))).alias("w"))
    postings = texts.select("doc", "doc_id", F.posexplode("w").alias("pos", "word"))
    return stored(postings.join(small(terms), "word").select("term", "doc", "doc_id", "pos"), "postings")


def ranked_windows(index: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """For every window that can occur, the item positions and terms of its rarest and second rarest words."""
    frequency = index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("df"))
    last = F.col("n") - F.least(F.col("n"), F.lit(window))
    starts = F.sequence(F.greatest(F.lit(0), F.col("p") - window + 1), F.least(F.col("p"), last))
    ranked = items.join(frequency, "term", "left").select("item", "p", "term", F.coalesce("df", F.lit(0)).alias("df"), F.explode(starts).alias("s"))
    best = F.array_sort(F.collect_list(F.struct("df", "p", "term")))  # at most `window` entries
    both = ranked.groupBy("item", "s").agg(best.alias("r")).where(F.col("r")[0]["df"] > 0)
    other = F.element_at("r", F.least(F.lit(2), F.size("r")))
    return both.select("item", F.col("r")[0]["p"].alias("p1"), F.col("r")[0]["term"].alias("t1"), other["p"].alias("p2"), other["term"].alias("t2")).distinct()


def exact_runs(index: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """Maximal runs of text words that match consecutive words of an item over a whole window at least: item, item_id,
    doc, first, last. ``items`` has terms."""
    pairs = stored(ranked_windows(index, items, window), "pairs")
    of = lambda c, name: pairs.select(F.col(c).alias("term")).distinct().transform(small)
    # The rarest term's postings, moved to where the second must stand.
    first = index.join(of("t1", "first"), "term", "left_semi").join(small(pairs), F.col("term") == F.col("t1")).select("item", "doc", (F.col("pos") - F.col("p1")).alias("diag"), F.col("t2").alias("term"), (F.col("pos") - F.col("p1") + F.col("p2")).alias("pos"))
    second = index.join(of("t2", "second"), "term", "left_semi").select("term", "doc", "pos")
    places = stored(first.join(second, ["doc", "pos", "term"], "left_semi").select("item", "doc", "diag").distinct(), "places")

    wanted = places.join(small(items), "item").select("item", "item_id", "n", "doc", "diag", "p", "term", (F.col("diag") + F.col("p")).alias("pos")).where("pos >= 0")
    near = index.join(small(stored(places.select("doc").distinct(), "candidates"), 1_000_000), "doc", "left_semi").select("term", "doc", "pos")
    found = wanted.join(near, ["doc", "pos", "term"], "left_semi")
    line = Window.partitionBy("item", "doc", "diag").orderBy("p")  # at most the words of an item
    runs = found.withColumn("run", F.col("p") - F.row_number().over(line)).groupBy("item", "item_id", "n", "doc", "diag", "run").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    whole = F.col("hi") - F.col("lo") + 1 >= F.least(F.col("n"), F.lit(window))
    return runs.where(whole).select("item", "item_id", "doc", (F.col("diag") + F.col("lo")).alias("first"), (F.col("diag") + F.col("hi")).alias("last"))


def with_terms(items: DataFrame, terms: DataFrame) -> DataFrame:
    return stored(items.join(terms, "word").drop("word"), "item-terms")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document row: doc (its number), doc_id, n_words, n_hit (words inside an occurrence of a window), n_items,
    items_sha256 (of the sorted, comma-joined item ids) and contaminated."""
    items = item_terms(benchmark, item_col, item_text_col)
    terms = vocabulary(items)
    index, items = build_index(docs, terms, id_col, text_col), with_terms(items, terms)
    runs = stored(exact_runs(index, items, window), "runs")
    spots = runs.select("doc", "first", "last").distinct().select("doc", F.explode(F.sequence("first", "last")).alias("pos")).distinct()
    hits = spots.groupBy("doc").agg(F.count("*").alias("n_hit"))
    listed = runs.where("item_id is not null").select("doc", "item_id").distinct().groupBy("doc").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item_id"))).alias("ids"))
    closing = index.where(F.col("term") == END).select("doc", "doc_id", F.col("pos").cast("long").alias("n_words"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return closing.join(hits, "doc", "left").join(listed, "doc", "left").select(
        "doc", "doc_id", "n_words", n("n_hit"), n("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated")
    )


def proximity(docs: DataFrame, benchmark: DataFrame, terms_per_item: int = 3, span: int = 20) -> DataFrame:
    """Documents where an item's rarest ``terms_per_item`` terms (all, if it has fewer) stand within fewer than ``span``
    words of an occurrence of the rarest one: doc_id, item_id, pos (of that occurrence)."""
    items = item_terms(benchmark)
    terms = vocabulary(items)
    index, items = build_index(docs, terms), with_terms(items, terms)
    frequency = index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("df"))
    ranked = items.select("item", "item_id", "term").distinct().join(frequency, "term", "left")
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), "term"))).where(F.col("r") <= terms_per_item)
    ranked = stored(ranked.withColumn("k", F.count("*").over(Window.partitionBy("item"))), "ranked")
    anchors = index.join(small(ranked.where("r = 1").select("item", "item_id", "k", "term")), "term").select("item", "item_id", "k", "doc", "doc_id", F.col("pos").alias("at"))
    cell = F.floor(F.col("at") / span)
    asked = anchors.join(small(ranked.where("r > 1").select("item", "term")), "item", "left").withColumn("cell", F.explode(F.sequence(cell - 1, cell + 1)))
    lists = index.withColumn("cell", F.floor(F.col("pos") / span)).select("term", "doc", "cell", "pos")
    near = asked.join(lists, ["term", "doc", "cell"], "left").where("k = 1 or abs(pos - at) < %d" % span)
    seen = near.groupBy("doc", "doc_id", "item", "item_id", "k", "at").agg(F.count_distinct("term").alias("others"))
    return seen.where("others = k - 1").select("doc_id", "item_id", F.col("at").alias("pos"))
