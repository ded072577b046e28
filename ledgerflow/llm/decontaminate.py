"""Benchmark decontamination with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bound, documents, row_key, stored

WINDOW = 10
#: Windows that are broadcast at a time (about 200 bytes each).
BROADCAST_WINDOWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text in lower case; none for null. Capitals are word characters, so each word is lowered after the cut."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")
    # lower() is much faster than translate(), and right for a word without other letters
    return F.transform(words, lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(ascii_lower(w)))


def _joined(a: Column, b: Column, distance: int) -> Column:
    """Hashes of a's values with b's ``distance`` places further on."""
    n = F.greatest(F.size(b) - distance, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, distance + 1, n), lambda x, y: F.xxhash64(x, y))


def _window_hashes(words: Column, length: int) -> Column:
    """Hash of each window of ``length`` words: words are hashed once, then runs of 1, 2, 4, 8 of them, each from two shorter ones."""

    def put_together(runs: list[Column]) -> Column:
        if 2 << (len(runs) - 1) <= length:
            half = 1 << (len(runs) - 1)
            return bound(_joined(runs[-1], runs[-1], half), lambda run: put_together([*runs, run]))
        out, done = runs[-1], 1 << (len(runs) - 1)
        for k in range(len(runs) - 2, -1, -1):
            if (length - done) >> k & 1:
                out, done = _joined(out, runs[k], done), done + (1 << k)
        return out

    return bound(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: put_together([hashes]))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, n, w, items, unnamed): every distinct window of the items, its hash, length, words, the ids of its items, and whether one has none."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col).cast("string")).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(WINDOW))
    windows = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.slice("words", i, n))).alias("w"))
    code = F.coalesce(*(F.when(F.size("w") == k, F.get(_window_hashes(F.col("w"), k), 0)) for k in range(1, WINDOW + 1)))
    return windows.groupBy("w").agg(F.collect_set("item").alias("items"), F.bool_or(F.col("item").isNull()).alias("unnamed")).select(
        code.alias("h"), F.size("w").alias("n"), "w", "items", "unnamed")


def _hashes(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, _window_hashes(words, n)).otherwise(F.array().cast("array<bigint>"))


def _spread(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """(row, doc_id, words, at, code): a marker (at 0, no code) for each document, then the hashes of its windows of each length in turn."""
    marker = F.array(F.lit(None).cast("long"))
    return rows.select("row", "doc_id", "words", F.posexplode(bound(F.col("words"), lambda w: F.concat(marker, *(_hashes(w, n) for n in lengths)))).alias("at", "code"))


def _hits(rows: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(row, doc_id, n_words, hit, items, unnamed): the markers and every hit of ``windows``, which are broadcast; words decide, hashes only lead to them."""
    pos, length, start = F.lit(0), F.lit(1), F.lit(1)
    for n in lengths:  # a place in the array of hashes tells length and position
        pos, length = F.when(F.col("at") >= start, F.col("at") - start + 1).otherwise(pos), F.when(F.col("at") >= start, n).otherwise(length)
        start = start + F.greatest(F.size("words") - n + 1, F.lit(0))
    # coalesce keeps the words out of the join's key: a window is looked up by one long, and its words are compared where that meets
    words_too = F.coalesce((length == F.col("n")) & (F.slice("words", F.greatest(pos, F.lit(1)), length) == F.col("w")), F.lit(False))
    same = (F.col("code") == F.col("h")) & words_too
    return _spread(rows, lengths).join(F.broadcast(windows), same, "left").where("at = 0 or h is not null").select(
        "row", "doc_id", F.when(F.col("at") == 0, F.size("words")).alias("n_words"), F.when(F.col("at") > 0, F.struct(pos.alias("pos"), length.alias("len"))).alias("hit"), "items", "unnamed")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits) of each row of ``docs``.

    Windows of ten item words (fewer for a shorter item) are a hash set that is broadcast. Each
    document's windows are hashed in its row and looked up as they are exploded, a hit is verified
    word by word in the join itself, and one marker row a document keeps those without hits; only
    markers and hits are shuffled. Of a benchmark of more than ``BROADCAST_WINDOWS`` windows those
    whose hashes occur in the documents are found first, by a join of hashes alone; should they
    be too many as well, they are broadcast and looked up in blocks. ``hits`` has the places of hit
    windows as (pos, len), pos from 1.

    A null or empty text has no words. A null item id counts as one item and is in no item list.
    Rows are told apart by a row number within the scan, so ids may be null or repeat; repeated rows
    are each returned. An empty benchmark hits nothing; an empty table gives no rows. Other columns
    are not used.
    """
    windows = stored(benchmark_windows(benchmark), "benchmark_windows")
    sizes = {r.n: r["count"] for r in windows.groupBy("n").count().collect()}  # at most ten rows
    lengths, total = sorted(sizes), sum(sizes.values())
    texts = documents(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    if total > BROADCAST_WINDOWS:
        texts = stored(texts, "numbered_documents")  # several passes need the same row numbers
    rows = texts.select("row", "doc_id", words_of(F.col("text")).alias("words"))
    if total > BROADCAST_WINDOWS:
        met = _spread(rows, lengths).where("at > 0").select("code").join(windows.select(F.col("h").alias("code")).distinct(), "code", "left_semi").distinct()
        windows = stored(windows.join(met, windows["h"] == met["code"], "left_semi"), "benchmark_windows")
        total = windows.count()
    blocks = max(1, -(-total // BROADCAST_WINDOWS))
    found = _hits(rows, windows.where(F.pmod("h", F.lit(blocks)) == 0), lengths)
    for block in range(1, blocks):
        found = found.unionByName(_hits(rows, windows.where(F.pmod("h", F.lit(blocks)) == block), lengths).where("hit is not null"))
    each = found.groupBy("row").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.coalesce(F.bool_or("unnamed"), F.lit(False)).alias("unnamed"))
    hit_words = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1)))))
    return each.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), hit_words.cast("long").alias("n_hit"), (F.size("items") + F.col("unnamed").cast("int")).cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "hits")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, clean): each document's words without those inside hit windows, joined by spaces; each row by its own text, whatever its id."""
    hits = find_contamination(docs.select(row_key().alias("doc_id"), "text"), benchmark).where("contaminated").select(F.col("doc_id").alias("hit_key"), "hits").dropDuplicates(["hit_key"])
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), words_of(F.col("text").cast("string")).alias("words"))
    # both sides bound to lambda variables, so that neither is evaluated for each word
    clean = F.filter("words", lambda w, i: ~F.exists("hits", lambda x: (i + 1 >= x["pos"]) & (i + 1 < x["pos"] + x["len"])))
    return words.join(hits, words["row_key"] == hits["hit_key"], "left").select("doc_id", F.array_join(F.when(F.col("hits").isNull(), F.col("words")).otherwise(clean), " ").alias("clean"))


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns; each row is judged by its own text, whatever its id."""
    keyed = docs.select(row_key().alias("doc_id"), "text")
    # written first, so that its size is known: a small set is broadcast, and the texts stay where they are
    hits = stored(find_contamination(keyed, benchmark).where("contaminated").select(F.col("doc_id").alias("hit")).distinct(), "contaminated_rows")
    return docs.join(hits, row_key() == hits["hit"], "left_anti")
