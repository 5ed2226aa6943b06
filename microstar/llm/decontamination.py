"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's windows are sets of word shingles that a document must hold whole,
so of each window one shingle, the prefix, is enough to find every document
that can hold it.  Shingles are ordered by their count over all documents and
the rarest is the prefix; a window whose rarest shingle occurs nowhere is
done with.  Documents meet the prefixes at the places of their shingles; the
place within the window fixes where the window would have to start and end
(length and positional bounds), and the words there are compared with the
window's.

Documents are never shuffled by their words: a pass is a scan that probes a
broadcast block of prefixes.  A block holds at most ``block_bytes``; a larger
benchmark is met block by block, all of it.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from microstar.llm.common import written

_UPPER = "".join(map(chr, range(0x41, 0x5B)))
_BETWEEN = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

#: Bytes that a row takes in a broadcast block besides its words, and a word besides its characters.
_ROW_BYTES, _WORD_BYTES = 96, 24


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased, in order (null: none).

    One translation folds case and turns all that is between words into
    spaces, so no pattern has to be matched.
    """
    folded = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BETWEEN, _UPPER.lower() + " " * len(_BETWEEN))
    return F.array_remove(F.split(folded, " "), "")


def _shingles(frame: DataFrame, size: int, *keep: str) -> DataFrame:
    """(*keep, word_list, place, shingle) for every ``size`` consecutive words of ``word_list``."""
    last = F.size("word_list") - size
    at = frame.select(*keep, "word_list", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("place"))
    key = F.xxhash64(*[F.get("word_list", F.col("place") + i) for i in range(size)])
    return at.select(*keep, "word_list", "place", key.alias("shingle"))


def _blocks(frame: DataFrame, row_bytes: Column, by: str, block_bytes: int) -> list[DataFrame]:
    """``frame`` cut by a hash of ``by`` into parts of about ``block_bytes``, each small enough to broadcast.

    The bytes are summed over the whole frame first; half of the bound is
    left for uneven parts.
    """
    total = frame.agg(F.sum(row_bytes)).first()[0] or 0
    n = ceil(2 * total / block_bytes)
    return [frame.where(F.pmod(F.xxhash64(F.lit("block"), by), F.lit(n)) == i) if n > 1 else frame for i in range(n)]


def item_windows(items: DataFrame, length: int = 10, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(window, window_words)`` of all items, and ``(window, item_id)`` of which item has which.

    A window is ``length`` consecutive words of an item; an item of fewer
    words is one window, one without words has none.  Both are written tables.
    """
    listed = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("word_list")).where(F.size("word_list") > 0)
    last = F.greatest(F.size("word_list") - length, F.lit(0))
    each = listed.select("item_id", "word_list", F.explode(F.sequence(F.lit(0), last)).alias("place")).select(
        "item_id", F.slice("word_list", F.col("place") + 1, length).alias("window_words"))
    each = written(each.distinct(), "item-windows")
    windows = written(each.select("window_words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    return windows, written(each.join(windows, "window_words").select("window", "item_id"), "window-items")


def prefixes(docs: DataFrame, windows: DataFrame, shingle: int = 5, block_bytes: int = 32 << 20, text: str = "text") -> DataFrame:
    """The rarest shingle of each window that may occur: ``window, window_words, size, place, shingle, n``.

    A shingle has ``shingle`` words, or as many as its window if that has
    fewer.  ``n`` counts its places in all documents; ties go to the smaller
    hash, then to the earlier place.  Windows with a shingle that occurs
    nowhere are left out: no document holds them.
    """
    sizes = _sizes(windows, shingle)
    listed = docs.select(words(F.col(text)).alias("word_list"))
    own, counted = [], []
    for size in sizes:
        mine = windows.where(F.least(F.size("window_words"), F.lit(shingle)) == size)
        part = _shingles(mine.withColumnRenamed("window_words", "word_list"), size, "window")
        own.append(part.select("window", F.lit(size).alias("size"), "place", "shingle"))
    if not own:
        return windows.select("window", "window_words", *[F.lit(None).cast(t).alias(c) for c, t in
                              (("size", "int"), ("place", "int"), ("shingle", "long"), ("n", "long"))])
    shingles = own[0]
    for part in own[1:]:
        shingles = shingles.union(part)
    shingles = written(shingles, "window-shingles")
    for size in sizes:
        keys = shingles.where(F.col("size") == size).select("shingle").distinct()
        for block in _blocks(keys, F.lit(_ROW_BYTES), "shingle", block_bytes):
            found = _shingles(listed, size).select("shingle").join(F.broadcast(block), "shingle")
            counted.append(found.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.lit(size)))
    counts = counted[0]
    for part in counted[1:]:
        counts = counts.union(part)
    counts = written(counts, "shingle-counts")
    rarest = (shingles.join(counts, ["size", "shingle"], "left").groupBy("window")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place", "size")).alias("least"))
              .select("window", "least.*").where("n > 0"))
    return written(windows.join(rarest, "window"), "prefixes")


def _sizes(windows: DataFrame, shingle: int) -> list[int]:
    """The shingle lengths needed, ``shingle`` of them at most."""
    return sorted(r[0] for r in windows.select(F.least(F.size("window_words"), F.lit(shingle))).distinct().collect())


def occurrences(docs: DataFrame, prefix: DataFrame, block_bytes: int = 32 << 20, text: str = "text") -> DataFrame | None:
    """Where documents hold windows: ``text_1, text_2, start, length, window``, distinct; None without prefixes.

    A document goes by the 128-bit hash of its text, so equal texts have
    their occurrences once.  ``start`` counts words from 0.
    """
    listed = docs.select(*_text_key(text), words(F.col(text)).alias("word_list"))
    n_words = F.size("window_words")
    row_bytes = _ROW_BYTES + n_words * _WORD_BYTES + F.length(F.array_join("window_words", ""))
    found = None
    sizes = sorted(r[0] for r in prefix.select("size").distinct().collect())
    for size in sizes:
        mine = prefix.where(F.col("size") == size).select("window", "window_words", F.col("place").alias("within"), "shingle")
        for block in _blocks(mine, row_bytes, "window", block_bytes):
            met = _shingles(listed, size, "text_1", "text_2").join(F.broadcast(block), "shingle")
            start = F.col("place") - F.col("within")
            met = met.where((start >= 0) & (start + n_words <= F.size("word_list")))
            met = met.where(F.slice("word_list", F.greatest(start, F.lit(0)) + 1, n_words) == F.col("window_words"))
            part = met.select("text_1", "text_2", start.alias("start"), n_words.alias("length"), "window")
            found = part if found is None else found.union(part)
    return None if found is None else written(found.distinct(), "occurrences")


def _text_key(text: str) -> list[Column]:
    held = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(held).alias("text_1"), F.xxhash64(F.lit("second"), held).alias("text_2")]


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 10, shingle: int = 5, block_bytes: int = 32 << 20,
                  doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if it lies inside any occurrence of a window of an item.
    One row per input row; repeated rows fare alike.  Null and empty texts
    have no words, no items and the digest of the empty text; an item without
    words is never found.  Items that share an id count once; a null item id
    counts as one item, shown as an empty text.  A null ``doc_id`` stays null.
    Empty tables give no rows, or rows without hits.  Other columns of both
    tables are not read.  Texts go by a 128-bit hash.
    """
    windows, window_items = item_windows(items, length, item_id, text)
    prefix = prefixes(docs, windows, shingle, block_bytes, text)
    found = occurrences(docs, prefix, block_bytes, text)
    base = docs.select(F.col(doc_id).alias("doc_id"), *_text_key(text), F.size(words(F.col(text))).cast("long").alias("n_words"))
    if found is None:
        own = base.withColumns({"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "ids": F.lit("")})
    else:
        key = ["text_1", "text_2"]
        hit = (_spans(found).groupBy(*key).agg(F.sum("n_new").alias("n_hit")))
        shown = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
        held = (found.select(*key, "window").distinct().join(window_items, "window").select(*key, shown.alias("item")).distinct()
                .groupBy(*key).agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("ids")))
        own = base.join(hit.join(held, key), key, "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return own.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _spans(found: DataFrame) -> DataFrame:
    """For each start of an occurrence the words it adds to those covered by earlier starts (a text's own occurrences, in order)."""
    longest = found.groupBy("text_1", "text_2", "start").agg(F.max("length").alias("length"))
    end = F.col("start") + F.col("length")
    before = Window.partitionBy("text_1", "text_2").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.coalesce(F.max(end).over(before), F.lit(0)), F.col("start"))
    return longest.select("text_1", "text_2", F.greatest(end - reached, F.lit(0)).alias("n_new"))


#: Windows meet documents by equality of whole word lists, one length at a time.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_slice(w, o, o + 9) AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS o FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT r, p, n, list_slice(w, p, p + n - 1) AS win
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes)),
hits AS (SELECT DISTINCT r, p, n, item_id FROM dw JOIN bw USING (win)),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
         FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN held USING (r)
"""
