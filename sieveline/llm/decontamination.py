"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are ``WINDOW`` consecutive words, or all its words if it has fewer. A
window is a set of shingles, each with its place. Shingles are ordered by rarity, which
is counted over all documents. As all of them must be there, a window's necessary
prefix is its rarest shingle; a window with a shingle that no document has is done
with. Documents meet the prefixes by a join on shingles. A meeting at a place gives the
one start that the window can have there (positional bound), which must leave room
for it (length bound); then the words are compared, one item-sized window of the
document with the item's.

All of it is DataFrame functions. The shingles of the benchmark are broadcast while they
are counted to be few; a larger benchmark meets by shuffle. Documents never leave their
scan with their text, but for the words around a meeting.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare

WINDOW, SHINGLE = 10, 3
#: What words are cut at.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows and bytes of text of a table that is broadcast.
ROWS, BYTES = 1 << 20, 32 << 20
DOC = ["doc_id", "tid"]


def words(text: Column, fold: bool = True) -> Column:
    """Words of a text, A-Z as a-z unless they are only counted; null has none."""
    text = F.coalesce(text, F.lit(""))
    text = F.translate(text, string.ascii_uppercase, string.ascii_lowercase) if fold else text
    return F.array_remove(F.split(text, BETWEEN), "")


def _few(df: DataFrame, text: str | None = None) -> DataFrame:
    """Broadcast if counting says that it is small."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.length(text)) if text else F.lit(0), F.lit(0))).first()
    return F.broadcast(df) if rows <= ROWS and size <= BYTES else df


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, wid, window, size): the distinct windows of every item, window as its words joined by spaces, wid its sha256."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("w")).where("item_id is not null and size(w) > 0")
    at = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("at"))
    cutout = at.select("item_id", F.slice("w", F.col("at") + 1, F.lit(window)).alias("w"))
    return cutout.select("item_id", F.concat_ws(" ", "w").alias("window"), F.size("w").alias("size")).distinct().withColumn("wid", F.sha2("window", 256))


def _key(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(wid, window, size, wide, offset, key): every shingle of every distinct window; wide is how many words it has."""
    one = windows.select("wid", "window", "size").distinct().withColumn("w", F.split("window", " ")).withColumn("wide", F.least("size", F.lit(shingle)))
    at = one.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("wide"))).alias("offset"))
    word = lambda i: F.get("w", F.col("offset") + i)
    key = F.coalesce(*(F.when(F.col("wide") == s, _key([word(i) for i in range(s)])) for s in range(1, shingle + 1)))
    return at.select("wid", "window", "size", "wide", "offset", key.alias("key"))


def places(docs: DataFrame, wide: list[int]) -> DataFrame:
    """(doc_id, tid, w, pos, key): a row for every shingle of every document, in each of the widths; w is the document's words."""
    at = docs.select(*DOC, words(F.col("text")).alias("w")).select(*DOC, "w", F.posexplode_outer("w").alias("pos", "word"))
    # words by their place in the array, which the generated code does not copy for its rows; the outer form, or Spark would split each text twice to drop those without words
    keys = [F.when(F.col("pos") + s <= F.size("w"), _key([F.get("w", F.col("pos") + i) for i in range(s)])) for s in wide]
    key = keys[0] if len(keys) == 1 else F.explode(F.array(*keys) if keys else F.array().cast("array<long>"))
    out = at.select(*DOC, "w", "pos", key.alias("key"))
    return out.where("key is not null")


def occurrences(docs: DataFrame, windows: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, tid, start, size, wid): where the windows occur in documents (doc_id, tid, text), each place once; a written table."""
    shingles = cut(window_shingles(windows, shingle))
    wide = sorted(r[0] for r in shingles.select("wide").distinct().collect())  # at most ``shingle`` numbers
    at = places(docs, wide)

    known = shingles.select("key").distinct()
    if known.count() <= ROWS:
        counts = at.select("key").join(F.broadcast(known), "key").groupBy("key").agg(F.count("*").alias("rows"))
    else:
        counts = at.groupBy("key").agg(F.count("*").alias("rows")).join(known, "key")
    rarity = shingles.join(cut(counts), "key", "left").na.fill(0, ["rows"])
    rarest = rarity.groupBy("wid").agg(F.min(F.struct("rows", "key", "offset")).alias("r"), F.min("window").alias("window"), F.min("size").alias("size"))
    index = cut(rarest.where("r.rows > 0").select("r.key", "r.offset", "wid", "window", "size"))

    prefixes, low = index.select("key").distinct(), F.greatest(F.col("pos") - window + 1, F.lit(0))
    around = [*DOC, "pos", "key", F.size("w").alias("n"), low.alias("low"), F.slice("w", low + 1, F.lit(2 * window - 1)).alias("near")]
    if prefixes.count() <= ROWS:
        met = at.join(F.broadcast(prefixes), "key", "left_semi").select(*around)
    else:
        met = at.select(*around).join(prefixes, "key", "left_semi")
    start = F.col("pos") - F.col("offset")
    met = met.join(_few(index, "window"), "key").withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n")))
    same = F.concat_ws(" ", F.slice("near", F.col("start") - F.col("low") + 1, F.col("size"))) == F.col("window")
    return cut(met.where(same).select(*DOC, "start", "size", "wid").distinct())


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for every row of documents.

    Null texts and texts without words have no words and no hits. Items without
    item_id or words take no part; rows of one item_id are one item with the windows of
    all. Repeated documents each have their row, with or without a doc_id. Other columns
    are ignored. Without items no document is hit; an empty documents table gives no
    rows.
    """
    prepare(documents.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))
    windows = cut(item_windows(benchmark, window))
    found = occurrences(docs, windows, window, shingle)

    # covered words: of windows in the order of their starts, what reaches beyond all before
    last = F.max("end").over(Window.partitionBy(*DOC).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    spans = found.groupBy(*DOC, "start").agg((F.col("start") + F.max("size")).alias("end")).withColumn("before", F.coalesce(last, F.lit(0)))
    hit = spans.groupBy(*DOC).agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "before"), F.lit(0))).cast("long").alias("n_hit"))
    # documents with the same windows have the same items, which are looked up once for all of them
    sets = found.groupBy(*DOC).agg(F.sort_array(F.collect_set("wid")).alias("wids")).select(*DOC, F.sha2(F.concat_ws(",", "wids"), 256).alias("profile"), "wids")
    sets = cut(sets)
    pairs = sets.groupBy("profile").agg(F.first("wids").alias("wids")).select("profile", F.explode("wids").alias("wid")).join(windows.select("wid", "item_id"), "wid").select("profile", "item_id").distinct()
    items = pairs.groupBy("profile").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item_id"))), 256).alias("items_sha256"))
    same = lambda a, b: (a["doc_id"].eqNullSafe(b["doc_id"])) & (a["tid"] == b["tid"])
    named = sets.select(*DOC, "profile").join(items, "profile")
    told = cut(hit.join(named, same(hit, named)).select(hit["doc_id"], hit["tid"], "n_hit", "n_items", "items_sha256"))
    counted = docs.select(*DOC, F.size(words(F.col("text"), fold=False)).cast("long").alias("n_words"))
    out = counted.join(told, same(counted, told), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(counted["doc_id"], "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, w[i : i + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)
), spots AS (
  SELECT row, i, size, w[i : i + size - 1] AS win FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), found AS (SELECT row, i, s.size, item_id FROM spots s JOIN windows USING (win)
), hit AS (SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(range(i, i + size)) AS p FROM found) GROUP BY row
), named AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT row, item_id FROM found) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""
