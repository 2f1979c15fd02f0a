"""MinHash near-dedup by an inverted join on signature coordinates.

Each distinct shingle set gets a signature of ``COORDINATES`` values; one coordinate
folds ``FOLD`` independent minima, so that two sets agree on it with probability
J**FOLD and boilerplate shared by unlike documents does not build long posting
lists. A set is posted under its coordinate-value pairs. Two sets that agree on at
least ``MATCHES`` coordinates must meet under one of the first
``COORDINATES - MATCHES + 1`` (prefix filter), so only those are posted; the
remaining coordinates are skipped in the merge and probed directly on the two
signatures when collisions are counted. Pairs at or above the threshold are then
confirmed on their full shingle sets.

At J = 0.75 a pair is missed with probability below 1e-5 (32 coordinates of 3
minima, 3 matches).

No posting list is ever expanded into all its pairs. Exact copies (equal sets)
share one node. Each round takes hubs of every posting list that still spans several
components, one in the first round and twice as many in each round after, tests the
list's other components against them, contracts the confirmed links and drops the
hubs from the list; once the pairs left across components number no more than
``LINEAR`` times the nodes, they are tested directly. If a round leaves more, the shingles that only one open set has are
counted: such a shingle is in no intersection, so a set with few others cannot
reach the similarity, and leaves the lists for good. What sets share with their
list's hub, and what they have besides, bounds their overlaps with each other. ``PROBES`` pairs a node may then be held against
these bounds. Rounds end either way, because every round shortens every open list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, distinct_texts, documents, met, prepare
from .components import components

SHINGLE, PERCENT = 5, 75
COORDINATES, FOLD, MATCHES = 32, 3, 3
LINEAR, PROBES = 4, 128
#: Ids that a broadcast may hold; more are joined by shuffle. Keys with more than 1 / HOT of the rows are joined by broadcast.
BROADCAST_IDS, HOT = 500_000, 10_000
#: Pairs of one set that are tested in a row, so that the set is sent once.
TOGETHER = 256
#: Rows a file of the tables that rounds write: nodes with signatures, posting rows, pairs of sets.
NODE_ROWS, LIST_ROWS, PAIR_ROWS = 20_000, 500_000, 5_000


def shingles(words: K.Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the documents' n-word shingles and the first of each document; fewer words give one shingle."""
    h = words.hashes(fold_case=True)
    counts = words.counts()
    at, many = K.gram_starts(words.first, n)
    short = np.flatnonzero((counts > 0) & (counts < n))
    first = np.concatenate([[0], np.cumsum(np.where(many > 0, many, (counts > 0).astype(np.int64)))])
    out = np.empty(int(first[-1]), K.U64)
    full = np.ones(len(out), bool)
    full[first[short]] = False
    out[full] = K.grams(h, n)[at] if len(at) else 0
    for i in short:
        a, b = words.first[i], words.first[i + 1]
        out[first[i]] = K.mix(K.grams(h[a:b], int(b - a)) + K.U64(int(b - a)))[0]
    return out, first


def _distinct(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document, sorted within it, and the first of each document."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(g, kind="stable")
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.searchsorted(doc[new], np.arange(len(first)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = K.mix(np.arange(1, COORDINATES * FOLD + 1, dtype=K.U64) * K.U64(K.BASE)) | K.U64(1)
    for batch in K.slices(batches):
        g, first = _distinct(*shingles(K.Words(batch.column("text"))))
        n = np.diff(first)
        some = np.flatnonzero(n)
        at = first[:-1][some]
        sig = np.zeros((len(n), COORDINATES), K.U64)
        mark = np.zeros((len(n), 2), K.U64)
        if len(some):
            for c in range(COORDINATES):
                key = np.full(len(some), c + 1, K.U64)
                for k in range(FOLD):
                    key = K.mix(key * K.GRAM + np.minimum.reduceat(g * seeds[c * FOLD + k], at))
                sig[some, c] = key
            mark[some, 0] = np.add.reduceat(g, at)
            mark[some, 1] = np.add.reduceat(K.mix(g + K.GRAM), at)
        flat = pa.array(sig.reshape(-1).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tid"), pa.array(n.astype(np.int64)), pa.array(mark[:, 0].view(np.int64)), pa.array(mark[:, 1].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * COORDINATES), flat)],
            names=["doc_id", "tid", "n_shingles", "m1", "m2", "sig"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.slices(batches):
        g, first = _distinct(*shingles(K.Words(batch.column("text"))))
        at = first.astype(np.int64) * 8
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(at), pa.py_buffer(g)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("node"), packed], names=["node", "packed"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.slices(batches):
        g, first = _distinct(*shingles(K.Words(batch.column("text"))))
        node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), np.diff(first))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(g.view(np.int64))], names=["node", "g"])


def _partnered(lists: DataFrame, hubs: DataFrame, texts: DataFrame, reps: DataFrame, files: int) -> DataFrame:
    """The lists without the sets that can have no link in them; common: what a set shares with other open sets.

    Sets a and b link only if they share PERCENT / (100 + PERCENT) of their summed
    sizes, and what they share, two open sets have. Open sets hold every set that a
    list still compares and the hubs, so the bound is exact.
    """
    open_nodes = lists.select("node").union(hubs.select("node")).distinct()
    rows = _texts(texts, reps, open_nodes, files).mapInArrow(K.released(_shingle_rows), "node long, g long")
    alone = rows.groupBy("g").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    sized = lists.drop("common").join(alone, "node", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    least = sized.groupBy("key").agg(F.min("n").alias("least"))
    return cut(sized.join(least, "key").where(f"{100 + PERCENT} * common >= {PERCENT} * (n + least)").select(*lists.columns), files)


def _texts(texts: DataFrame, reps: DataFrame, nodes: DataFrame, files: int) -> DataFrame:
    """(node, text) of the nodes; ids are broadcast if there are few, so that texts need not move."""
    wanted = cut(reps.join(nodes, "node", "left_semi"), files)
    return texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, ["doc_id", "tid"]).select("node", "text")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair's full sets: the overlap, whether it is a link, and what either has more, unless they are far apart.

    Rows (a, b, packed): the set of a, with b null, comes before the sets of its partners b.
    """
    held = np.zeros(0, K.U64)
    for batch in batches:
        packed, is_pair = batch.column("packed"), batch.column("b").is_valid().to_numpy(zero_copy_only=False)
        pairs = np.flatnonzero(is_pair)
        overlap, linked, more = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool), ([], [])
        at = 0
        for i in range(batch.num_rows):
            b = np.frombuffer(packed[i].as_buffer(), K.U64)
            if not is_pair[i]:
                held = b.copy()
                continue
            only_a, only_b = np.setdiff1d(held, b, assume_unique=True), np.setdiff1d(b, held, assume_unique=True)
            both = len(held) - len(only_a)
            overlap[at], linked[at] = both, both > 0 and 100 * both >= PERCENT * (len(held) + len(b) - both)
            near = 2 * both >= max(len(held), len(b))
            for side, only in zip(more, (only_a, only_b), strict=True):
                side.append(only.view(np.int64) if near else None)
            at += 1
        rows = pa.array(pairs)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows), pa.array(overlap), pa.array(linked), *(pa.array(side, pa.list_(pa.int64())) for side in more)], names=["a", "b", "both", "linked", "more_a", "more_b"])


def _collisions() -> Column:
    return F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _near_hubs(open_: DataFrame, hubs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of a list's hub a and a member b in another component whose whole signatures agree often enough."""
    left = open_.select("key", F.col("node").alias("b"), "label", F.col("n").alias("nb")).join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    right = hubs.join(nodes.select(F.col("node").alias("hub_now"), F.col("sig").alias("sa"), F.col("n").alias("na")), "hub_now").withColumnRenamed("key", "hub_key")
    sized = F.expr(f"label <> hub_label and 100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    return left.join(right, (F.col("key") == F.col("hub_key")) & sized & (_collisions() >= MATCHES)).select(F.col("hub_now").alias("a"), "b").distinct()


def _across(lists: DataFrame, nodes: DataFrame, tested: DataFrame) -> DataFrame:
    """The pairs of different components that some list has, whose signatures agree and whose bounds allow a link.

    tested has what sets share with their list's hub, have more than it and miss of it.
    From that the overlap of two sets follows exactly, so only links are left, and the
    pairs with a set that is too far from its hub to have been tested. Every condition is
    part of the join, and a pair comes from its first common coordinate only, so what
    the join makes are distinct candidates.
    """
    seen = tested.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.col("both").alias("x"), F.col("more_a").alias("more"), F.col("more_b").alias("miss"))
    seen = seen.unionByName(tested.select(F.col("b").alias("node"), F.col("a").alias("hub"), F.col("both").alias("x"), F.col("more_b").alias("more"), F.col("more_a").alias("miss")))
    wide = lists.join(seen, ["node", "hub"], "left").join(nodes.select("node", "sig"), "node")
    cols = {"node": "", "label": "l", "n": "n", "common": "c", "x": "x", "sig": "s", "more": "m", "miss": "d"}
    one, two = (wide.select("key", *(["c"] if side == "a" else []), *(F.col(k).alias(v + side) for k, v in cols.items())) for side in "ab")
    one, two = one.withColumnRenamed("c", "at"), two.withColumnRenamed("key", "key_b")
    sized = f"a < b and la <> lb and 100 * least(na, nb) >= {PERCENT} * greatest(na, nb) and {100 + PERCENT} * least(ca, cb) >= {PERCENT} * (na + nb)"
    bound = f"ma is null or mb is null or {100 + PERCENT} * (xa - size(db) + size(array_intersect(da, db)) + size(array_intersect(ma, mb))) >= {PERCENT} * (na + nb)"
    first = F.array_position(F.zip_with("sa", "sb", lambda x, y: x == y), True) == F.col("at") + 1
    return one.join(two, (F.col("key") == F.col("key_b")) & F.expr(sized) & first & (_collisions() >= MATCHES) & F.expr(bound)).select("a", "b")


def _tested(likely: DataFrame, texts: DataFrame, reps: DataFrame, files: int | None) -> DataFrame:
    """(a, b, both, linked, more_a, more_b) of the candidate pairs, from their full sets."""
    likely = cut(likely, files)
    files = 1 + likely.count() // PAIR_ROWS
    needed = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct()
    sets = cut(_texts(texts, reps, needed, files).mapInArrow(K.released(_sets), "node long, packed binary"))
    # the set of a goes once to every chunk of its partners, whose sets follow it; few sets have more than a chunk
    chunks = likely.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).alias("chunks"))
    many = cut(chunks.where("chunks > 1"), 1)
    many = F.broadcast(many) if many.count() <= BROADCAST_IDS else many
    heads = chunks.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1).cast("array<long>")).alias("chunk")).join(sets.withColumnRenamed("node", "a"), "a")
    partners = likely.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("chunks", F.lit(1))).alias("chunk")).join(sets.withColumnRenamed("node", "b"), "b")
    rows = heads.unionByName(partners).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first()).select("a", "b", "packed")
    return cut(rows.mapInArrow(K.released(_confirm), "a long, b long, both long, linked boolean, more_a array<long>, more_b array<long>"), files)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    docs needs doc_id and text; other columns are ignored. Words are compared with
    A-Z lower-cased. Null, empty and white-space texts have no shingle, link with
    nothing and are kept. Rows that share a doc_id count as one document of a
    component, whatever their texts. A row without doc_id takes no part: its
    component_id is null and it is not kept. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    docs = documents(docs)
    texts = distinct_texts(docs)
    sketches = cut(docs.withColumn("tid", F.xxhash64("text")).mapInArrow(K.released(_sketch), "doc_id long, tid long, n_shingles long, m1 long, m2 long, sig array<long>"))
    named = sketches.where("doc_id is not null and n_shingles > 0")
    # exact copies: one node for each distinct set, whose text is the first document's
    same = ["n_shingles", "m1", "m2"]
    classes = named.groupBy(*same).agg(F.min(F.struct("doc_id", "tid")).alias("rep"), F.count("*").alias("rows"), F.first("sig").alias("sig"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), 1 + sketches.count() // NODE_ROWS)
    mine = cut(met(named.select("doc_id", *same), classes.select(*same, "node", "rows"), same, HOT).select("doc_id", "node"))
    nodes = classes.select("node", F.col("n_shingles").alias("n"), "sig")
    reps = classes.select("node", "rep.doc_id", "rep.tid")

    prefix = COORDINATES - MATCHES + 1
    posted = nodes.select("node", "n", F.posexplode(F.slice("sig", 1, prefix)).alias("c", "v"))
    posted = posted.select(F.xxhash64("c", "v").alias("key"), "c", "node", "n", F.col("n").alias("common"))
    shared = posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    total = nodes.count()
    lists = cut(posted.join(shared, "key"), 1 + prefix * total // LIST_ROWS)
    files = 1 + lists.count() // LIST_ROWS
    # a doc_id repeated with different texts belongs to several nodes, which are then one
    again = mine.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    links = mine.join(again.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    links = docs.sparkSession.createDataFrame([], "a long, b long") if again.isEmpty() else cut(links)

    labels, tested, turn, bounded = None, None, 0, False
    while True:
        open_ = (lists.join(labels, "node", "left") if labels is not None else lists.withColumn("label", F.lit(None).cast("long"))).withColumn("label", F.coalesce("label", "node"))
        spans = open_.groupBy("key", "label").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("own")).where("all * all > own")
        open_ = cut(open_.join(spans.select("key", "all", ((F.col("all") * F.col("all") - F.col("own")) / 2 / F.col("all")).alias("w")), "key"), files)
        left = open_.agg(F.sum("w")).first()[0]
        if not left:
            break
        open_ = open_.drop("w")
        if turn and left > LINEAR * total and not bounded:
            lists, bounded = _partnered(open_.drop("label", "all"), open_.select(F.col("hub").alias("node")), texts, reps, files), True
            continue
        if turn and left <= (PROBES if bounded else LINEAR) * total:
            found = _tested(_across(open_.drop("all"), nodes, tested), texts, reps, None)
            labels = components(links.union(found.where("linked").select("a", "b")), files=files)
            break
        order = F.xxhash64("node", F.lit(turn))
        first = open_.groupBy("key").agg(F.min_by(F.struct("node", "label"), F.struct(order, "node")).alias("h")).select("key", F.col("h.node").alias("hub_now"), F.col("h.label").alias("hub_label"))
        more = open_.where(F.pmod(order, "all") < 2**turn - 1).select("key", F.col("node").alias("hub_now"), F.col("label").alias("hub_label"))
        hubs = cut(first.union(more).distinct() if turn else first, files)
        now = _tested(_near_hubs(open_, hubs, nodes), texts, reps, files)
        links = links.union(now.where("linked").select("a", "b"))
        labels = components(links, files=files)
        rest = open_.join(hubs.select("key", F.col("hub_now").alias("node")), ["key", "node"], "left_anti").drop("label", "all")
        if not turn:
            rest, tested = rest.join(hubs.select("key", F.col("hub_now").alias("hub")), "key"), now
        lists = cut(rest, files)
        turn += 1
    if labels is None:
        labels = components(links)
    found = mine.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label")).groupBy("doc_id").agg(F.min("label").alias("label"))
    found = cut(found)
    names = cut(found.groupBy("label").agg(F.min("doc_id").alias("component"), F.count("*").alias("rows")))
    found = met(found, names, ["label"], HOT).select("doc_id", "component")
    out = sketches.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, min(reach.b)::BIGINT AS component_id, sets.doc_id = min(reach.b) AS kept
FROM sets JOIN reach ON reach.a = sets.doc_id GROUP BY sets.doc_id, len(s)
"""
