"""Substring dedup by relative Lempel-Ziv parsing over indexed reference blocks.

Documents are cut into blocks by content, so that equal passages are cut alike
wherever they stand: a window of ``WINDOW`` words belongs to the anchor with the
smallest hash among its ``ANCHOR``-word sequences, and a block is a run of windows
of one document with one anchor. The index of reference blocks holds each distinct
block with its source: the smallest doc_id that has it, and the place there.

A document is parsed greedily from left to right. A factor starts at a block that the
index has in a smaller document, and grows block by block as long as the next block
is the one that follows in the same source; where it is not, the next factor starts.
Every factor is at least a window, the sufficient length, so its words are a
duplicate span. Blocks that no smaller document has as a whole are literals, yet
windows of theirs can be elsewhere: beside factors, and where no block is copied
whole. So the windows of such boundary blocks are looked up one by one among the
boundary blocks with the same anchor. A window determines its anchor, so nothing else
can hold it, and the spans found are all there are.

The index is one table for all reference blocks instead of an index for each: a block
is looked up by its hash. A passage that a third of the documents share is one block
hash with a partial minimum, never a group in a task, and where rows meet the index,
keys with many rows are broadcast (no more than ``HOT`` keys can have a share of
1 / ``HOT`` of the rows). Anchors, blocks and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import cut, distinct_texts, documents, met, prepare

WINDOW, ANCHOR = 50, 12
#: Keys with more than this share of all rows are joined by broadcast: there are at most HOT of them.
HOT = 10_000
#: Windows that can share one occurrence of an anchor; longer runs (periodic text) are cut.
RUN = WINDOW - ANCHOR + 1


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _windows(words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per window of the slice: hash, anchor, document, place in it; and the windows of each document."""
    h = words.hashes()
    at, many = K.gram_starts(words.first, WINDOW)
    if not len(at):
        none = np.zeros(0, K.U64)
        return none, none, at, at, many
    up, down = K._powers(len(h) + 1)
    total = np.zeros(len(h) + 1, K.U64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    window = K.mix((total[at + WINDOW] - total[at]) * down[at])
    anchor = _least(K.grams(h, ANCHOR), RUN)[at]
    doc = np.repeat(np.arange(len(many)), many)
    return window, anchor, doc, at - words.first[doc], many


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.slices(batches):
        window, anchor, doc, place, _ = _windows(K.Words(batch.column("text")))
        if not len(window):
            continue
        new = np.ones(len(window), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        long = np.diff(np.append(head, len(window)))
        parts = -(-long // RUN)
        if (parts > 1).any():
            inner = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            head = np.repeat(head, parts) + inner * RUN
            long = np.diff(np.append(head, len(window)))
        # at most RUN <= WINDOW windows: the first and the last cover every word of the block
        content = K.mix(K.mix(window[head] * K.GRAM + window[head + long - 1]) + long.astype(K.U64))
        rows = pa.array(doc[head])
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[head].view(np.int64)), pa.array(content.view(np.int64)), batch.column("doc_id").take(rows), batch.column("tid").take(rows), pa.array(place[head].astype(np.int32)), pa.array(long.astype(np.int16))],
            names=["anchor", "content", "doc_id", "tid", "start", "n"],
        )


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def _boundary_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, doc_id, tid, start) of the windows of the listed blocks."""
    for batch in K.slices(batches):
        words = K.Words(batch.column("text"))
        window, _, _, _, many = _windows(words)
        before = np.cumsum(many) - many
        owner, start, n = _spans(batch)
        place = _spread(start, n)
        owner = np.repeat(owner, n)
        rows = pa.array(owner)
        yield pa.RecordBatch.from_arrays([pa.array(window[before[owner] + place].view(np.int64)), batch.column("doc_id").take(rows), batch.column("tid").take(rows), pa.array(place.astype(np.int32))], names=["window", "doc_id", "tid", "start"])


def _spans(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and words of each span of a batch."""
    spans = batch.column("spans")
    owner = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
    flat = spans.flatten()
    return owner, flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)


def _covered(batch: pa.RecordBatch, words: K.Words) -> np.ndarray:
    """Whether each word is in a duplicate span."""
    owner, start, n = _spans(batch)
    change = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(change, words.first[owner] + start, 1)
    np.add.at(change, words.first[owner] + start + n, -1)
    return np.cumsum(change)[:-1] > 0


def _reports(names: list[str]):
    """The columns names of each row, text without its spans, and the counts and the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            words = K.Words(batch.column("text"))
            gone = _covered(batch, words)
            lost = K.sums(gone, words.first)
            out, digest = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                kept = (text or "").encode().split()
                if lost[i]:
                    kept = [w for w, x in zip(kept, gone[words.first[i] : words.first[i + 1]].tolist(), strict=True) if not x]
                joined = b" ".join(kept)
                digest.append(hashlib.sha256(joined).hexdigest())
                out.append(joined.decode() if lost[i] else text)
            found = {"new": pa.array(out, pa.string()), "n_words": pa.array(words.counts().astype(np.int64)), "n_removed": pa.array(lost.astype(np.int64)), "kept_sha256": pa.array(digest, pa.string())}
            yield pa.RecordBatch.from_arrays([found.get(c, batch.column(c) if c in batch.schema.names else None) for c in names], names=names)

    return run


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Greedy parsing: (doc_id, tid, start, n, source, source_start) of the rows (doc_id, tid, start, n, source, source_start) of copied blocks.

    Rows come sorted by document and place. n of a block are its windows, n of a factor its words.
    """
    held: dict[str, np.ndarray] = {}
    names = ["doc_id", "tid", "start", "n", "source", "source_start"]

    def parsed(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        goes_on = np.zeros(len(c["start"]), bool)
        same = np.logical_and.reduce([c[k][1:] == c[k][:-1] for k in ("doc_id", "tid", "source")])
        goes_on[1:] = same & (c["start"][1:] == c["start"][:-1] + c["n"][:-1]) & (c["source_start"][1:] == c["source_start"][:-1] + c["n"][:-1])
        head = np.flatnonzero(~goes_on)
        n = np.add.reduceat(c["n"], head) + WINDOW - 1
        return pa.RecordBatch.from_arrays([pa.array(n if k == "n" else c[k][head]) for k in names], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        new = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in names}
        held = {k: np.concatenate([held[k], new[k]]) for k in names} if held else new
        # the last document may go on in the next batch
        doc, tid = held["doc_id"], held["tid"]
        done = int(np.flatnonzero(np.append((doc[1:] != doc[:-1]) | (tid[1:] != tid[:-1]), True))[-2] + 1) if len(doc) > 1 and ((doc[1:] != doc[:-1]) | (tid[1:] != tid[:-1])).any() else 0
        if done:
            yield parsed({k: v[:done] for k, v in held.items()})
            held = {k: v[done:] for k, v in held.items()}
    if held:
        yield parsed(held)


def parse(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, start, n, source, source_start): the factors of every text, n words from word start, and where they come from.

    tid is the text's hash. Factors of boundary windows have one window each. Repeated
    rows are parsed once.
    """
    texts = distinct_texts(docs)
    blocks = cut(texts.mapInArrow(K.released(_blocks), "anchor long, content long, doc_id long, tid long, start int, n short"))
    source = F.min(F.struct("doc_id", "start")).alias("s")
    index = cut(blocks.groupBy("anchor", "content").agg(source, F.max("doc_id").alias("last_doc"), F.count("*").alias("rows")).select("anchor", "content", F.col("s.doc_id").alias("source"), F.col("s.start").alias("source_start"), "last_doc", "rows"))
    # an anchor with one block, in one document, concerns nobody else; neither do boundary windows of an anchor with one block
    known = index.groupBy("anchor").agg(F.count("*").alias("blocks"), F.min("source").alias("low"), F.max("last_doc").alias("high")).where("low < high").select("anchor", (F.col("blocks") > 1).alias("boundary"))
    shared = cut(index.join(known, "anchor").select("anchor", "content", "source", "source_start", "boundary", "rows"))
    placed = cut(met(blocks, shared, ["anchor", "content"], HOT).drop("rows"))
    copied = placed.where("doc_id > source").select("doc_id", "tid", "start", "n", "source", "source_start")
    factors = copied.repartition("doc_id", "tid").sortWithinPartitions("doc_id", "tid", "start").mapInArrow(K.released(_factors), FACTORS)
    edge = placed.where("doc_id = source and boundary").groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    windows = cut(texts.join(edge, ["doc_id", "tid"]).mapInArrow(K.released(_boundary_windows), "window long, doc_id long, tid long, start int"))
    earliest = windows.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("s"), F.max("doc_id").alias("last_doc"), F.count("*").alias("rows")).where("s.doc_id < last_doc")
    earliest = cut(earliest.select("window", F.col("s.doc_id").alias("source"), F.col("s.start").alias("source_start"), "rows"))
    found = met(windows, earliest, ["window"], HOT).where("doc_id > source")
    return factors.unionByName(found.select("doc_id", "tid", F.col("start").cast("long").alias("start"), F.lit(WINDOW).cast("long").alias("n"), "source", F.col("source_start").cast("long").alias("source_start")))


FACTORS = "doc_id long, tid long, start long, n long, source long, source_start long"


def remove_duplicate_spans(docs: DataFrame) -> DataFrame:
    """Every row of docs, its text without the duplicate words, and n_words, n_removed, kept_sha256.

    A word goes if a window of 50 words over it also starts in a document with a
    smaller doc_id. A text that loses words becomes the others joined by one space;
    any other text stays as it is (null stays null and counts no words). Rows that
    share a doc_id do not count as each other's sources. A row without doc_id is
    neither a source nor changed. All columns of docs are carried along; those named
    n_words, n_removed or kept_sha256 are left out for the new ones. An empty table
    gives no rows.
    """
    names = [c for c in docs.columns if c.lower() not in {"n_words", "n_removed", "kept_sha256"}]
    cleaned, row = _cleaned(docs)
    kept = [F.col(row)[c].alias(c) if c.lower() != "text" else F.col("new").alias(c) for c in names]
    return cleaned.select(*kept, "n_words", "n_removed", "kept_sha256")


def drop_duplicate_spans(docs: DataFrame) -> DataFrame:
    """Every row of docs with all its columns, its text without the duplicate words; n_chars, where there is one, to match.

    Which words go is said at remove_duplicate_spans.
    """
    cleaned, row = _cleaned(docs)
    types = dict(docs.dtypes)
    new = {"text": F.col("new"), "n_chars": F.when(F.col("n_removed") > 0, F.length("new").cast(types.get("n_chars", "long"))).otherwise(F.col(row)["n_chars"]) if "n_chars" in types else None}
    return cleaned.select(*(new.get(c, F.col(row)[c]).alias(c) for c in docs.columns))


def _cleaned(docs: DataFrame) -> tuple[DataFrame, str]:
    """(row, new, n_words, n_removed, kept_sha256): the whole row as a struct, and its text without the duplicate words."""
    prepare(docs.sparkSession)
    spans = parse(documents(docs)).groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "n")).alias("spans")).select(F.col("doc_id").alias("i"), F.col("tid").alias("t"), "spans")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = packed.withColumn("tid", F.xxhash64("text")).join(spans, (F.col("doc_id") == F.col("i")) & (F.col("tid") == F.col("t")), "left")
    schema = T.StructType([packed.schema["row"], T.StructField("new", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")), T.StructField("kept_sha256", T.StringType())])
    return rows.select("row", "text", "spans").mapInArrow(K.released(_reports(schema.names)), schema), "row"


def substring_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return remove_duplicate_spans(documents(docs)).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS t
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM words WHERE len(w) >= 50)
), first_docs AS (SELECT t, min(doc_id) AS d FROM windows GROUP BY t),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM windows JOIN first_docs USING (t) WHERE d < doc_id
), lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, j: ps IS NULL OR NOT list_contains(ps, j)), ' ')) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)
"""
