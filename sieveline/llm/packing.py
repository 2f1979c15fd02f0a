"""Best-fit packing of tokenised documents into sequences.

Bulk-synchronous best-fit: pieces and the gaps of open sequences are single rows, and
nothing but counts reaches the driver. One superstep

* range-sorts the pieces it may place and the gaps together by length, pieces first;
* sweeps every range on its own: a gap takes the largest piece before it that no
  smaller gap took, so the piece has its successor among the gaps left to it. A gap
  that holds several of the largest pieces takes as many at once;
* carries what a range leaves, pieces that found no gap and gaps that found no piece,
  to the other ranges: two gaps that want one piece are told apart by rank, from the
  counts of the ranges alone, and meet their pieces by a join on that rank;
* shrinks the gaps by what they took and repeats with the pieces left.

Pieces longer than every gap open as many sequences as their tokens fill. Long pieces
go first: the shortest length taken falls by ``BAND`` after ``STEPS`` supersteps, and
pieces left from before stay in. A superstep places a piece at least.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, documents, prepare

SEQUENCE, END = 2048, 0
#: Characters of white space in a row from which the fast encoder could run out of stack.
RUN, SPACE = 100_000, re.compile(r"\s+")
#: Supersteps before shorter pieces join, and by how much the shortest length falls then.
STEPS, BAND = 2, 4
#: Rows of a range, as long as there are no more than PARTS ranges.
ROWS, PARTS = 10_000, 10_000
SWEPT = ["part", "kind", "pid", "length", "gap", "slot", "rank"]


@lru_cache(maxsize=2)
def _exact(json_path: str) -> tokenizers.Tokenizer:
    return tokenizers.Tokenizer.from_file(json_path)


@lru_cache(maxsize=2)
def _tokenizer(json_path: str, ranks_path: str):
    """The ids of a text: those of the tokenizers file, by its ranks where the text has neither a special token's string nor a very long run of white space."""
    with open(json_path, encoding="utf-8") as lines:
        head = lines.read()
    # the file names its special tokens before its model, which few texts need
    special = [t["content"] for t in json.JSONDecoder().raw_decode(head, head.index("[", head.index('"added_tokens"')))[0]]
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special) or (len(text) >= RUN and any(m.end() - m.start() >= RUN for m in SPACE.finditer(text))):
            return np.array(_exact(json_path).encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return ids


def _pieces(json_path: str, ranks_path: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(json_path, ranks_path)
        for batch in K.slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                at, k = 0, 0
                head = (len(ids) - 1) % most + 1
                while at < len(ids):
                    n = most if k else head
                    row.append(i), piece.append(k), start.append(at), length.append(n), crc.append(zlib.crc32(ids[at : at + n]))
                    at, k = at + n, k + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range (value, kind, id, slot), kind 0 a piece and 1 a gap's slot: the matches (kind 2) and what is left, ranked in order."""
    part = TaskContext.get().partitionId()
    held: list[tuple[int, int]] = []
    empty = 0

    def rows(kind: list[int], pid: list[int | None], length: list[int | None], gap: list[int | None], slot: list[int | None], rank: list[int | None]) -> pa.RecordBatch:
        long = (pa.array(x, pa.int64()) for x in (pid, length, gap, slot, rank))
        return pa.RecordBatch.from_arrays([pa.array([part] * len(kind), pa.int32()), pa.array(kind, pa.int32()), *long], names=SWEPT)

    for batch in batches:
        found = []
        for value, kind, key, slot in zip(*(batch.column(c).to_pylist() for c in ("value", "kind", "id", "slot")), strict=True):
            if not kind:
                held.append((key, value))
            elif held:
                found.append((2, *held.pop(), key, slot, None))
            else:
                found.append((1, None, None, key, slot, empty))
                empty += 1
        if found:
            yield rows(*map(list, zip(*found, strict=True)))
    for at in range(0, len(held), ROWS):
        some = held[at : at + ROWS]
        none = [None] * len(some)
        yield rows([0] * len(some), [p for p, _ in some], [n for _, n in some], none, none, list(range(at, at + len(some))))


def carried(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Which pieces left in a range go to which slots left in later ranges, from (pieces, slots) left in each.

    Rows (from, low, high, to, first, last, base): the piece of rank x in [low, high) has
    match number base + high - 1 - x, the slot of rank y in [first, last) base + y - first.
    """
    held: list[list[int]] = []
    out, base = [], 0
    for part in sorted(left):
        pieces, slots = left[part]
        at = 0
        while at < slots and held:
            source, high = held[-1]
            n = min(slots - at, high)
            out.append((source, high - n, high, part, at, at + n, base))
            at, base = at + n, base + n
            held[-1][1] -= n
            if not held[-1][1]:
                held.pop()
        if pieces:
            held.append([part, pieces])
    return out


def _counts(pieces: DataFrame, gaps: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """How many pieces there are of each length, and gaps of each size."""
    both = pieces.select(F.lit(0).alias("kind"), F.col("length").alias("value")).union(gaps.select(F.lit(1), "room"))
    out: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for r in both.groupBy("kind", "value").agg(F.count("*").alias("n")).collect():
        out[r.kind][r.value] = r.n
    return out


def place(pieces: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """(pid, sequence_id, offset) of every piece.

    pieces: a written table of (pid, length), each pid once, lengths from 1 to most. An
    empty table gives no rows.
    """
    spark = pieces.sparkSession
    gaps = spark.createDataFrame([], "gap long, room long")
    active = spark.createDataFrame([], "pid long, length long")
    waiting, rooms = _counts(pieces, gaps)
    counts: dict[int, int] = {}
    opened, floor, steps, placed = 0, most, 0, active.select("pid", "length", *(F.lit(0).cast("long").alias(c) for c in ("gap", "slot", "step")))
    step = 0
    while waiting or counts:
        if steps == STEPS or not counts:
            below, steps = min(floor // BAND, max([*waiting, *counts]) - 1), 0
            active = active.union(pieces.where((F.col("length") > below) & (F.col("length") <= floor)).select("pid", "length"))
            for length in [n for n in waiting if n > below]:
                counts[length] = counts.get(length, 0) + waiting.pop(length)
            floor = below
        steps, step = steps + 1, step + 1
        widest, least = max(rooms, default=0), min([*waiting, *counts])
        more = -(-sum(length * n for length, n in counts.items() if length > widest) // most)
        if more:
            gaps = gaps.union(spark.range(opened, opened + more).select(F.col("id").alias("gap"), F.lit(most).cast("long").alias("room")))
            rooms[most] = rooms.get(most, 0) + more
            opened += more
        # a gap has a slot for every piece it surely holds, all slots together not many more than the pieces
        longest, shortest, pieces_now = max(counts), min(counts), sum(counts.values())
        usable = sum(n for room, n in rooms.items() if room >= shortest)
        bound = -(-2 * pieces_now // usable)
        slots = F.greatest(F.lit(1), F.least(F.floor(F.col("room") / longest), F.lit(bound))).cast("long")
        wanted = gaps.where(F.col("room") >= shortest).select(F.col("room").alias("value"), F.lit(1).alias("kind"), F.col("gap").alias("id"), F.explode(F.sequence(F.lit(1).cast("long"), slots)).alias("slot"))
        rows = active.select(F.col("length").alias("value"), F.lit(0).alias("kind"), F.col("pid").alias("id"), F.lit(0).cast("long").alias("slot")).union(wanted)
        total = pieces_now + sum(n * max(1, min(room // longest, bound)) for room, n in rooms.items() if room >= shortest)
        parts, order = min(1 + total // ROWS, PARTS), ["value", "kind", "id", "slot"]
        swept = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(K.released(_sweep), "part int, kind int, pid long, length long, gap long, slot long, rank long"))
        left: dict[int, list[int]] = {}
        for r in swept.where("kind < 2").groupBy("part", "kind").agg(F.count("*").alias("n")).collect():
            left.setdefault(r.part, [0, 0])[r.kind] = r.n
        now, active = swept.where("kind = 2").select("pid", "length", "gap", "slot"), swept.where("kind = 0").select("part", "pid", "length", "rank")
        plan = carried({part: (n[0], n[1]) for part, n in left.items()})
        if plan:
            # at most two rows a range
            runs = F.broadcast(spark.createDataFrame(plan, "source int, low long, high long, target int, first long, last long, base long"))
            sent = active.join(runs, F.expr("part = source and rank >= low and rank < high"), "left")
            free = swept.where("kind = 1").select("part", "gap", "slot", "rank").join(runs, F.expr("part = target and rank >= first and rank < last"))
            meet = sent.where("low is not null").select("pid", "length", F.expr("base + high - 1 - rank").alias("match"))
            now = now.union(cut(meet.join(free.select("gap", "slot", F.expr("base + rank - first").alias("match")), "match").select("pid", "length", "gap", "slot"), parts))
            active = sent.where("low is null")
        active = active.select("pid", "length")
        placed = placed.union(now.withColumn("step", F.lit(step).cast("long")))
        taken = gaps.union(now.select("gap", -F.col("length")))
        gaps = cut(taken.groupBy("gap").agg(F.sum("room").alias("room")).where(F.col("room") >= least), parts)
        counts, rooms = _counts(active, gaps)
    before = F.sum("length").over(Window.partitionBy("gap").orderBy("step", "slot")) - F.col("length")
    return placed.select("pid", F.col("gap").alias("sequence_id"), before.alias("offset"))


def pack(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, most: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A document is its text's ids and one closing id 0; null counts as empty text, so
    each row has a piece. Only documents over ``most`` ids are cut, the first piece
    taking what is left over. Repeated rows and doc_ids, null ones too, are packed each
    for itself. Columns besides doc_id and text are ignored. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    run = _pieces(json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), most)
    made = documents(docs).mapInArrow(K.released(run), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = cut(made.withColumn("pid", F.monotonically_increasing_id()))
    return pieces.join(place(pieces.select("pid", "length"), most), "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
