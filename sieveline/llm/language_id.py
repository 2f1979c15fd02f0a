"""Language ID by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the character n-grams of all languages: a slot is
a bit mask over languages (as many 64-bit words as they need), an n-gram sets its
language's bit in ``HASHES`` slots, and the AND of an n-gram's slots is the mask of
all languages that contain it (with Bloom false positives). The filter holds every
n-gram of the sample; its slots number ``ROOM`` times the n-grams of the largest
language or more. Over a text's
n-grams the masks are counted per language; a language's count is corrected for the
share of n-grams that its filter would give by chance, which is known from its fill,
and the highest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import documents, fold, prepare
from .training import fit_in_task

PARTS, HELD, UNKNOWN = 5, 0, "und"
#: n-gram sizes in bytes of lower-cased text; probes an n-gram; slots an n-gram; languages in a word of a mask.
SIZES, HASHES, ROOM, BITS = (3, 4, 5), 2, 8, 64
#: Documents a language to learn from; groups of partitions that are sampled on the way; n-grams without a language that make a text foreign.
SAMPLE, FAN, FOREIGN = 600, 16, 16
#: Bytes of text whose n-grams are taken at a time: they need about a hundred times as much.
STEP = K.PIECE // 4
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ascii = _letter & (np.arange(256) < 128)


def _grams(data: np.ndarray, doc_at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams of documents' words, a word's ends included, and each one's document; some at a time.

    An n-gram belongs to the step it starts in and may reach beyond it.
    """
    for a in range(0, len(data), STEP):
        b = min(a + STEP, len(data))
        part = data[a : b + SIZES[-1] - 1]
        letter = _letter[part]
        # white space ends a word; symbols and digits are kept out of the n-grams
        edge = np.where(letter, part, 32).astype(K.U64)
        bad = np.zeros(len(part) + 1, np.int64)
        np.cumsum(~(letter | K._space[part]), out=bad[1:])
        doc = np.searchsorted(doc_at, np.arange(a, a + len(part)), "right") - 1
        for size in SIZES:
            m = min(b - a, len(part) - size + 1)
            if m <= 0:
                continue
            g = np.zeros(m, K.U64)
            for k in range(size):
                g = (g << K.U64(8)) | edge[k : k + m]
            fine = (bad[size : size + m] == bad[:m]) & (doc[:m] == doc[size - 1 : size - 1 + m]) & letter[size // 2 : size // 2 + m]
            yield K.mix(g[fine] * K.GRAM + K.U64(size)), doc[:m][fine]


def _slots(g: np.ndarray, probe: int, size: int) -> np.ndarray:
    return ((g >> K.U64(32 * probe)) & K.U64(size - 1)).astype(np.int64)


def _of_language(texts: list[str]) -> np.ndarray:
    """The distinct n-grams of a language's documents."""
    found = [np.zeros(0, K.U64)]
    for batch in K.slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])], most=STEP):
        parts = [g for g, _ in _grams(*K.raw(pc.utf8_lower(batch.column("text"))))]
        found.append(np.unique(np.concatenate(parts)) if parts else found[0])
    return np.unique(np.concatenate(found))


def train(rows: list[tuple[str, str]]) -> dict:
    """The filter of (lang, text) rows."""
    langs = sorted({lang for lang, _ in rows})
    grams = [_of_language([t for name, t in rows if name == lang]) for lang in langs]
    size = 1 << max(10, (ROOM * max(map(len, grams), default=0)).bit_length())
    kind = np.uint64 if len(langs) > 8 else np.uint8
    slots = np.zeros((-(-len(langs) // BITS), size), kind)  # a row for every BITS languages
    for bit, own in enumerate(grams):
        for probe in range(HASHES):
            np.bitwise_or.at(slots[bit // BITS], _slots(own, probe, size), kind(1 << bit % BITS))
    chance = np.array([float(((slots[bit // BITS] >> kind(bit % BITS)) & kind(1)).mean()) ** HASHES for bit in range(len(langs))])
    return {"langs": langs, "slots": slots, "chance": chance}


def decide(model: dict, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and n-grams of each document: ``und`` and 0 without letters, or if nothing was learned."""
    texts = pc.fill_null(col, "")
    n, langs, slots = len(texts), model["langs"], model["slots"]
    data, doc_at = K.raw(pc.utf8_lower(texts))
    plain = np.zeros(n, np.int64)
    for a in range(0, len(data), STEP):
        at = a + np.flatnonzero(_ascii[data[a : a + STEP]])
        plain += np.bincount(np.searchsorted(doc_at, at, "right") - 1, minlength=n)
    total, hits = np.zeros(n, np.int64), np.zeros((n, len(langs)))
    for g, doc in _grams(data, doc_at):
        first = np.searchsorted(doc, np.arange(n + 1))
        total += np.diff(first)
        for word in range(len(slots)):
            masks = slots[word][_slots(g, 0, slots.shape[1])]
            for probe in range(1, HASHES):
                masks = masks & slots[word][_slots(g, probe, slots.shape[1])]
            for bit in range(word * BITS, min((word + 1) * BITS, len(langs))):
                hits[:, bit] += K.sums((masks >> masks.dtype.type(bit % BITS)) & masks.dtype.type(1), first)
    share = np.clip((hits - model["chance"] * total[:, None]) / np.maximum((1 - model["chance"]) * total[:, None], 1e-9), 0, 1)
    out, score = [], np.zeros(n)
    for i, row in enumerate(share):
        if not len(row) or (not plain[i] and not any(c.isalpha() for c in texts[i].as_py())):
            out.append(UNKNOWN)
            continue
        best = int(row.argmax())
        out.append(langs[best])
        score[i] = row[best] / row.sum() * row[best] ** 0.25 if row.sum() else 0.0
    return out, score, total


def learn(docs: DataFrame, sample: int = SAMPLE, parts: int = PARTS, held: int = HELD) -> dict:
    """The model of docs (doc_id, text, lang) outside the held-out fold.

    sample: documents of each language, the first by a hash of doc_id, each with the
    least of its texts. Null texts and langs teach nothing.
    """
    known = documents(docs, F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null").where(fold(F.col("doc_id"), parts) != held)
    ids = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("o"), F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("part")).distinct()
    # a language may have most of the rows: every group of partitions passes on no more than the sample
    for by in (("lang", "part"), ("lang",)):
        ids = ids.select(*by, "o", "doc_id").distinct()
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("o", "doc_id"))).where(F.col("r") <= sample)
    rows = known.join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    return fit_in_task(rows, lambda t: train(sorted(zip(t["lang"].to_pylist(), t["text"].to_pylist(), strict=True))))


def predict(docs: DataFrame, model: dict, parts: int = PARTS, held: int = HELD) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, most=STEP):
            langs, score, _ = decide(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = documents(docs).withColumn("held_out", fold(F.col("doc_id"), parts) == held)
    return rows.mapInArrow(K.released(run), "doc_id long, held_out boolean, lang_pred string, score double")


def told_rows(docs: DataFrame, model: dict) -> DataFrame:
    """Every row of docs whose text has a language; all columns, whatever their names.

    Rejected are null texts, texts without a letter and texts of ``FOREIGN`` n-grams or
    more of which no learned language has any beyond chance. If nothing was learned,
    letters alone decide. Repeated rows are told alike; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    model_has_languages = bool(model["langs"])
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    schema = packed.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.struct_field(batch.column(0), "text").cast(pa.string())
            sizes = pa.RecordBatch.from_arrays([text, pa.array(np.arange(batch.num_rows))], names=["text", "at"])
            keep = []
            for part in K.slices([sizes], most=STEP) if model_has_languages else ():
                langs, score, total = decide(shared.value, part.column("text"))
                keep += [lang != UNKNOWN and (s > 0 or n < FOREIGN) for lang, s, n in zip(langs, score.tolist(), total.tolist(), strict=True)]
            if not model_has_languages:
                keep = [any(c.isalpha() for c in t.as_py() or "") for t in text]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return packed.mapInArrow(K.released(run), schema).select("row.*")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang).

    A null text, or one without a letter, is ``und`` with score 0; so is every text if
    there is nothing to learn from. lang is only learned from, outside the held-out
    fold. Ties go to the first language by code point. Other columns are ignored. An
    empty table gives no rows.
    """
    prepare(docs.sparkSession)
    return predict(docs, learn(docs))
