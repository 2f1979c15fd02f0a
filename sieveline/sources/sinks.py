"""Writers of results."""

from __future__ import annotations

import gzip
import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def write_csv(df: DataFrame, path: str) -> None:
    """One header, blanks for nulls; refuses an empty table."""
    if df.isEmpty():
        raise ValueError(f"refusing to write an empty table to {path}")
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_run(rankings: DataFrame, path: str, keys: tuple[str, ...] = ("qid",)) -> None:
    """Compressed JSON lines: keys, ranking, scores if there are any."""
    scored = "score" in rankings.columns
    item = F.struct("rank", "doc_id", *(["score"] if scored else []))
    by = rankings.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("r"))
    scores = [F.col("r.score").alias("scores")] if scored else []
    by.select(*keys, F.col("r.doc_id").alias("ranking"), *scores).write.mode("overwrite").option("compression", "gzip").json(path)


def write_json(spark: SparkSession, row: dict, path: str) -> None:
    """One object, sorted keys, two-space indent, a newline at the end."""
    files.write_text(spark, path, json.dumps(row, indent=2, sort_keys=True, default=str, ensure_ascii=False) + "\n")


def pool_lines(pool: DataFrame, document: str = "doc_id") -> Iterator[bytes]:
    """The pool (qid, rank, document) as compact JSON lines in the order of the number that qid is; one partition at a time reaches the driver."""
    ranked = pool.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(document).cast("string").alias("d")))).alias("r"))
    for row in ranked.select("qid", F.col("r.d").alias("ranking")).orderBy(F.col("qid").cast("long"), "qid").toLocalIterator():
        yield (json.dumps({"qid": row.qid, "ranking": row.ranking}, ensure_ascii=False, separators=(",", ":"), sort_keys=True) + "\n").encode()


def pool_digest(pool: DataFrame, document: str = "doc_id") -> str:
    """SHA-256 of all lines of a pool."""
    digest = hashlib.sha256()
    for line in pool_lines(pool, document):
        digest.update(line)
    return digest.hexdigest()


class _Digested:
    """Writes on, and hashes what it writes."""

    def __init__(self, out):
        self.out, self.digest = out, hashlib.sha256()

    def write(self, data: bytes) -> int:
        self.digest.update(data)
        return self.out.write(data)

    def flush(self) -> None:
        self.out.flush()


def export_pool(pool: DataFrame, path: str, document: str = "doc_id") -> dict[str, object]:
    """Write the canonical pool, compressed so that equal pools give equal files; counts and both digests."""
    digest, queries, ids = hashlib.sha256(), 0, 0
    with files.writer(pool.sparkSession, path) as raw:
        packed = _Digested(raw)
        with gzip.GzipFile(filename="", mode="wb", fileobj=packed, mtime=0) as out:
            for line in pool_lines(pool, document):
                digest.update(line)
                out.write(line)
                queries, ids = queries + 1, ids + len(json.loads(line)["ranking"])
    return {"artifact": path, "queries": queries, "candidate_ids": ids, "uncompressed_sha256": digest.hexdigest(), "compressed_sha256": packed.digest.hexdigest()}
