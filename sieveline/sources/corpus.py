"""Reading and auditing collections: JSONL, checksums, ordinals, queries, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import likes
from ..operators import boolean
from ..plans import templates
from . import files
from .ordinals import with_ordinals

CORPUS = T.StructType([T.StructField("_id", T.StringType()), T.StructField("text", T.StringType())])
QUERIES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("docs", T.ArrayType(T.StringType())), T.StructField("num_docs", T.LongType()),
    T.StructField("metadata", T.StructType([T.StructField("template", T.StringType()), T.StructField("attrs", T.ArrayType(T.StringType()))])), T.StructField("original_query", T.StringType()),
])
RUN = T.StructType([T.StructField("qid", T.StringType()), T.StructField("ranking", T.ArrayType(T.StringType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, anything that is no object of the schema fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def corrupt_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines that do not parse."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file")).where("trim(value) <> ''")
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(parsed.alias("row"), "file").where("row._corrupt is not null").select("row._corrupt", "file")


#: Bytes of the largest file that executors hash as one value of a row.
LARGE = (1 << 31) - 1024


def checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, sha256 of whole files: by executors, one row a file, and those too large for a row as streams."""
    large = [p for p in paths if files.size(spark, p) > LARGE]
    streamed = spark.createDataFrame([(p.rpartition("/")[2], files.sha256(spark, p)) for p in large], "file string, sha256 string")
    small = [p for p in paths if p not in large]
    if not small:
        return streamed
    read = spark.read.format("binaryFile").load(small)
    return read.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256")).unionByName(streamed)


def checksum_violations(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """file, rule: missing or mismatch."""
    both = expected.select("file", F.col("sha256").alias("want")).join(observed, "file", "left")
    return both.where(~F.col("sha256").eqNullSafe(F.col("want"))).select("file", F.when(F.col("sha256").isNull(), "missing").otherwise("mismatch").alias("rule"))


def facts(corpus: DataFrame) -> DataFrame:
    """ordinal, attr that the texts state."""
    return corpus.select("ordinal", F.explode(likes("text")).alias("attr"))


def postings(found: DataFrame) -> DataFrame:
    """attr, posting_size, first_ordinal."""
    return found.groupBy("attr").agg(F.count_distinct("ordinal").alias("posting_size"), F.min("ordinal").alias("first_ordinal"))


def corpus_violations(corpus: DataFrame) -> DataFrame:
    """doc_id, rule: empty or repeated id, empty text, text without facts."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    empty = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0
    rules = F.array_compact(F.array(F.when(empty("doc_id"), F.lit("empty_id")), F.when(n > 1, F.lit("duplicate_id")), F.when(empty("text"), F.lit("empty_text")), F.when(F.coalesce(F.size(likes("text")), F.lit(0)) == 0, F.lit("no_facts"))))
    return corpus.select("doc_id", rules.alias("rules")).select("doc_id", F.explode("rules").alias("rule"))


def raw_query_violations(raw: DataFrame) -> DataFrame:
    """id, rule of rows as read: no text, documents that are no list of ids, a document twice, a wrong count, no plan."""
    docs, attrs = F.col("docs"), F.col("metadata.attrs")
    blank = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    rules = F.array_compact(F.array(
        F.when(blank("query"), F.lit("no_text")), F.when(docs.isNull() | F.exists(docs, lambda d: d.isNull()), F.lit("invalid_docs")),
        F.when(F.size(docs) > F.size(F.array_distinct(docs)), F.lit("duplicate_gold")), F.when(~F.col("num_docs").eqNullSafe(F.when(docs.isNotNull(), F.size(docs).cast("long"))), F.lit("wrong_num_docs")),
        F.when(F.col("metadata.template").isNull() | attrs.isNull(), F.lit("no_plan")), F.when(F.exists(attrs, blank), F.lit("empty_attribute")),
    ))
    return raw.select("id", F.explode(rules).alias("rule"))


def id_violations(ids: DataFrame, n: int) -> DataFrame:
    """qid, rule: ids that are not exactly 0 to n - 1, each once."""
    found = ids.groupBy("qid").agg(F.count("*").alias("k"))
    number = F.expr("try_cast(qid as bigint)")
    fine = number.isNotNull() & (number.cast("string") == F.col("qid")) & number.between(0, n - 1)
    rules = F.explode(F.array_compact(F.array(F.when(F.col("k") > 1, F.lit("duplicate_qid")), F.when(~fine, F.lit("qid_out_of_range")))))
    missing = ids.sparkSession.range(n).select(F.col("id").cast("string").alias("qid")).join(found, "qid", "left_anti")
    return found.select("qid", rules.alias("rule")).unionByName(missing.withColumn("rule", F.lit("missing_qid")))


def unknown_references(queries: DataFrame, gold: DataFrame, corpus: DataFrame, found: DataFrame) -> DataFrame:
    """qid, kind, name: gold documents (qid, doc_id) that the corpus does not have, attributes that no document states."""
    docs = gold.join(corpus.select("doc_id"), "doc_id", "left_anti").select("qid", F.lit("document").alias("kind"), F.col("doc_id").alias("name"))
    attrs = queries.select("qid", F.explode("attrs").alias("attr")).distinct().join(found.select("attr").distinct(), "attr", "left_anti")
    return docs.unionByName(attrs.select("qid", F.lit("attribute").alias("kind"), F.col("attr").alias("name")))


def run_violations(run: DataFrame, n: int, prefix: int) -> DataFrame:
    """qid, rule of a run (qid, ranking): ids not 0 to n - 1, a ranking too short, or an empty or repeated id in its first places."""
    head = F.slice("ranking", 1, prefix)
    rules = F.array_compact(F.array(
        F.when(F.coalesce(F.size(head), F.lit(0)) < prefix, F.lit("too_short")), F.when(F.exists(head, lambda d: F.coalesce(F.length(d), F.lit(0)) == 0), F.lit("empty_id")),
        F.when(F.size(head) > F.size(F.array_distinct(head)), F.lit("duplicate_document")),
    ))
    return run.select("qid", F.explode(rules).alias("rule")).unionByName(id_violations(run.select("qid"), n))


def template_counts(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """template, n_queries, gold_total."""
    gold = qrels.groupBy("qid").agg(F.count_distinct("ordinal").alias("gold"))
    return queries.select("qid", "template").join(gold, "qid", "left").groupBy("template").agg(F.count("*").alias("n_queries"), F.coalesce(F.sum("gold"), F.lit(0)).alias("gold_total"))


def query_violations(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """qid, rule: repeated qid, no gold, repeated gold, a text that is not the plan's rendering."""
    n = F.count("*").over(Window.partitionBy("qid"))
    gold = qrels.groupBy("qid").agg(F.count("*").alias("gold"), F.count_distinct("ordinal").alias("distinct_gold"))
    rows = queries.withColumn("n", n).join(gold, "qid", "left")
    rules = F.array_compact(F.array(
        F.when(F.col("n") > 1, F.lit("duplicate_qid")), F.when(F.coalesce("gold", F.lit(0)) == 0, F.lit("no_gold")), F.when(F.col("gold") > F.col("distinct_gold"), F.lit("duplicate_gold")),
        F.when(~F.col("text").eqNullSafe(templates.render()), F.lit("text_is_not_rendering")),
    ))
    return rows.select("qid", F.explode(rules).alias("rule")).unionByName(templates.violations(queries))


def oracle_mismatch(queries: DataFrame, qrels: DataFrame, found: DataFrame) -> DataFrame:
    """qid, ordinal, side: documents of the gold or of the exact execution only."""
    exact = boolean.execute(templates.atoms(queries), found)
    both = exact.withColumn("e", F.lit(True)).join(qrels.select("qid", "ordinal", F.lit(True).alias("g")).distinct(), ["qid", "ordinal"], "full_outer")
    return both.where("e is null or g is null").select("qid", "ordinal", F.when(F.col("e").isNull(), "gold_only").otherwise("exact_only").alias("side"))


def audit_summary(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, found: DataFrame) -> DataFrame:
    """One row of counts."""
    gold = qrels.groupBy("qid").agg(F.count("*").alias("g")).agg(F.sum("g").alias("gold_total"), F.min("g").alias("gold_min"), F.max("g").alias("gold_max"), F.avg("g").alias("gold_mean"))
    one = lambda df, *c: df.agg(*c)
    parts = [
        one(corpus, F.count("*").alias("n_documents")), one(found, F.count_distinct("attr").alias("n_attrs"), F.count("*").alias("n_facts")),
        one(queries, F.count("*").alias("n_queries"), F.count_distinct("template").alias("n_templates")), gold, one(qrels, F.count_distinct("ordinal").alias("referenced_documents")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def load_queries(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """queries and qrels (qid, doc_id) of raw query rows."""
    queries = raw.select(F.col("id").alias("qid"), F.col("query").alias("text"), F.col("metadata.template").alias("template"), F.col("metadata.attrs").alias("attrs"), F.coalesce("original_query", F.lit("")).alias("original_query"))
    return queries, raw.select(F.col("id").alias("qid"), F.explode("docs").alias("doc_id"))


def load_run(spark: SparkSession, path: str) -> DataFrame:
    """qid, rank, doc_id, score of a run file, compressed or not."""
    rows = jsonl(spark, path, RUN).select("qid", F.posexplode("ranking").alias("i", "doc_id"), "scores")
    return rows.select("qid", (F.col("i") + 1).alias("rank"), "doc_id", F.get("scores", F.col("i")).alias("score"))
