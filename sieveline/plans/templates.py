"""The seven Boolean query templates, plan validation, rendering and the exploded plan atoms.

A plan is (qid, template, attrs). The templates are a seven-row dimension; every
operator here is a join with it or an expression over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Template text, number of attributes, how positives combine, whether the last attribute is negated.
TEMPLATES = [
    ("_", 1, "atom", False),
    ("_ or _", 2, "or", False),
    ("_ or _ or _", 3, "or", False),
    ("_ that are also _", 2, "and", False),
    ("_ that are also both _ and _", 3, "and", False),
    ("_ that are also _ but not _", 3, "and", True),
    ("_ that are not _", 2, "atom", True),
]
ATOM, OR_2, OR_3, AND_2, AND_3, AND_NOT_3, NOT_2 = (t[0] for t in TEMPLATES)
#: The question of each template over attributes 0, 1, 2.
QUESTIONS = {
    ATOM: ["Who likes ", 0, "?"],
    OR_2: ["Who likes ", 0, " or ", 1, "?"],
    OR_3: ["Who likes ", 0, " or ", 1, " or ", 2, "?"],
    AND_2: ["Who likes ", 0, " and also likes ", 1, "?"],
    AND_3: ["Who likes ", 0, " and also likes both ", 1, " and ", 2, "?"],
    AND_NOT_3: ["Who likes ", 0, " and also likes ", 1, " but not ", 2, "?"],
    NOT_2: ["Who likes ", 0, " but not ", 1, "?"],
}


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "template string, arity int, positive_operator string, has_negative boolean")


def render(template: Column | str = "template", attrs: Column | str = "attrs") -> Column:
    """The canonical question of a plan; null for an unknown template or a missing attribute."""
    template, attrs = (F.col(c) if isinstance(c, str) else c for c in (template, attrs))
    out = F.when(F.lit(False), F.lit(""))
    for name, parts in QUESTIONS.items():
        out = out.when(template == name, F.concat(*(F.lit(p) if isinstance(p, str) else F.get(attrs, F.lit(p)) for p in parts)))
    return out


def atoms(plans: DataFrame) -> DataFrame:
    """qid, template, pos, attr, is_negative, positive_operator, n_positive: one row for each attribute of a plan."""
    known = F.broadcast(templates(plans.sparkSession))
    rows = plans.select("qid", "template", "attrs", F.posexplode("attrs").alias("pos", "attr")).join(known, "template")
    negative = F.col("has_negative") & (F.col("pos") == F.size("attrs") - 1)
    return rows.select("qid", "template", "pos", "attr", negative.alias("is_negative"), "positive_operator", (F.col("arity") - F.col("has_negative").cast("int")).alias("n_positive"))


def violations(plans: DataFrame) -> DataFrame:
    """qid, rule of every broken plan rule: unknown template, wrong arity, empty attribute."""
    known = F.broadcast(templates(plans.sparkSession))
    checked = plans.join(known, "template", "left")
    rules = F.array_compact(
        F.array(
            F.when(F.col("arity").isNull(), F.lit("unknown_template")),
            F.when(F.coalesce(F.size("attrs"), F.lit(0)) != F.col("arity"), F.lit("wrong_arity")),
            F.when(F.exists(F.coalesce("attrs", F.array().cast("array<string>")), lambda a: F.coalesce(F.length(F.trim(a)), F.lit(0)) == 0), F.lit("empty_attribute")),
        )
    )
    return checked.select("qid", F.explode(rules).alias("rule"))


def first_n(plans: DataFrame, n: int) -> DataFrame:
    """The first n plans of each template, by ordinal."""
    from pyspark.sql import Window

    order = Window.partitionBy("template").orderBy("ordinal")
    return plans.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")
