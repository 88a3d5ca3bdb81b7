"""One-pass inference from class and predicate rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE
from ..session import broadcast_if_small, stage
from ..sources.triples import as_source, frame
from .triples import filter_edges

#: Rule heads that may stand in the filter of a scan.
LISTED_HEADS = 1000


def rule_table(spark: SparkSession, pairs, columns: tuple[str, str]) -> DataFrame:
    """Rule pairs as a two-column table."""
    return spark.createDataFrame(list(dict.fromkeys(pairs)), f"{columns[0]} string, {columns[1]} string")


def class_rule_table(spark: SparkSession, pairs) -> DataFrame:
    return rule_table(spark, pairs, ("cls", "super"))


def predicate_rule_table(spark: SparkSession, pairs) -> DataFrame:
    return rule_table(spark, pairs, ("p", "super"))


def infer_types(triples, class_rules: DataFrame) -> DataFrame:
    """Derived triples only: ``x type C`` with a rule ``C -> D`` gives ``x type D``."""
    rules = broadcast_if_small(class_rules.select("cls", "super"))
    typed = as_source(triples).scan(RDF_TYPE)
    return typed.join(rules, F.col("o") == F.col("cls")).select(
        "s", "p", F.col("super").alias("o")
    )


def infer_predicates(triples, predicate_rules: DataFrame) -> DataFrame:
    """Derived triples only: ``x p y`` with a rule ``p -> q`` gives ``x q y``.

    The heads of up to ``LISTED_HEADS`` predicates also restrict the scan; more only meet in the join.
    """
    rules = broadcast_if_small(predicate_rules.select("p", "super"))
    heads = [r["p"] for r in predicate_rules.select("p").distinct().limit(LISTED_HEADS + 1).collect()]
    t = filter_edges(triples, heads) if len(heads) <= LISTED_HEADS else frame(triples)
    return t.join(rules, "p").select("s", F.col("super").alias("p"), "o")


def close_rules(rules: DataFrame) -> DataFrame:
    """All pairs that follow from a two-column rule table by chains of rules; itself implied by itself is left out.

    A fixpoint over the rules alone: every round joins the pairs found last with the rules and keeps what is new, until nothing is.
    Pairs of a cycle repeat and so end it.  Each round's pairs are written, so a round reads its predecessor and not
    the chain of all before.  The data are read once, by ``infer`` with the closed table.
    """
    head, implied = rules.columns
    names = [F.col(f"`{head}`").alias("head"), F.col(f"`{implied}`").alias("implied")]
    given = stage(rules.select(*names).where("head <> implied").distinct(), "rules")
    known = latest = given
    while True:
        step = given.select(F.col("head").alias("implied"), F.col("implied").alias("next"))
        longer = latest.join(step, "implied").select("head", F.col("next").alias("implied")).where("head <> implied")
        latest = stage(longer.distinct().join(known, ["head", "implied"], "left_anti"), "rules")
        if latest.isEmpty():
            return known.select(F.col("head").alias(head), F.col("implied").alias(implied))
        known = stage(known.unionByName(latest), "rules")


def _grouped(rules: DataFrame, key: str, name: str) -> DataFrame:
    """One row per rule head with the array of what it implies."""
    return broadcast_if_small(rules.groupBy(F.col(key).alias(f"#{key}")).agg(F.collect_set("super").alias(name)))


def infer(
    triples,
    class_rules: DataFrame | None = None,
    predicate_rules: DataFrame | None = None,
    distinct: bool = False,
) -> DataFrame:
    """The input triples and all derived ones, as a bag unless ``distinct``.

    One pass: every triple meets the rules, grouped by their heads, and gives itself and what they imply.
    """
    t = frame(triples).select("s", "p", "o")
    given, heads_met = [F.array(F.struct("p", "o"))], F.lit(False)
    if class_rules is not None:
        heads = _grouped(class_rules, "cls", "#classes")
        t = t.join(heads, (F.col("p") == RDF_TYPE) & (F.col("o") == F.col("#cls")), "left")
        given.append(F.transform("#classes", lambda c: F.struct("p", c.alias("o"))))
        heads_met = heads_met | F.col("#classes").isNotNull()
    if predicate_rules is not None:
        heads = _grouped(predicate_rules.withColumnRenamed("p", "head"), "head", "#predicates")
        t = t.join(heads, F.col("p") == F.col("#head"), "left")
        given.append(F.transform("#predicates", lambda q: F.struct(q.alias("p"), "o")))
        heads_met = heads_met | F.col("#predicates").isNotNull()
    none = F.array().cast("array<struct<p:string,o:string>>")
    # Only triples that meet a rule become arrays; the others pass as they are.
    several = F.when(heads_met, F.concat(*(F.coalesce(g, none) for g in given)))
    each = t.select("s", "p", "o", F.inline_outer(several).alias("#p", "#o"))
    out = each.select("s", *(F.coalesce(f"#{c}", c).alias(c) for c in ("p", "o")))
    return out.distinct() if distinct else out


# The university rules, class to superclasses, by local name.
UNIVERSITY_CLASSES = {
    "doctoralDegreeFrom": ("degreeFrom",),
    "mastersDegreeFrom": ("degreeFrom",),
    "undergraduateDegreeFrom": ("degreeFrom",),
    "GraduateCourse": ("Work",),
    "TechnicalReport": ("Publication",),
    "JournalArticle": ("Publication",),
    "ConferencePaper": ("Publication",),
    "UndergraduateStudent": ("Person", "Student"),
    "GraduateStudent": ("Student",),
    "ClericalStaff": ("Employee", "Person"),
    "SystemsStaff": ("Employee", "Person"),
    "Lecturer": ("Employee", "Person"),
    "PostDoc": ("Employee", "Person"),
    "AssistantProfessor": ("Employee", "Person", "Faculty", "Professor"),
    "AssociateProfessor": ("Employee", "Person", "Faculty", "Professor"),
    "FullProfessor": ("Employee", "Person", "Faculty", "Professor"),
    "VisitingProfessor": ("Employee", "Person", "Faculty", "Professor"),
    "Chair": ("Employee", "Person", "Faculty"),
    "Dean": ("Employee", "Person", "Faculty"),
}
UNIVERSITY_PREDICATES = {"headOf": ("worksFor",)}


def lubm_rules(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Class and predicate rule tables of the university benchmark under ``prefix``."""

    def pairs(rules):
        return [(f"<{prefix}{c}>", f"<{prefix}{d}>") for c, ds in rules.items() for d in ds]

    return (
        class_rule_table(spark, pairs(UNIVERSITY_CLASSES)),
        predicate_rule_table(spark, pairs(UNIVERSITY_PREDICATES)),
    )
