"""Text forms of triples, vertices and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Separators of the text formats.
PROP_MARK = "##PropObj##"
#: The separator inside a value of a vertex line.
_PROP_MARK_ESCAPED = "\\u0023\\u0023PropObj##"

#: Lines of one compressed file, which one task reads.
FILE_LINES = 2_000_000

# A quoted literal with its datatype or language tag, an <iri>, or one token.
_OBJECT = (
    r'^("[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\^\^<[^>\s]*>|\^\^\S+|@[A-Za-z0-9\-]+)?'
    r'|<[^>\s]*>|[^"\s]\S*)'
)


def _lexical(term: Column) -> Column:
    """A term as it may stand on a line: line breaks and bare quotes inside a literal become escapes."""
    # Most literals are plain, which is seen without a pattern: none of these, and no third quote.
    special = F.contains(term, F.lit("\n")) | F.contains(term, F.lit("\r")) | F.contains(term, F.lit("\\"))
    quote = F.lit('"')
    third = F.position(quote, term, F.position(quote, term, F.lit(2)) + 1) > 0
    inner = F.regexp_extract(term, r'(?s)^"(.*)"[^"]*$', 1)
    tail = F.regexp_extract(term, r'(?s)^".*"([^"]*)$', 1)
    plain = F.replace(F.replace(inner, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    plain = F.regexp_replace(plain, r'(?<!\\)((?:\\\\)*)"', r'$1\\"')
    # A last backslash that would swallow the closing quote.
    plain = F.regexp_replace(plain, r"(?<!\\)((?:\\\\)*)\\$", r"$1\\\\")
    safe = F.concat(F.lit('"'), plain, F.lit('"'), tail)
    odd = term.startswith('"') & (special | third) & term.rlike(r'(?s)^".*[\n\r\\"].*"[^"]*$')
    return F.when(odd, safe).otherwise(term)


def _object(rest: Column) -> Column:
    """What ``_OBJECT`` finds where ``rest`` begins; a blank is its only white space.  Only odd literals need the pattern."""
    token = F.substring_index(rest, " ", 1)
    end, quote = F.position(F.lit(">"), token), F.position(F.lit('"'), rest, F.lit(2))
    after = F.substr(rest, quote + 1, F.lit(1))
    plain = (quote > 0) & ~F.contains(rest, F.lit("\\")) & ~after.isin("^", "@")
    return (
        F.when(rest.startswith("<"), F.when(end > 0, F.substr(token, F.lit(1), end)).otherwise(token))
        .when(rest.startswith('"'), F.when(plain, F.substr(rest, F.lit(1), quote)).otherwise(F.regexp_extract(rest, _OBJECT, 1)))
        .otherwise(token)
    )


def _parsed_lines(spark: SparkSession, path, literal_mode: str) -> DataFrame:
    """One row per line with s, p, o and ``ok``.  Lines cut by single blanks, nearly all, are cut without a pattern."""
    if literal_mode not in ("whole", "token"):
        raise ValueError("literal_mode must be 'whole' or 'token'")
    whole = literal_mode == "whole"
    line = F.col("line")
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\f")) | F.contains(line, F.lit("\x0b"))
    # Every step is a projection of its own, so that none is computed twice.
    cut = (
        spark.read.text(path)
        .select(F.trim("value", F.lit(" \t\r")).alias("line"))
        .withColumn("s", F.substring_index("line", " ", 1))
        .withColumn("rest", F.expr("substring(line, length(s) + 2)"))
        .withColumn("p", F.substring_index("rest", " ", 1))
        .withColumn("rest", F.expr("substring(rest, length(p) + 2)"))
        .withColumn("plain", ~odd & (F.col("p") != "") & (F.col("rest") != "") & ~F.col("rest").startswith(" "))
        .withColumn("part", F.when(~F.col("plain"), F.split("line", r"\s+", 3)))
    )
    rest = F.get("part", F.lit(2))
    by_pattern = F.when(F.size("part") == 3, F.regexp_extract(rest, _OBJECT if whole else r"^(\S+)", 1))
    by_blanks = _object(F.col("rest")) if whole else F.substring_index("rest", " ", 1)
    found = F.struct(
        F.when(F.col("plain"), F.col("s")).otherwise(F.get("part", F.lit(0))).alias("s"),
        F.when(F.col("plain"), F.col("p")).otherwise(F.get("part", F.lit(1))).alias("p"),
        F.when(F.col("plain"), by_blanks).otherwise(by_pattern).alias("o"),
    )
    # A generator keeps later tests above it; below, they would cut the line again.
    return cut.select(F.inline(F.array(found))).withColumn(
        "ok",
        F.col("o").isNotNull() & ~F.col("s").startswith("#") & ~F.col("o").isin("", "."),
    )


def read_triples(
    spark: SparkSession, path, literal_mode: str = "whole", rejects: Observation | None = None
) -> DataFrame:
    """Triple text lines ``s p o .`` as ``(s, p, o)``.

    ``literal_mode='whole'`` keeps a literal with blanks in one piece;
    ``'token'`` cuts it at the first blank.  Comments and lines with fewer than
    three terms, or with a literal that is not closed, are left out; ``rejects`` counts them as ``n`` in the pass that
    reads the lines, ``rejected_lines`` in one of its own.  Literals keep their escapes: ``literal_value`` undoes them.
    """
    lines = _parsed_lines(spark, path, literal_mode)
    if rejects is not None:
        lines = lines.observe(rejects, F.count_if(~F.col("ok") & (F.col("s") != "")).alias("n"))
    return lines.where("ok").select("s", "p", "o")


def rejected_lines(spark: SparkSession, path) -> DataFrame:
    """Number of non-empty lines that ``read_triples`` leaves out, as column ``n``."""
    lines = _parsed_lines(spark, path, "whole")
    return lines.where(~F.col("ok") & (F.col("s") != "")).agg(F.count("*").alias("n"))


def _write_lines(lines: DataFrame, path: str, mode: str, compression: str) -> None:
    writer = lines.write.mode(mode).option("compression", compression)
    writer.option("maxRecordsPerFile", FILE_LINES).text(path)


def write_triples(t: DataFrame, path: str, mode: str = "errorifexists", compression: str = "gzip") -> None:
    """Lines ``s p o .``, compressed, in files of bounded length; see ``_lexical`` for literals."""
    line = F.concat_ws(" ", "s", "p", _lexical(F.col("o")), F.lit("."))
    _write_lines(t.select(line.alias("value")), path, mode, compression)


def write_vertices(v: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines ``id uri prop##PropObj##obj ...``.

    A vertex split over several parts (see ``property_bag``) gives one line per part.
    """
    value = lambda x: F.replace(_lexical(x["obj"]), F.lit(PROP_MARK), F.lit(_PROP_MARK_ESCAPED))
    pairs = F.transform("props", lambda x: F.concat(x["prop"], F.lit(PROP_MARK), value(x)))
    head = F.concat_ws(" ", F.col("id").cast("string"), F.trim("uri"))
    v.select(F.concat_ws(" ", head, F.array_join(pairs, " ")).alias("value")).select(
        F.rtrim("value").alias("value")
    ).write.mode(mode).text(path)


def read_vertices(spark: SparkSession, path) -> DataFrame:
    """Vertex lines as ``(id, uri, props)``, one row per line."""
    part = F.split(F.col("value"), " ", 3)
    # A blank starts the next pair only if a predicate and the mark follow it.
    pairs = F.split(F.col("rest"), rf" (?=[^\s\"]+{PROP_MARK})")
    pair = F.transform(pairs, lambda x: F.split(x, PROP_MARK, 2))
    whole = lambda x: F.replace(x, F.lit(_PROP_MARK_ESCAPED), F.lit(PROP_MARK))
    props = F.transform(pair, lambda x: F.struct(x[0].alias("prop"), whole(x[1]).alias("obj")))
    empty = F.array().cast("array<struct<prop:string,obj:string>>")
    return (
        spark.read.text(path)
        .select(
            part[0].cast("bigint").alias("id"),
            part[1].alias("uri"),
            F.get(part, F.lit(2)).alias("rest"),
        )
        .select("id", "uri", F.when(F.col("rest").isNull(), empty).otherwise(props).alias("props"))
    )


def write_edges(e: DataFrame, path: str, mode: str = "errorifexists", compression: str = "gzip") -> None:
    """Lines ``src dst pred``, compressed, in files of bounded length."""
    line = F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), "pred")
    _write_lines(e.select(line.alias("value")), path, mode, compression)


def read_edges(spark: SparkSession, path) -> DataFrame:
    """Edge lines as ``(src, dst, pred)``."""
    part = F.split("value", " ", 3)
    return spark.read.text(path).select(
        part[0].cast("bigint").alias("src"),
        part[1].cast("bigint").alias("dst"),
        part[2].alias("pred"),
    )
