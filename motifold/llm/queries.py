"""Registered queries of the operators of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from motifold.llm import (
    language_id,
    lm_score,
    minhash_forest,
    mixing,
    nn_descent,
    packing,
    periodic_runs,
    quality_model,
    quality_rules,
    repeats,
    secret_scan,
    url_filter,
    whitening,
)
from motifold.llm.work import WORD, documents


def _remainder(parts: int):
    return F.crc32(F.col("doc_id").cast("string")) % parts


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op1_repeats(spark, sf_dir):
    return repeats.repeats(documents(spark, sf_dir))


def op2_quality_model(spark, sf_dir):
    """Grades: 0 toxic, 1 of low quality, 2 good; kept: more likely good than not."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grade = F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality"))
    model = quality_model.fit(docs, labels.select("doc_id", grade.alias("grade")))
    scored = quality_model.score(docs, model)
    return scored.select(
        "doc_id",
        "expected_grade",
        F.col("tails")[0].alias("tail_1"),
        F.col("tails")[1].alias("tail_2"),
        (F.col("tails")[1] >= 0.5).alias("kept"),
    )


def op3_context_tree(spark, sf_dir):
    docs = documents(spark, sf_dir)
    scored = lm_score.score(docs, _remainder(7) != 2)
    return scored.select(
        "doc_id",
        (_remainder(7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        "bits_per_byte",
    )


def op4_secret_scans(spark, sf_dir):
    found = secret_scan.find(documents(spark, sf_dir))
    base = tuple(r.kind for r in secret_scan.BASE)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(_joined(F.filter("spans", lambda x: x["kind"].isin(*base))), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


def op5_nn_descent(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nn_descent.nearest(vectors, F.col("id") % 20 == 0)


def op6_quality_rules(spark, sf_dir):
    measured = quality_rules.measure(documents(spark, sf_dir))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", F.array_join("broken", ",").alias("broken"), "kept",
    )


def op7_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = language_id.learn(docs.where(_remainder(5) != 0).select("lang", "text"))
    narrow = docs.select(F.struct("doc_id", (_remainder(5) == 0).alias("held_out")).alias("id"), "text")
    return language_id.predict(narrow, model, "id").select("id.*", "lang_pred", "score")


def op8_minhash_forest(spark, sf_dir):
    return minhash_forest.near_duplicates(documents(spark, sf_dir))


def op9_mixing(spark, sf_dir):
    narrow = documents(spark, sf_dir).select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    return mixing.mix(narrow, F.col("size")).select(
        "doc_id",
        "source",
        "size",
        F.col("_mix_total").alias("source_size"),
        F.col("_mix_target").alias("target"),
        F.col("_mix_taken").alias("taken"),
    )


def op10_packing(spark, sf_dir):
    pieces = packing.pack(documents(spark, sf_dir))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op11_url_filter(spark, sf_dir):
    judged = url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judged.select(
        "page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", F.array_join("terms", ",").alias("terms")
    )


def op12_whitening(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = whitening.whiten(vectors, whitening.fit(vectors))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def planted_cycles(text, doc_id):
    """``text``; for one id in ten its words from a place given by the id on are made to go round in a cycle."""
    code = F.crc32(doc_id.cast("string"))

    def cycled(words):
        n = F.size(words).cast("long")
        g = F.floor(code / 10)
        a = g % n
        period = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % period).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), at), " "))

    words = F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))  # one element, so that it is found once
    return F.when(code % 10 == 0, F.transform(words, cycled)[0]).otherwise(text)


def op13_periodic_runs(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", planted_cycles(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs.find(docs)
    best = F.col("strongest")
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def pipeline(spark, sf_dir):
    """The rows of ``corpus_pipeline.run``, with a checksum in place of the ids."""
    pieces = corpus_pipeline.run(spark, sf_dir)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {
    f.__name__: f
    for f in (
        op1_repeats,
        op2_quality_model,
        op3_context_tree,
        op4_secret_scans,
        op5_nn_descent,
        op6_quality_rules,
        op7_language_id,
        op8_minhash_forest,
        op9_mixing,
        op10_packing,
        op11_url_filter,
        op12_whitening,
        op13_periodic_runs,
        pipeline,
    )
}

_WORD = r"'[^\x20\x09-\x0D]+'"
_GAP = r"'[\x20\x09-\x0D]+'"
_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)


def _rule_sql(rule: quality_rules.Rule) -> str:
    tests = []
    if rule.least is not None:
        tests.append(f"{rule.measure} < {rule.least!r}::DOUBLE")
    if rule.most is not None:
        tests.append(f"{rule.measure} > {rule.most!r}::DOUBLE")
    return f"CASE WHEN {' OR '.join(tests)} THEN '{rule.name}' END"


QUALITY_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g
  FROM w, LATERAL (SELECT unnest(range(1, len(words) - 6)) AS i)),
dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, range(8) AS r(j) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, {_GAP}, '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    len(list_filter(words, lambda x: lower(translate(x, '.,;:!?"''()', '')) IN ({_STOP})))::BIGINT AS n_stop_words,
    length(regexp_replace(text, '[\x00-@\[-`{{-\x7f]', '', 'g'))::BIGINT AS n_letters
  FROM w LEFT JOIN cov USING (doc_id)),
r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS chars_per_word,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_lines_per_line,
    CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_words_per_word,
    CASE WHEN word_chars > 0 THEN n_letters / word_chars ELSE 0 END AS letters_per_char,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM c),
b AS (
  SELECT *, concat_ws(',', {", ".join(map(_rule_sql, quality_rules.RULES))}) AS broken FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, broken,
  NOT base_failed AND broken = '' AS kept
FROM b"""

MIXING_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, md5(doc_id::VARCHAR) AS k,
    coalesce(len(regexp_extract_all(text, {_WORD})), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS total,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 2 * total AS cap,
    (1.5::DOUBLE * sum(total) OVER ()::DOUBLE - coalesce(sum(2 * total) OVER before, 0)::DOUBLE)
      / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
  FROM s
  WINDOW before AS (ORDER BY 2 * total::DOUBLE / w, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, cap::DOUBLE / w <= level AS filled FROM f),
t AS (
  SELECT *, CASE WHEN filled THEN cap::DOUBLE
    ELSE (SELECT arg_min(level, cap::DOUBLE / w) FROM o WHERE NOT filled) * w END AS target
  FROM o),
p AS (
  SELECT d.doc_id, d.source, d.size, t.total, t.target, floor(t.target + 0.5)::BIGINT AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, total AS source_size, target,
  (CASE WHEN total > 0 THEN (budget // total) * size
    + least(size, greatest(0, budget % total - before)) ELSE 0 END)::BIGINT AS taken
FROM p"""

SQL = {"op6_quality_rules": QUALITY_SQL, "op9_mixing": MIXING_SQL}

_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_STRICT = ", ".join(f"'{t}'" for t in url_filter.STRICT)
_SOFT = ", ".join(f"'{t}'" for t in url_filter.SOFT)


def _fits_sql(rule: url_filter.Rule) -> str:
    return (
        f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')"
    )


def _rules_sql(value: str) -> str:
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r.name), -len(r.host)))
    return "CASE " + " ".join(f"WHEN {_fits_sql(r)} THEN '{getattr(r, value)}'" for r in rules) + " END"


URL_SQL = rf"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, url, translate(raw, {_CAPITALS}) AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM h),
w AS (
  SELECT *, string_split_regex(translate(url, {_CAPITALS}), '[^a-z\x{{80}}-\x{{10FFFF}}]+') AS words FROM p),
c AS (
  SELECT *, len(list_filter(words, lambda x: x IN ({_STRICT})))::BIGINT AS strict_hits,
    len(list_filter(words, lambda x: x IN ({_SOFT})))::BIGINT AS soft_hits,
    list_filter([{_STRICT}, {_SOFT}], lambda x: list_contains(words, x)) AS found
  FROM w)
SELECT page_id, host, path, {_rules_sql("name")} AS rule,
  coalesce({_rules_sql("verdict")},
    CASE WHEN strict_hits > 0 OR len(found) >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  strict_hits, soft_hits, array_to_string(found, ',') AS terms
FROM c"""

# The checksum of a text's bytes, bit by bit: each digit is followed by eight steps of the polynomial.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""
_REPEATS, _LEAST = periodic_runs.REPEATS, periodic_runs.LEAST_WORDS

RUNS_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, {_CRC32} AS h, regexp_extract_all(coalesce(text, ''), {_WORD}) AS given FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, h, given, len(given) AS n, h // 10 % greatest(len(given), 1) AS a FROM d),
t AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: given[1 + CASE WHEN i < a THEN i
      ELSE a + (i - a) % (1 + (n - a) // (3 + h // 10 % 8)) END])
    ELSE given END AS words
  FROM g),
w AS MATERIALIZED (SELECT doc_id, n, unnest(words) AS word, unnest(range(n)) AS i FROM t),
m AS (
  SELECT x.doc_id, x.i, x.i - y.i AS q
  FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i < x.i AND (x.i - y.i) * {_REPEATS} <= x.n),
s AS (
  SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({_LEAST}, {_REPEATS} * q)),
r AS MATERIALIZED (
  SELECT doc_id, start::BIGINT AS start, length::BIGINT AS length, min(q)::BIGINT AS period FROM s GROUP BY ALL),
e AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM r GROUP BY doc_id),
b AS (
  SELECT * FROM r
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept
  FROM w WHERE NOT EXISTS (
    SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND i >= start + period AND i < start + length)
  GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start, length, period,
  1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(kept, '')) AS collapsed_sha256, n AS n_words
FROM t LEFT JOIN e USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""

SQL |= {"op11_url_filter": URL_SQL, "op13_periodic_runs": RUNS_SQL}
