"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Four ratios of a text are tested against cutoffs. A labelled holdout decides the
cutoffs, apart for every stratum (language) and rule: candidates go from the
most lenient to the strictest, each is tested by an exact binomial tail - the
chance of so few rejected good documents if the true rate were `alpha` - and the
sequence stops at the first that fails (fixed-sequence testing). The error
probability is split evenly over strata and rules (Bonferroni). Among the
certified cutoffs the one that parts bad from good best is taken; a rule without
one is off in that stratum. So with probability 1 - `delta` no rule rejects more
than `alpha` of the good documents of any stratum.

Edge cases: a null text has no words and fails the base rule; a null or unseen
stratum, or an empty label table, leaves all rules off; labels that repeat count
once per row, null labels are ignored; a null doc_id has no label, and in the
pipeline such rows are judged each by its own text; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, materialize, row_key, table, whole_row, words

ALPHA, DELTA, STEPS = 0.005, 0.05, 50
MIN_WORDS, REPEAT_PERCENT = 10, 20
#: Ratio -> its numerator; the denominator is n_words, or n_lines.
RULES = {"symbols": ("n_symbols", "n_words"), "shouts": ("n_shouts", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}


def _repeat_words(w: Column) -> Column:
    """Words within 5-word windows that the text has twice or more.

    Windows are hashed first; only a text in which two hashes agree is decided
    on the windows themselves, by sorting them with their positions.
    """

    def exact(w):
        wins = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(5)]).alias("s"), i.alias("i")))

        def marked(s):
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (F.get(s, k)["s"] == F.coalesce(F.get(s, k - 1)["s"], F.lit(""))) | (F.get(s, k)["s"] == F.coalesce(F.get(s, k + 1)["s"], F.lit(""))))
            at = F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))
            zero = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(at, zero, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(5), x - a["last"])).alias("n")))["n"]

        return let(F.sort_array(wins), marked)

    def of(w):
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(w)).otherwise(0))

    return let(w, lambda v: F.when(F.size(v) >= 6, of(v)).otherwise(0))


def text_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """The counts of every text, beside the columns `keep`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    long = lambda c, name: c.cast("long").alias(name)
    w = words(text)
    return docs.select(
        *keep,
        long(F.size(w), "n_words"),
        long(F.length(F.array_join(w, "")), "word_chars"),
        long(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), "n_symbols"),
        long(let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))), "n_dup_lines"),
        long(_repeat_words(w), "n_repeat_words"),
        long(F.regexp_count(text, F.lit(r"\p{Lu}\p{Lu}+")), "n_shouts"),
        long(F.size(F.split(text, "\n")), "n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words"))


def _level(rule: str) -> Column:
    """The ratio on a grid of STEPS levels; a cutoff c rejects levels >= c."""
    a, b = RULES[rule]
    return F.floor(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1))) * STEPS)


def _lgamma(x: Column) -> Column:
    y = x + F.lit(8.0)
    down = F.lit(0.0)
    for k in range(8):
        down = down + F.log(x + F.lit(float(k)))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - down


def _binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed from k downwards; terms beyond 40 deviations are under 1e-300."""
    n, k = n.cast("double"), k.cast("double")
    first = F.exp(_lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    terms = F.least(k, 100 + 40 * F.sqrt(n * p)).cast("int")
    zero = F.struct(first.alias("t"), first.alias("s"))
    ratio = (1 - p) / p

    def step(a, j):
        t = a["t"] * (k - j + 1) / (n - k + j) * ratio
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, zero, step)["s"]


def certify(levels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, level, good) per labelled row -> (stratum, rule, cutoff) of the certified rules.

    What is windowed are counts, at most STEPS + 1 rows a stratum and rule.
    """
    g = levels.where(F.col("good").isNotNull() & F.col("stratum").isNotNull())
    g = materialize(g.groupBy("stratum", "rule", "level").agg(F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("g"), F.sum(F.when(F.col("good"), 0).otherwise(1)).alias("b")))
    every = g.select("stratum", "rule").distinct().select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(STEPS).cast("long"))).alias("level"))
    # One number: of strata and rules.
    tests = g.select("stratum").distinct().count() * len(RULES)
    totals = g.groupBy("stratum", "rule").agg(F.sum("g").alias("good"), F.sum("b").alias("bad"))
    grid = every.join(g, ["stratum", "rule", "level"], "left").join(totals, ["stratum", "rule"])
    above = W.partitionBy("stratum", "rule").orderBy(F.col("level").desc()).rowsBetween(W.unboundedPreceding, 0)
    grid = grid.select("*", F.sum(F.coalesce("g", F.lit(0))).over(above).alias("k"), F.sum(F.coalesce("b", F.lit(0))).over(above).alias("hit"))
    ok = (F.col("k") < F.col("good") * alpha) & (_binomial_tail(F.col("good"), F.col("k"), alpha) <= delta / max(tests, 1))
    grid = grid.select("*", F.min(F.when(ok, 1).otherwise(0)).over(above).alias("ok"))
    gain = F.col("hit") * F.greatest(F.col("good"), F.lit(1)) - F.lit(4) * F.col("k") * F.greatest(F.col("bad"), F.lit(1))
    best = grid.where((F.col("ok") == 1) & (F.col("hit") > 0) & (gain > 0)).select("stratum", "rule", F.struct(gain.alias("gain"), F.col("level").alias("level")).alias("v"))
    return best.groupBy("stratum", "rule").agg(F.max("v").alias("v")).select("stratum", "rule", F.col("v.level").alias("cutoff"))


def _measured(docs: DataFrame, stratum: str, *keep) -> DataFrame:
    levels = [_level(r).alias(r) for r in RULES]
    return text_stats(docs, *keep, F.col(stratum).cast("string").alias("stratum")).select("*", base_failed().alias("base_failed"), *levels)


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and the certified cutoff of each rule (null: off), from texts as _measured gives them."""
    lab = labels.where(F.col("quality").isNotNull()).select("doc_id", (F.col("quality") == 1).alias("good"))
    seen = measured.where(~F.col("base_failed")).select("doc_id", "stratum", *RULES).join(lab, "doc_id")
    seen = seen.select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in RULES])).alias("x")).select("stratum", "good", "x.rule", "x.level")
    return certify(seen, alpha, delta).groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def _kept() -> Column:
    hit = F.lit(False)
    for r in RULES:
        hit = hit | F.coalesce(F.col(r) >= F.col(f"cut_{r}"), F.lit(False))
    return ~F.col("base_failed") & ~hit


def apply_quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed, kept: one row per row of docs."""
    s = materialize(_measured(docs, stratum, "doc_id"))
    out = s.join(materialize(cutoffs(s, labels, alpha, delta)), "stratum", "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", _kept().alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, stratum: str = "lang") -> DataFrame:
    """Pipeline stage: the kept documents, whole. Every row is judged by its own text, whatever its doc_id: null, or that of other rows."""
    a, b = row_key(docs, "doc_id", "text", stratum)
    s = materialize(_measured(docs, stratum, "doc_id", a.alias("a"), b.alias("b")))
    cut = materialize(cutoffs(s, table(spark, sf_dir, "labels")))
    kept = s.join(cut, "stratum", "left").where(_kept()).select("a", "b")
    return docs.select(whole_row(docs).alias("row"), a.alias("a"), b.alias("b")).join(kept, ["a", "b"], "left_semi").select("row.*")


def sql(docs: str = "documents") -> str:
    """DuckDB SQL of op2 over a relation `docs`, as a list of common table expressions ending in op2."""
    rules = " UNION ALL ".join(
        f"SELECT doc_id, stratum, '{r}' AS rule, CAST(floor(least(1.0::DOUBLE, {a}::DOUBLE / greatest({b}, 1)) * {STEPS}) AS BIGINT) AS level FROM q2 WHERE NOT base_failed" for r, (a, b) in RULES.items()
    )
    return f"""
q0 AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls
  FROM {docs}
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM q0 WHERE len(w) >= 5)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
  ) GROUP BY doc_id
), q1 AS (
  SELECT q0.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(regexp_extract_all(text, '\\p{{Lu}}\\p{{Lu}}+')) AS BIGINT) AS n_shouts,
    CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines
  FROM q0 LEFT JOIN rep ON rep.doc_id = q0.doc_id
), q2 AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM q1
), lv AS (
  SELECT r.stratum, r.rule, r.level, l.quality = 1 AS good FROM ({rules}) r JOIN labels l ON l.doc_id = r.doc_id
  WHERE l.quality IS NOT NULL AND r.stratum IS NOT NULL
), cnt AS (
  SELECT stratum, rule, level, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE NOT good) AS b FROM lv GROUP BY ALL
), tot AS (
  SELECT stratum, rule, sum(g) AS good, sum(b) AS bad FROM cnt GROUP BY ALL
), grid AS (
  SELECT t.stratum, t.rule, v.level, t.good, t.bad,
    (SELECT coalesce(sum(g), 0) FROM cnt c WHERE c.stratum = t.stratum AND c.rule = t.rule AND c.level >= v.level) AS k,
    (SELECT coalesce(sum(b), 0) FROM cnt c WHERE c.stratum = t.stratum AND c.rule = t.rule AND c.level >= v.level) AS hit
  FROM tot t, (SELECT unnest(range(1, {STEPS + 1})) AS level) v
), tail AS (
  SELECT *, k < good * {ALPHA} AND list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j:
    exp(lgamma(good + 1) - lgamma(j + 1) - lgamma(good - j + 1) + j * ln({ALPHA}) + (good - j) * ln({1 - ALPHA}))))
    <= {DELTA} / ((SELECT count(DISTINCT stratum) FROM cnt) * {len(RULES)}) AS ok
  FROM grid
), cer AS (
  SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY level DESC) AS certified,
    hit * greatest(good, 1) - 4 * k * greatest(bad, 1) AS gain FROM tail
), cut AS (
  SELECT stratum, rule, level AS cutoff FROM cer WHERE certified AND hit > 0 AND gain > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, level DESC) = 1
), bad2 AS (
  SELECT DISTINCT r.doc_id FROM ({rules}) r JOIN cut ON cut.stratum = r.stratum AND cut.rule = r.rule AND r.level >= cut.cutoff
), op2 AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad2) AS kept FROM q2
)"""


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {"op2_quality_rules": f"WITH {sql()} SELECT * FROM op2"}
