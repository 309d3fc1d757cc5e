"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule rejects a document whose measure exceeds a cutoff from a fixed grid. Labelled documents are
split by a hash of their id, per stratum (language). On the tuning part each rule gets the cutoff that
rejects most bad documents, each good one weighing ``GOOD_WEIGHT`` bad ones (ties: the highest), and the
rules that gain anything are put in order of their gain. That fixes a sequence of growing sets of rules.
On the holdout the sets are tested in turn, from the loosest: a set may be used only if the exact
binomial test refutes that all its rules together reject more than ``risk`` of the stratum's good
documents, at level ``level / strata`` (Bonferroni over strata; within one, the first set that fails ends
the sequence, which needs no further correction). So with probability 1 - level no stratum loses more
than ``risk`` of its good documents. The largest set that passes is used; a stratum with too few labels
to prove anything (fewer than some 90 good ones in the holdout) uses none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, stored, table, words

SYMBOLS = "[#*$%&|<>]"
RULES = ("symbol_rate", "repeat_rate", "dup_line_rate", "upper_rate", "shout_rate")
GRID = (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8)
RISK, LEVEL, GOOD_WEIGHT = 0.05, 0.05, 10
#: Labelled documents whose hash begins with a digit below this tune cutoffs, the others test them.
TUNING = "5"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _repeated(h: str, w: str) -> tuple[Column, Column]:
    """(windows, places): three-word windows sorted so that equal ones meet, and the places of those
    that occur twice or more, read from the column ``win`` that holds the windows. Hashes only rule
    out; windows are compared as words. ``h``, ``w``: columns with the windows' hashes and the words."""
    windows = F.sort_array(
        F.transform(
            h, lambda x, i: F.struct(x.alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))
        )
    )

    def same(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    found = F.array_compact(
        F.transform(F.col("win"), lambda x, i: F.when(
            F.coalesce(same(x, F.get("win", i + 1)), F.lit(False)) | F.coalesce(same(x, F.get("win", i - 1)), F.lit(False)), x["i"]))
    )
    return windows, F.sort_array(found)


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``lectern_quality`` of all counts and measures; null text is empty."""
    held = [F.col(f"`{c}`") for c in docs.columns]
    t = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    one = docs.select(F.struct(*held).alias("row"), t.alias("t"), words(F.col("text")).alias("w"), lines.alias("lines"))
    two = one.withColumns(
        {"n": F.size("w"), "h": F.slice(
            F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), 1, F.greatest(F.size("w") - 2, F.lit(0)))}
    )
    windows, found = _repeated("h", "w")
    three = two.withColumn("win", F.when(F.size(F.array_distinct("h")) < F.size("h"), windows))
    four = three.withColumn("pos", found)
    covered = F.aggregate(
        F.transform("pos", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("pos", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    counts = {
        "n_words": F.col("n").cast("long"),
        "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": _count(F.col("t"), SYMBOLS),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_upper": _count(F.col("t"), r"\p{Lu}"),
        "n_shouts": _count(F.col("t"), "!"),
        "n_lines": F.size("lines").cast("long"),
    }
    five = four.select("row", F.struct(*[v.alias(k) for k, v in counts.items()]).alias("q"))
    q = F.col("q")

    def rate(part: str, whole: str) -> Column:
        return F.coalesce(q[part] / F.nullif(q[whole], F.lit(0)), F.lit(0.0))

    measures = {
        "symbol_rate": rate("n_symbols", "word_chars"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "upper_rate": rate("n_upper", "word_chars"),
        "shout_rate": rate("n_shouts", "word_chars"),
    }
    failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    return five.select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns],
        F.struct(*[q[k].alias(k) for k in counts], *[v.alias(k) for k, v in measures.items()], failed.alias("base_failed")).alias("lectern_quality"),
    )


def _log_gamma(x: Column) -> Column:
    """For x >= 1, by Stirling's series after a shift by eight."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = F.log(x)
    for k in range(1, 8):
        shift = shift + F.log(x + k)
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact to rounding, for k < n p; 1 beyond, where no test could refute.
    Terms fall off below k, so the sum ends after some standard deviations."""
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(
        _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    )
    steps = F.least(k, 60 * F.sqrt(n * p) + 200).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, j: F.struct(
            (a["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("term"), (a["sum"] + a["term"]).alias("sum")
        ),
        lambda a: a["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), first * total))


def is_tuning(doc_id: Column) -> Column:
    """Five of sixteen documents; the rest are the holdout."""
    return F.substring(F.sha2(F.concat(F.lit("split:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 1) < TUNING


def tuned_rules(tuning: DataFrame) -> DataFrame:
    """stratum and path: an array of (gain, at, rule, cutoff), best gain first, then the rules' own order.
    Sums run before the shuffle."""
    points = F.explode(F.array(*[
        F.struct(F.lit(i).alias("at"), F.lit(c).alias("cutoff"), (F.col(r) > c).cast("long").alias("hit")) for i, r in enumerate(RULES) for c in GRID
    ])).alias("p")
    good = (F.col("quality") == 1).cast("long")
    gain = F.sum((1 - good) * F.col("p.hit")) - GOOD_WEIGHT * F.sum(good * F.col("p.hit"))
    gains = tuning.select("stratum", "quality", points).groupBy("stratum", F.col("p.at").alias("at"), F.col("p.cutoff").alias("cutoff")).agg(gain.alias("gain")).where("gain > 0")
    best = gains.groupBy("stratum", "at").agg(F.max(F.struct("gain", "cutoff")).alias("b"))
    rule = F.element_at(F.array(*map(F.lit, RULES)), F.col("at") + 1)
    return best.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct((-F.col("b.gain")).alias("loss"), "at", rule.alias("rule"), F.col("b.cutoff").alias("cutoff")))).alias("path"))


def select_cutoffs(labelled: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """stratum, rule, cutoff: the rules that may reject. ``labelled``: stratum, tuning, quality (1 good, 0
    bad) and the measures, of documents that pass the base rules."""
    paths = tuned_rules(labelled.where("tuning"))
    value = F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(r))])
    joined = labelled.where("NOT tuning AND quality = 1").select("stratum", value.alias("value")).join(paths, "stratum", "left")
    # The first rule of the path that rejects it: sets from that one on do too.
    first = F.array_min(F.filter(F.transform("path", lambda x, i: F.when(F.try_element_at("value", x["rule"]) > x["cutoff"], i)), lambda i: i.isNotNull()))
    upto = [F.count_if(F.coalesce(F.col("first") <= j, F.lit(False))).alias(f"k{j}") for j in range(len(RULES))]
    tallies = joined.select("stratum", "path", first.alias("first")).groupBy("stratum").agg(F.first("path").alias("path"), F.count(F.lit(1)).alias("n"), *upto)
    strata = F.count(F.lit(1)).over(W.partitionBy())  # one row per stratum
    passed = [F.when((F.size("path") > j) & (binomial_tail(F.col(f"k{j}"), F.col("n"), risk) * F.col("strata") <= level), 1).otherwise(0) for j in range(len(RULES))]
    n_passed = sum(passed[1:], passed[0])  # a larger set rejects no less, so those that pass come first
    tested = tallies.withColumn("strata", strata).where("path IS NOT NULL").withColumn("passed", n_passed).where("passed > 0")
    return tested.select("stratum", F.inline(F.slice("path", F.lit(1), F.col("passed")))).select("stratum", "rule", "cutoff")


def _stratum() -> Column:
    """The language, null apart from the empty one."""
    return F.coalesce(F.concat(F.lit("s"), F.col("lang")), F.lit("n"))


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, lang, any others) with ``lectern_quality``,
    the counts and measures, and ``lectern_kept``, the verdict.

    Null or empty text has no words and fails the base rules; a null lang is a stratum of its own.
    Labels with null or contradicting quality are left out; repeated labels count once; repeated
    documents are judged alike. Columns of ``docs`` with the names of counts keep their values.
    Empty tables give no rows; without labels the base rules alone decide.
    """
    return _verdicts(stored(with_features(docs)), labels, risk, level)


def _verdicts(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    q = F.col("lectern_quality")
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    labelled = (
        measured.where(~q["base_failed"])
        .select("doc_id", _stratum().alias("stratum"), is_tuning(F.col("doc_id")).alias("tuning"), *[q[r].alias(r) for r in RULES])
        .dropDuplicates(["doc_id"])
        .join(known, "doc_id")
    )
    cutoffs = stored(
        select_cutoffs(labelled, risk, level)
        .groupBy("stratum")
        .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    )
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(q[r] > F.try_element_at("lectern_cutoffs", F.lit(r)), F.lit(False))
    joined = measured.join(
        cutoffs.select(F.col("stratum").alias("lectern_stratum"), F.col("cutoffs").alias("lectern_cutoffs")),
        _stratum() == F.col("lectern_stratum"),
        "left",
    )
    return joined.withColumn("lectern_kept", ~q["base_failed"] & ~over).drop("lectern_stratum", "lectern_cutoffs")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are not needed once they are measured: only the counts are stored.
    measured = stored(with_features(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text"))
    out = _verdicts(measured, table(spark, sf_dir, "labels"))
    q = F.col("lectern_quality")
    return out.select("doc_id", *[q[c].alias(c) for c in BASE], q["base_failed"].alias("base_failed"), F.col("lectern_kept").alias("kept"))


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return judged(docs, table(spark, sf_dir, "labels")).where("lectern_kept").select(*[f"`{c}`" for c in docs.columns])


QUERIES = {"op8_quality_rules": op8_quality_rules}
_RATES = {
    "symbol_rate": ("n_symbols", "word_chars"), "repeat_rate": ("n_repeat_words", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"),
    "upper_rate": ("n_upper", "word_chars"), "shout_rate": ("n_shouts", "word_chars"),
}

ORACLES = {
    "op8_quality_rules": r"""
WITH cut AS (
  SELECT doc_id, lang, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)
), windows AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM cut)
), twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1
), covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) v(d) GROUP BY doc_id
), counts AS (
  SELECT cut.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
    length(t) - length(replace(t, '!', '')) AS n_shouts, len(l) AS n_lines
  FROM cut LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce('s' || lang, 'n') AS stratum FROM counts
), measured AS (
  """
    + " UNION ALL ".join(
        f"SELECT doc_id, stratum, base_failed, '{r}' AS rule, coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0) AS value FROM judged" for r, (a, b) in _RATES.items()
    )
    + r"""
), known AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id HAVING min(quality) = max(quality)
), labelled AS (
  SELECT measured.*, quality, substr(sha256('split:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 1) < '"""
    + TUNING
    + r"""' AS tuning FROM measured JOIN known USING (doc_id) WHERE NOT base_failed
), gains AS (
  SELECT stratum, rule, cutoff, count(*) FILTER (quality <> 1 AND value > cutoff) - """
    + str(GOOD_WEIGHT)
    + r""" * count(*) FILTER (quality = 1 AND value > cutoff) AS gain
  FROM labelled, (SELECT unnest(["""
    + ", ".join(map(str, GRID))
    + r"""]) AS cutoff) WHERE tuning GROUP BY stratum, rule, cutoff
), best AS (SELECT * FROM gains WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cutoff DESC) = 1
), path AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, list_position(["""
    + ", ".join(f"'{r}'" for r in RULES)
    + rf"""], rule)) AS place FROM best
), hits AS (SELECT doc_id, min(place) AS place FROM labelled JOIN path USING (stratum, rule) WHERE NOT tuning AND quality = 1 AND value > cutoff GROUP BY doc_id
), goods AS (SELECT stratum, h.place FROM (SELECT DISTINCT doc_id, stratum FROM labelled WHERE NOT tuning AND quality = 1) LEFT JOIN hits h USING (doc_id)
), sizes AS (SELECT stratum, count(*) AS n, count(*) OVER () AS strata FROM goods GROUP BY stratum
), tallies AS (SELECT path.stratum, path.rule, path.cutoff, n, strata, (SELECT count(*) FROM goods WHERE goods.stratum = path.stratum AND goods.place <= path.place) AS k FROM path JOIN sizes USING (stratum)
), cutoffs AS (
  SELECT stratum, rule, cutoff FROM (SELECT *, CASE WHEN k >= n * {RISK} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}) + (n - j) * ln(1 - {RISK})))) END AS p_value FROM tallies) WHERE p_value * strata <= {LEVEL}
), over_ AS (SELECT DISTINCT doc_id FROM measured JOIN cutoffs USING (stratum, rule) WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM over_) AS kept FROM judged""",
}
