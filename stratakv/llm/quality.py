"""Quality rules: statistics of every text and a learned decision list.

All work is done by SQL expressions.  ``statistics`` reads each text once and
makes one small row of it; the rows are stored, so the texts are not read again.
``learn`` runs sequential covering on the rows that have labels: a rule is grown
condition by condition on two thirds of them by the information gained about
low quality, pruned on the other third, and kept if it is precise there; the
rows that it covers leave, and the next rule follows.  Each step is one
aggregate over binned rows, so what reaches the driver is bounded by features
times bins, whatever the number of labels.  ``verdict`` writes the list as one
ordered CASE expression.

Repeated 3-word windows are found by 64-bit hashes within one text: a text of a
million words sees a false repeat with a chance below one in ten million.

Cases: a null or empty text has zeros everywhere and fails the base; a very long
text is read whole; ties of gain take the first feature and threshold; repeated
rows are judged each; labels that are null or not 0 or 1 are left out, of those
that repeat an id the lowest counts, and without labels every text that passes
the base is kept; an empty table gives none; columns of the input other than
doc_id and text are not carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import stored, table

BINS = 32
MOST_RULES = 8
MOST_CONDITIONS = 4
PRECISION = 0.8
LEAST_COVER = 5

_REPEATS = """
CASE WHEN size(w) < 3 THEN 0 ELSE
  transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h ->
    CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE
      transform(array(array_distinct(transform(array(sort_array(h)), s -> filter(s, (x, j) -> CASE WHEN j = 0 THEN false ELSE x = s[j - 1] END))[0])), d ->
        aggregate(
          CASE WHEN size(d) <= 16 THEN filter(sequence(0, size(h) - 1), i -> array_contains(d, h[i]))
          ELSE transform(array(sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i)))), s ->
            sort_array(transform(filter(s, (e, j) -> CASE WHEN j > 0 THEN e.x = s[j - 1].x ELSE false END OR CASE WHEN j < size(s) - 1 THEN e.x = s[j + 1].x ELSE false END), e -> e.i)))[0]
          END,
          named_struct('at', -3, 'n', 0), (a, q) -> named_struct('at', q, 'n', a.n + least(3, q - a.at)), a -> a.n))[0]
    END)[0]
END
"""

_WORDS = rf"""
transform(array(array_remove(split(text, '[\\x20\\x09-\\x0D]+', -1), '')), w ->
  named_struct('n_words', size(w), 'word_chars', char_length(array_join(w, '')), 'n_repeat_words', {_REPEATS}))[0]
"""

_LINES = r"""
transform(array(filter(split(text, '\\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')), x ->
  named_struct('n', size(x), 'dup', size(x) - size(array_distinct(x))))[0]
"""

#: Each feature and the SQL that makes it of the statistics.
FEATURES = {
    "words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "stop_share": "n_stops / greatest(n_words, 1)",
}


def statistics(docs: DataFrame) -> DataFrame:
    """One row of counts for each text."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = texts.select(
        "doc_id",
        F.expr(_WORDS).alias("w"),
        F.expr(_LINES).alias("x"),
        F.expr("regexp_count(text, '[#*$%&|<>]')").alias("n_symbols"),
        F.expr("regexp_count(text, '[A-Z]')").alias("n_upper"),
        F.expr("regexp_count(text, '[0-9]')").alias("n_digits"),
        F.expr("regexp_count(text, '[.!?]')").alias("n_stops"),
    )
    return counted.select(
        "doc_id",
        *(F.col(f"w.{c}").cast("long").alias(c) for c in ("n_words", "word_chars")),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("x.dup").cast("long").alias("n_dup_lines"),
        F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"),
        F.col("x.n").cast("long").alias("n_lines"),
        *(F.col(c).cast("long").alias(c) for c in ("n_upper", "n_digits", "n_stops")),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    """Thresholds at equal steps of each feature's values, among rows of low quality and among all.

    Values are counted on a grid of three figures, so the counts are exact and few, and the thresholds do not depend on
    how rows are dealt.
    """
    stacked = f"stack({len(FEATURES)}, " + ", ".join(f"'{f}', {sql}" for f, sql in FEATURES.items()) + ") as (feature, value)"
    step = "pow(10D, floor(log10(value)) - 2)"
    grid = F.expr(f"CASE WHEN value > 0 THEN round(value / {step}) * {step} ELSE 0D END").alias("value")
    counted = rows.selectExpr("quality", stacked).groupBy("feature", grid).agg(F.count("*").alias("n_all"), F.count_if(F.col("quality") == 0).alias("n_low"))
    counted = counted.selectExpr("feature", "value", "stack(2, 0, n_all, 1, n_low) as (which, n)").where("n > 0")
    of = Window.partitionBy("feature", "which")
    ranked = counted.select("feature", "value", "n", F.sum("n").over(of.orderBy("value")).alias("upto"), F.sum("n").over(of).alias("total"))
    chosen = ranked.where(f"upto * {BINS} div total > (upto - n) * {BINS} div total AND upto < total").select("feature", "value").distinct().collect()
    return {f: sorted(r.value for r in chosen if r.feature == f) for f in FEATURES}


def _binned(rows: DataFrame) -> tuple[DataFrame, dict[str, list[float]]]:
    """Labelled rows counted by their bins, and the thresholds between bins."""
    cuts = _cuts(rows)

    def place(f: str) -> Column:
        made = ", ".join(f"{c!r}D" for c in cuts[f])
        return F.expr(f"size(filter(array({made}), c -> c < {FEATURES[f]}))" if made else "0").alias(f)

    rows = rows.select("quality", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"), *(place(f) for f in FEATURES))
    return stored(rows.groupBy("quality", "prune", *FEATURES).agg(F.count("*").alias("n")), "binned"), cuts


def _sql_on_bins(rule: Rule, cuts: dict[str, list[float]]) -> str:
    # A row's bin is the number of cuts below its value, so value > cuts[k] means bin > k.
    return " AND ".join(f"{c.feature} {'>' if c.above else '<='} {cuts[c.feature].index(c.threshold)}" for c in rule) or "true"


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """Adds the condition of most gain until no row of good quality is covered or nothing is gained."""
    stacked = f"stack({len(FEATURES)}, " + ", ".join(f"'{f}', {f}" for f in FEATURES) + ") as (feature, bin)"
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS:
        counted = rows.where(_sql_on_bins(rule, cuts)).selectExpr("quality", "n", stacked).groupBy("feature", "bin", "quality").agg(F.sum("n").alias("n")).collect()
        bad, good = (sum(r.n for r in counted if r.quality == q) // len(FEATURES) for q in (0, 1))
        if not bad or not good:
            break
        best, choice = 1e-9, None
        for f in FEATURES:
            own = {(r.bin, r.quality): r.n for r in counted if r.feature == f}
            p = n = 0
            for k, cut in enumerate(cuts[f]):
                p, n = p + own.get((k, 0), 0), n + own.get((k, 1), 0)
                for above, (a, b) in ((False, (p, n)), (True, (bad - p, good - n))):
                    gain = a * (math.log2(a / (a + b)) - math.log2(bad / (bad + good))) if a else 0.0
                    if gain > best:
                        best, choice = gain, Condition(f, above, cut)
        if choice is None or choice in rule:
            break
        rule += (choice,)
    return rule


def _pruned(rows: DataFrame, rule: Rule, cuts: dict[str, list[float]]) -> tuple[Rule, int, int]:
    """The beginning of the rule that separates best on rows kept apart, with the low and good rows it covers."""
    sums = [F.sum(F.expr(f"CASE WHEN quality = {q} AND {_sql_on_bins(rule[:k], cuts)} THEN n ELSE 0 END")).alias(f"c{k}_{q}") for k in range(1, len(rule) + 1) for q in (0, 1)]
    got = rows.agg(*sums).collect()[0]
    scored = [((p - n) / (p + n), -k, p, n) for k in range(1, len(rule) + 1) for p, n in [(got[f"c{k}_0"] or 0, got[f"c{k}_1"] or 0)] if p + n]
    if not scored:
        return (), 0, 0
    _, k, p, n = max(scored)
    return rule[:-k], p, n


def learn(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules that find texts of low quality, the first that holds decides."""
    one_each = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    labelled = stored(stats.join(one_each, "doc_id"), "labelled")
    rows, cuts = _binned(labelled)
    rules: list[Rule] = []
    for _ in range(MOST_RULES):
        rule = _grow(rows.where("NOT prune"), cuts)
        rule, bad, good = _pruned(rows.where("prune"), rule, cuts) if rule else ((), 0, 0)
        if not rule or bad < LEAST_COVER or bad < PRECISION * (bad + good):
            break
        rules.append(rule)
        rows = rows.where(f"NOT ({_sql_on_bins(rule, cuts)})")
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    if not rules:
        return F.lit(None).cast("int")
    return F.expr("CASE " + " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN {i}" for i, rule in enumerate(rules, 1)) + " END")


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of each text, whether it failed the base, the rule that rejects it (0: the base) and whether it is kept."""
    stats = stored(statistics(docs), "quality")
    rules = learn(stats.where(f"NOT ({BASE_FAILED})"), labels)
    judged = stats.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(verdict(rules)))
    return judged.withColumn("kept", F.col("rule").isNull())


def op1_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
