"""Quality rules whose cutoffs are certified on labelled documents.  DataFrame functions only.

Every document gets counts of words, word characters, symbols, repeated lines and words in repeated 5-word windows.  Base
rules with fixed limits come first.  Then each rule of ``RULES`` rejects a document whose measure reaches a cutoff, and
that cutoff is chosen by *risk control*: for every stratum (a language), rule and candidate cutoff, the good documents
among the labelled ones that the cutoff would reject are counted, k of n.  A cutoff is certified if

    P[Binomial(n, share) <= k] <= delta / (number of tests),

that is, if the exact (Clopper-Pearson) upper bound of its false rejection rate is below ``share``.  ``share`` is alpha /
number of rules, so all rules together wrongly reject at most alpha of a stratum's good documents.  The number of tests is
strata x rules (Bonferroni): within a rule the candidates, fixed beforehand, are tested from lenient to strict up to the
first failure, which needs no further correction.  All bounds hold at once with probability 1 - delta.  Of the certified
cutoffs the one wins that rejects most labelled bad documents, each good one weighing as much as ``PRICE`` bad ones; where
none gains by that count or is certified, as in strata without labels, the rule rejects nothing.

Defined results: null text has no words and fails the base rules; null strata are a stratum of their own; labels of
unknown documents are ignored, and of conflicting labels the worst counts; a document listed twice is judged
twice, but its label counts once; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import BLANKS, boxed, keys_of, let, pin, row_hash, small, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
#: Bad documents that a cutoff must reject for each good one.
PRICE = 20
#: Rule: the measure of a document, and the candidate cutoffs from lenient to strict.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05]),
    "repeats": ("n_repeat_words / n_words", [0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.04]),
    "lines": ("n_dup_lines / n_words", [0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01]),
    "long_words": ("word_chars / n_words", [30.0, 20.0, 15.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0]),
    "short_words": ("- word_chars / n_words", [-1.5, -2.0, -2.5, -3.0, -3.25, -3.5, -3.75]),
}


def _repeated(words: Column) -> Column:
    """Number of words in windows of WINDOW words that occur twice or more; windows are compared by 64-bit hash."""

    def covered(hashes: Column) -> Column:
        """Positions of repeated windows in order; each covers the words up to the next one, WINDOW at most."""
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(let(by_hash, positions), total)

    def of(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    windows = let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW))))
    return F.when(F.size(words) > WINDOW, let(windows, of)).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, t.alias("_t"), words_of(t).alias("_w"))
    lines = F.filter(F.split("_t", "\n", -1), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    out = rows.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("_w")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    return out.withColumn("base_failed", failed)


def _binomial_below(k: Column, n: Column, p: float) -> Column:
    """P[Binomial(n, p) <= k], exactly, by adding up log terms scaled by the largest so far.

    Only asked where k <= n p: there the terms rise to the last one, so the sum runs from k down.
    """
    odds = (1 - p) / p
    # log of C(n, k) as a sum of logs keeps full precision for the sizes at hand; k is at most n p
    log_choose = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.lit(0.0), lambda a, j: a + F.log((n - k + j).cast("double") / j))
    log_last = F.when(k > 0, log_choose).otherwise(0.0) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    step = lambda a, j: F.struct((a["term"] * (k - j + 1) / (n - k + j) * odds).alias("term"), (a["sum"] + a["term"] * (k - j + 1) / (n - k + j) * odds).alias("sum"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    series = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, step)["sum"]).otherwise(1.0)
    return F.exp(log_last + F.log(series))


def certified(measured: DataFrame, labels: DataFrame, stratum: str, alpha: float, delta: float) -> DataFrame:
    """(stratum, rule, cutoff, n, k, bad) of the best certified cutoffs; at most one row for a stratum and rule."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    held = measured.where(~F.col("base_failed")).join(known, "doc_id")
    # a label is one trial, however often its document is repeated: of different rows with its doc_id, that of least hash
    held = held.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in held.columns if c != "doc_id"]), F.xxhash64(*measured.columns)).alias("x")).select("x.*")
    reached = [
        F.struct(F.lit(name).alias("rule"), sum(F.when(F.expr(of) >= c, 1).otherwise(0) for c in cutoffs).alias("depth"))
        for name, (of, cutoffs) in RULES.items()
    ]
    depths = held.select(F.col(stratum).alias("stratum"), "q", F.inline(F.array(*reached)))
    depths = depths.groupBy("stratum", "rule", "depth").agg(F.count_if(F.col("q") == 1).alias("good"), F.count_if(F.col("q") != 1).alias("bad"))
    grid = F.create_map(*[x for name, (_, cutoffs) in RULES.items() for x in (F.lit(name), F.array(*[F.lit(c) for c in cutoffs]))])
    at = F.collect_list(F.struct("depth", "good", "bad"))  # a row for each cutoff at most
    found = depths.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), at.alias("at"))
    tests = found.select("stratum", "rule", "n", "at", F.posexplode(grid[F.col("rule")]).alias("place", "cutoff"))
    # a document reaches the strictest ``depth`` cutoffs
    beyond = lambda of: F.aggregate(F.filter("at", lambda e: e["depth"] >= F.size(grid[F.col("rule")]) - F.col("place")), F.lit(0).cast("long"), lambda a, e: a + e[of])
    strata = found.select("stratum").distinct().agg(F.count(F.lit(1)).alias("strata"))
    tests = tests.select("stratum", "rule", "place", "cutoff", "n", beyond("good").alias("k"), beyond("bad").alias("bad")).crossJoin(F.broadcast(strata))  # one row
    share = alpha / len(RULES)
    bound = F.when(F.col("k") <= F.col("n") * share, _binomial_below(F.col("k"), F.col("n"), share)).otherwise(1.0)
    tests = tests.withColumn("passed", bound <= F.lit(delta) / (F.col("strata") * len(RULES)))
    each = F.struct((F.col("bad") - PRICE * F.col("k")).alias("gain"), (-F.col("place")).alias("lenient"), "cutoff", "n", "k", "bad")
    best = tests.groupBy("stratum", "rule").agg(F.min(F.when(~F.col("passed"), F.col("place"))).alias("stop"), F.collect_list(each).alias("each"))
    able = F.filter("each", lambda e: (e["gain"] > 0) & (F.col("stop").isNull() | (-e["lenient"] < F.col("stop"))))
    return best.select("stratum", "rule", F.array_max(able).alias("x")).where("x is not null").select("stratum", "rule", "x.cutoff", "x.n", "x.k", "x.bad")


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The columns ``keep`` (doc_id among them) of each document with its counts, base_failed, rejected_by and kept."""
    cols = list(dict.fromkeys([*keep, "doc_id", stratum]))
    measured = pin(measures(docs, cols))
    limits = certified(measured, labels, stratum, alpha, delta)
    limits = small(pin(limits.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))))  # one entry a rule
    rows = measured.join(limits, F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    hit = [F.when(F.expr(of) >= F.try_element_at("limits", F.lit(name)), F.lit(name)) for name, (of, _) in RULES.items()]
    by = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*hit)))
    return rows.withColumn("rejected_by", by).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("limits", "stratum")


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose document is kept, with its columns."""
    stratum, text = how.get("stratum", "lang"), how.pop("text", "text")
    keyed = docs.select("doc_id", row_hash(docs).alias("rk"), F.col(text).alias("text"), F.col(stratum).alias("stratum_of"))
    verdict = judge(keyed, labels, ["doc_id", "rk"], **{**how, "stratum": "stratum_of"}).where("kept")
    return boxed(docs).join(keys_of(verdict, "doc_id", "rk"), ["ik", "rk"], "left_semi").select("row.*")


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = judge(docs, labels, ["doc_id", "lang"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "rejected_by").alias("rejected_by"))
