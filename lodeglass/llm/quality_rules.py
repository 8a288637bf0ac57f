"""Quality rules whose cutoffs come with a proof: a rule rejects at most a stated share of good documents.

Each rule rejects documents whose value lies above a cutoff. A rule's cutoffs are nested, from strict to lenient. For every stratum (language),
rule and cutoff, the labelled holdout gives n good documents that pass the base rules, and k of them rejected. The exact binomial tail
P(Bin(n, alpha) <= k) is the p-value of "this cutoff rejects more than its share". The cutoffs of a rule are tested in fixed sequence, lenient to strict, which
needs no correction among them; Bonferroni's correction holds for all strata and rules together. A stratum uses each rule's strictest certified cutoff,
and a rule without one does not act there. Strata with fewer than `MIN_GOOD` good labels, too few to prove anything, and those without labels are one stratum
together, the pooled one, with tests of its own. So with probability 1 - delta, no rule loses more than `alpha` of the good documents of any stratum (of the pooled one: of all
its documents together) that the base rules pass. Base rules are given, not chosen, and are not part of this.

All of it is column expressions: no Python runs on executors. Text never moves through a shuffle. Windows of three words compare by 64-bit hashes.

Nulls: a null text has no words (and so fails the base rules); a null stratum is the stratum of the empty name; labels with a null
id or quality are ignored; a document labelled several times counts as good if its lowest quality is 1. Empty tables give
empty results. Repeated rows are each judged, and each count if labelled. Very long texts are measured whole. Extra columns are ignored here, whatever their names (`reject_filter` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodeglass.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rules: value expression over the measures, and the cutoffs of the levels, from strict to lenient.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.02, 0.05, 0.1, 0.15, 0.2, 0.3)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.1, 0.15, 0.2, 0.25, 0.3, 0.4)),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)),
    "capitals": ("n_capitals / greatest(word_chars, 1)", (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "length": ("word_chars / greatest(n_words, 1)", (7.0, 8.0, 9.0, 10.0, 12.0, 16.0)),
}
LEVELS = 6
ALPHA, DELTA, MIN_GOOD = 0.02, 0.05, 400
MIN_WORDS = 50


def measures(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` and the counts of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    drop = lambda chars: F.length(body) - F.length(F.translate(body, chars, ""))
    first = df.select(
        *keep,
        words.alias("_words"),
        lines.alias("_lines"),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        drop(SYMBOLS).cast("long").alias("n_symbols"),
        drop("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
    )
    word = lambda i: F.get("_words", i)
    windows = F.when(
        F.size("_words") >= 3,
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.struct(F.xxhash64(word(i), word(i + 1), word(i + 2)).alias("h"), i.alias("i")))),
    )
    second = first.select(
        *keep, "word_chars", "n_symbols", "n_capitals",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    at = lambda k: F.get("_windows", k)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("_windows") - 1), lambda k: F.coalesce(at(k) == at(k - 1), F.lit(False)) | F.coalesce(at(k) == at(k + 1), F.lit(False)))
    third = second.withColumn("_starts", F.when(F.size("_windows") > 0, F.sort_array(F.transform(twice, lambda k: F.get("_windows", k)["i"]))))
    begin = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
    covered = F.aggregate("_starts", begin, lambda acc, x: F.struct(x.alias("last"), (acc["sum"] + F.least(F.lit(3), x - acc["last"])).alias("sum")), lambda acc: acc["sum"])
    return third.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_capitals",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in logarithms; 1 where k is not below n * p, which no level could certify."""
    odds, none = F.lit(p / (1 - p)), F.log(F.lit(1 - p))
    begin = F.struct((n * none).alias("term"), (n * none).alias("sum"))

    def step(acc, j):
        term = acc["term"] + F.log((n - j + 1) / j * odds)
        top = F.greatest(term, acc["sum"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(acc["sum"] - top))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(steps, begin, step, lambda acc: F.exp(acc["sum"])))


def certify(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, min_good: int = MIN_GOOD) -> DataFrame:
    """Every test: stratum (null: the pooled one), rule, level, n_good, n_rejected (of the good), n_bad, n_caught (of the bad), p_value, certified.
    `measured` should be a written table: every test is an expression over its columns.

    The only shuffles are the join of narrow measures with the labels and counts per stratum, combined before they move.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("_quality"))
    rows = measured.join(known, measured[id_col] == known["_id"]).where(~base_failed())
    good, bad = F.col("_quality") == 1, F.col("_quality") == 0
    cells = [(rule, i, F.expr(value) > grid[i]) for rule, (value, grid) in RULES.items() for i in range(LEVELS)]
    counts = [F.count_if(good).alias("n_good"), F.count_if(bad).alias("n_bad")]
    counts += [F.count_if(r & of).alias(f"{kind}_{rule}_{i}") for rule, i, r in cells for kind, of in (("k", good), ("c", bad))]
    sums = rows.groupBy(F.coalesce(F.col(stratum), F.lit("")).alias("stratum")).agg(*counts)
    names = sums.columns[1:]
    pooled = sums.groupBy(F.when(F.col("n_good") >= min_good, F.col("stratum")).alias("stratum")).agg(*[F.sum(c).alias(c) for c in names])
    tests = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("level"), F.col(f"k_{rule}_{i}").alias("n_rejected"), F.col(f"c_{rule}_{i}").alias("n_caught")) for rule, i, _ in cells])
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # as many rows as strata
    families = pooled.withColumn("_m", F.count("*").over(every) * len(RULES))
    flat = families.select("stratum", "n_good", "n_bad", "_m", F.explode(tests).alias("t")).select("stratum", "t.rule", "t.level", "n_good", "t.n_rejected", "n_bad", "t.n_caught", "_m")
    flat = flat.withColumn("p_value", _tail(F.col("n_good"), F.col("n_rejected"), alpha))
    # A stricter cutoff rejects no fewer documents and has no smaller p-value, so the sequence stops at the first that fails.
    return flat.withColumn("certified", F.col("p_value") <= F.lit(delta) / F.col("_m")).drop("_m")


def cutoffs(tests: DataFrame) -> dict[tuple[str | None, str], float | None]:
    """By stratum (None: the pooled one) and rule, the strictest certified cutoff, None without one: strata x rules numbers. Strata without an entry are in the pooled one."""
    rows = tests.groupBy("stratum", "rule").agg(F.min(F.when(F.col("certified"), F.col("level"))).alias("level")).collect()
    return {(r["stratum"], r["rule"]): None if r["level"] is None else float(RULES[r["rule"]][1][r["level"]]) for r in rows}


def verdict(cuts: dict[tuple[str | None, str], float | None], stratum: str = "lang") -> Column:
    """True where no certified rule of the row's stratum rejects."""
    ok, none = F.lit(True), F.lit(float("inf"))
    for rule, (value, _) in RULES.items():
        own = {s: c for (s, r), c in cuts.items() if r == rule}
        rest = own.pop(None, None)
        most = none if rest is None else F.lit(rest)
        if own:
            limits = F.create_map(*[x for s, c in sorted(own.items()) for x in (F.lit(s), none if c is None else F.lit(c))])
            most = F.coalesce(F.try_element_at(limits, F.coalesce(F.col(stratum), F.lit(""))), most)
        ok = ok & (F.expr(value) <= most)
    return ok


def assess(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: str = "lang") -> tuple[DataFrame, dict]:
    """(one row per document with its measures, base_failed and kept; the cutoffs). The texts are read once: the measures are
    written to the shared folder, and both the tests and the verdicts start from them."""
    found = materialize(measures(documents, text, (id_col, stratum)), "quality")
    cuts = cutoffs(certify(found, labels, id_col, stratum))
    return found.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(cuts, stratum)), cuts


def reject_filter(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """`documents` with all their columns, without those that `assess` rejects. The measures are written once beside the documents: the tests
    read their narrow columns alone, the verdicts then filter the table."""
    whole = "_document"
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias(whole), F.col(text).alias("_body"), F.col(id_col).alias("_doc"), F.col(stratum).alias("_stratum"))
    found = materialize(measures(packed, "_body", (whole, "_doc", "_stratum")), "quality")
    cuts = cutoffs(certify(found.drop(whole), labels.select(F.col(id_col).alias("_doc"), "quality"), "_doc", "_stratum"))
    return found.where(~base_failed() & verdict(cuts, "_stratum")).select(*[F.col(whole)[c].alias(c) for c in documents.columns])


def schema() -> T.StructType:
    """Of the query's result."""
    return T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")])
