"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Counts of a text give rates; each rule rejects a text whose rate is above a cutoff. Cutoffs are chosen for each stratum
from labelled texts: a cutoff is allowed when the exact binomial test says, at a level corrected for all strata and rules,
that it falsely rejects less than the rule's share of the risk. Of the allowed cutoffs the one that parts bad from good
texts best is taken, none if it parts nothing. Stricter cutoffs reject more, so the tests of one rule run in a fixed order
from the loosest cutoff on, and only strata and rules need the correction (Bonferroni).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import written

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Risk:
    """``risk``: largest share of good texts that all rules of a stratum together may reject; ``level``: chance that this
    fails anywhere; ``cutoffs``: of each rule, ascending."""

    risk: float = 0.02
    level: float = 0.05
    most_strata: int = 10_000
    cutoffs: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {
            "symbol_rate": tuple(i / 50 for i in range(1, 51)),
            "upper_rate": tuple(i / 50 for i in range(5, 50)),
            "dup_line_rate": tuple(i / 50 for i in range(1, 50)),
            "repeat_rate": tuple(i / 50 for i in range(1, 50)),
        }
    )


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, ``n_upper`` and ``n_lines`` of each whole text (null: empty) added as ``__`` columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.withColumn("__words", F.array_remove(F.split(text, SPACE), ""))
    split = split.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    split = split.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    hashes = F.col("__hashes")
    # Eight references keep the hashes a column of their own; inlined, they would be built anew for every window.
    window = lambda i: F.xxhash64(*[hashes[i + k] for k in range(WINDOW)])
    starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    split = split.withColumn("__windows", F.when(F.size(hashes) >= WINDOW, F.transform(starts, window)))
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    split = split.withColumn(
        "__sorted",
        F.when(some, F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    ordered = F.col("__sorted")
    repeated = F.filter(ordered, lambda e, j: _neighbour(ordered, e, j))
    at = F.array_sort(F.transform(repeated, lambda e: e["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("n"), i.alias("last")
        ),
        lambda acc: acc["n"],
    )
    upper = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    symbols = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[#*$%&|<>]+", ""))
    counts = {
        "__n_words": F.size("__words"),
        "__word_chars": F.char_length(F.array_join("__words", "")),
        "__n_symbols": symbols,
        "__n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "__n_repeat_words": F.when(some, covered).otherwise(0),
        "__n_upper": upper,
        "__n_lines": F.size("__lines"),
    }
    out = split.select(*docs.columns, *[c.cast("long").alias(name) for name, c in counts.items()])
    failed = (F.col("__n_words") < 20) | (100 * F.col("__n_repeat_words") > 30 * F.col("__n_words"))
    return out.withColumn("__base_failed", failed)


def _neighbour(ordered: Column, e: Column, j: Column) -> Column:
    """Whether either neighbour holds the same window; at the ends only one neighbour is there."""
    before = F.get(ordered, j - 1)["h"].eqNullSafe(e["h"])
    after = F.get(ordered, j + 1)["h"].eqNullSafe(e["h"])
    return before | after


RATES = {
    "symbol_rate": ("__n_symbols", "__n_words"),
    "upper_rate": ("__n_upper", "__word_chars"),
    "dup_line_rate": ("__n_dup_lines", "__n_lines"),
    "repeat_rate": ("__n_repeat_words", "__n_words"),
}


def rate(rule: str) -> Column:
    part, whole = (F.col(c).cast("double") for c in RATES[rule])
    return part / F.greatest(whole, F.lit(1.0))


def binomial_tail(n: Column, k: Column, share: float) -> Column:
    """P(X <= k) for X ~ Bin(n, share), summed exactly in logarithms; 1 from k >= n * share on, which no test passes."""
    odds = F.lit(share / (1 - share))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * odds)
        high, low = F.greatest(acc["sum"], term), F.least(acc["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    first = n.cast("double") * F.log(F.lit(1 - share))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(
        steps, F.struct(first.alias("term"), first.alias("sum")), add, lambda acc: F.exp(acc["sum"])
    )
    return F.when(k >= n * F.lit(share), F.lit(1.0)).otherwise(total)


def thresholds(measured: DataFrame, labels: DataFrame, control: Risk, stratum_col: str, id_col: str, label: str) -> DataFrame:
    """One row per (stratum, rule) that has an allowed and useful cutoff: stratum, rule, cutoff.

    Null strata are a stratum of their own (empty text). Ids that are null or have contradicting labels teach nothing.
    Labelled rows are combined to one row per (stratum, rule, cutoff) before anything else happens.
    """
    known = (
        labels.where(F.col(label).isin(0, 1))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label).alias("y"), F.max(label).alias("__other"))
        .where("id IS NOT NULL AND y = __other")
    )
    level = lambda rule: F.size(
        F.filter(F.array(*map(F.lit, control.cutoffs[rule])), lambda c: F.col("rates")[rule] > c)
    )
    rows = measured.where(~F.col("__base_failed")).select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
        F.struct(*[rate(r).alias(r) for r in control.cutoffs]).alias("rates"),
    )
    levels = F.array(*[F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in control.cutoffs])
    counts = (
        rows.withColumn("levels", levels)
        .join(known, "id")
        .select("stratum", "y", F.inline("levels"))
        .groupBy("stratum", "rule", "level")
        .agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    )
    counts = written(counts)
    strata = counts.select("stratum").distinct().count()
    if strata > control.most_strata:
        raise ValueError(f"{stratum_col} has {strata} values; strata are at most {control.most_strata}")
    share = control.risk / len(control.cutoffs)
    alpha = control.level / (max(1, strata) * len(control.cutoffs))
    table = F.create_map(*[x for r, c in control.cutoffs.items() for x in (F.lit(r), F.array(*map(F.lit, c)))])
    above = lambda what: F.aggregate(
        F.filter("found", lambda x: x["level"] > F.col("at")), F.lit(0).cast("long"), lambda acc, x: acc + x[what]
    )
    sums = (
        counts.groupBy("stratum", "rule")
        .agg(F.collect_list(F.struct("level", "good", "bad")).alias("found"), F.sum("good").alias("n"), F.sum("bad").alias("m"))
        .select("*", F.posexplode(table[F.col("rule")]).alias("at", "cutoff"))
        .select("stratum", "rule", "cutoff", "n", "m", above("good").alias("k"), above("bad").alias("caught"))
    )
    gain = F.col("caught") / F.greatest("m", F.lit(1)) - F.col("k") / F.greatest("n", F.lit(1))
    allowed = sums.where(binomial_tail(F.col("n"), F.col("k"), share) <= alpha).withColumn("gain", gain).where("gain > 0")
    best = allowed.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("best"))
    return best.select("stratum", "rule", F.col("best.cutoff").alias("cutoff"))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum_col: str) -> DataFrame:
    """``measured`` with ``__kept``. Cutoffs are at most one row per stratum, whose number ``thresholds`` has checked."""
    wide = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cut"))
    wide = F.broadcast(wide.withColumnRenamed("stratum", "__stratum"))
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))
    joined = measured.join(wide, stratum == F.col("__stratum"), "left")
    over = F.lit(False)
    for rule in RATES:
        over = over | F.coalesce(rate(rule) > F.col("__cut")[rule], F.lit(False))
    return joined.withColumn("__kept", ~F.col("__base_failed") & ~over).drop("__cut", "__stratum")


def quality_rules(docs: DataFrame, labels: DataFrame, control: Risk | None = None, stratum_col: str = "lang",
                  id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed and kept.

    Null and empty texts have no words and fail the base; repeated rows stay; a rate equal to its cutoff passes; without
    enough labels in a stratum no rule applies there beside the base; an empty table gives no rows.
    """
    control = control or Risk()
    slim = docs.select(id_col, text_col, F.col(stratum_col).alias("__lang"))
    measured = written(measure(slim, text_col).drop(text_col))
    cutoffs = written(thresholds(measured, labels, control, "__lang", id_col, label))
    found = judge(measured, cutoffs, "__lang")
    return found.select(
        F.col(id_col).alias("doc_id"),
        *[F.col(f"__{c}").alias(c) for c in COUNTS],
        F.col("__base_failed").alias("base_failed"),
        F.col("__kept").alias("kept"),
    )


def keep_passing(docs: DataFrame, labels: DataFrame, control: Risk | None = None, stratum_col: str = "lang",
                 id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, columns unchanged; cutoffs come from these rows' own labels.

    Null and empty texts go, repeated rows stay or go together, an empty table stays empty. The measured rows are written once: a filter on computed counts would be pushed below them and compute them again for
    each of its terms.
    """
    control = control or Risk()
    # The row travels in one struct, so that no name of a column can clash.
    whole = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(stratum_col).alias("lang")
    )
    measured = written(measure(whole, "text").drop("text"))
    slim = measured.select("id", "lang", *[c for c in measured.columns if c.startswith("__")])
    cutoffs = written(thresholds(slim.withColumnRenamed("id", id_col), labels, control, "lang", id_col, label))
    return judge(measured, cutoffs, "lang").where("__kept").select("row.*")
