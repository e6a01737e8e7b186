"""URL filter: explicit rules first, then naive Bayes over host words and path tokens.

Concatenated host names are split into words by unigram Viterbi: word probabilities are counted over the visible text of
all pages, every distinct run of letters of a host meets its substrings' counts in a join, and the most probable split
wins. Multinomial naive Bayes learns from the pages that a rule decides, and judges the others. Its tokens are hashed into
a fixed number of features, so that the model has a size bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST_WORD = 20

#: The rules that the query has to apply, as (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


@dataclass(frozen=True)
class Bayes:
    """Log odds of block against allow: of each hashed feature, and before any token."""

    weights: np.ndarray
    prior: float


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path: what follows the first ``://``. Null, or no ``://``: both empty."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null without one) and its verdict; of equally long rules the first given wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


# ---- words of a host


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, count) over the visible text of all pages: lower-cased runs of letters a to z, 2 to 20 long."""
    hidden = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"
    words = F.split(F.lower(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), hidden, " ")), "[^a-z]+")
    some = pages.select(F.explode(words).alias("word")).where(F.length("word").between(2, LONGEST_WORD))
    return some.groupBy("word").count()


def best_split(run: str, starts: list[int], lengths: list[int], costs: list[float], unknown: float) -> list[str]:
    """Viterbi over the known words in ``run``: the split of least total cost. A letter outside of words costs
    ``unknown``, and such letters in a row are one word. Ties go to the longer last word."""
    n = len(run)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for start, length, cost in zip(starts, lengths, costs):
        ends[start + length].append((start, cost))
    best, back, known = [0.0] + [float("inf")] * n, [0] * (n + 1), [True] * (n + 1)
    for end in range(1, n + 1):
        best[end], back[end], known[end] = best[end - 1] + unknown, end - 1, False
        for start, cost in sorted(ends[end]):
            if best[start] + cost < best[end]:
                best[end], back[end], known[end] = best[start] + cost, start, True
    words: list[str] = []
    end, loose = n, False
    while end:
        start = back[end]
        if not known[end] and loose:
            words[-1] = run[start:end] + words[-1]
        else:
            words.append(run[start:end])
        loose, end = not known[end], start
    return words[::-1]


def segments(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) for a table of distinct ``run``s of letters."""
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
    unknown = float(np.log(max(total, 1)) + np.log(10))
    begin = F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at")
    longest = F.least(F.lit(LONGEST_WORD), F.length("run") - F.col("at") + 1)
    parts = (
        runs.where(F.length("run") > 0)
        .select("run", begin)
        .where(F.length("run") > F.col("at"))
        .select("run", "at", F.explode(F.sequence(F.lit(2), longest)).alias("n"))
        .select("run", "at", "n", F.expr("substring(run, at, n)").alias("word"))
    )
    cost = (F.lit(float(np.log(max(total, 1)))) - F.log("count")).alias("cost")
    known = parts.join(counts, "word").select("run", F.struct((F.col("at") - 1).alias("at"), "n", cost).alias("w"))
    gathered = known.groupBy("run").agg(F.sort_array(F.collect_list("w")).alias("found"))
    gathered = runs.join(gathered, "run", "left")

    @F.arrow_udf("array<string>")
    def split(run: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, ws in zip(run.to_pylist(), found.to_pylist()):
            ws = ws or []
            out.append(best_split(text, *([w[k] for w in ws] for k in ("at", "n", "cost")), unknown))
        return pa.array(out, pa.list_(pa.string()))

    return gathered.select("run", split("run", "found").alias("words"))


# ---- naive Bayes


def features(tokens: Column, prefix: str, count: int) -> Column:
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(F.concat(F.lit(prefix), t)), F.lit(count)).cast("int"))


def path_tokens(path: Column) -> Column:
    """Lower-cased runs of letters; a run of digits is one token, whatever its value."""
    return F.transform(
        F.regexp_extract_all(F.translate(path, UPPER, LOWER), F.lit(r"(\d+|[^\W\d_]+)"), 1),
        lambda t: F.when(t.rlike(r"^\d"), F.lit("0")).otherwise(t),
    )


def learn(pages: DataFrame, count: int) -> Bayes:
    """Naive Bayes with add-one smoothing from rows with ``host_features``, ``path_features`` and a rule's ``ruled``.

    Pages that share host and verdict are combined before their host's features are counted.
    """
    taught = pages.where("ruled IS NOT NULL")
    block = F.col("ruled") == "block"
    hosts = taught.groupBy("host_features", "ruled").count()
    tokens = hosts.select(F.explode("host_features").alias("f"), block.alias("block"), "count").unionByName(
        taught.select(F.explode("path_features").alias("f"), block.alias("block"), F.lit(1).cast("long").alias("count"))
    )
    found = tokens.groupBy("f").agg(
        F.sum(F.when(F.col("block"), F.col("count")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("block"), 0).otherwise(F.col("count"))).alias("good"),
    )
    table = found.toArrow()  # at most one row per feature
    bad, good = np.ones(count), np.ones(count)
    at = table.column("f").to_numpy()
    bad[at] += table.column("bad").to_numpy()
    good[at] += table.column("good").to_numpy()
    totals = {r["ruled"]: r["n"] for r in hosts.groupBy("ruled").agg(F.sum("count").alias("n")).collect()}
    prior = np.log((totals.get("block", 0) + 1) / (totals.get("allow", 0) + 1))
    return Bayes(np.log(bad / bad.sum()) - np.log(good / good.sum()), float(prior))


def odds(model: Bayes, host_features: Column, path_features: Column) -> Column:
    """Log odds of block; null or empty features leave the prior."""

    @F.arrow_udf("double")
    def of(host: pa.Array, path: pa.Array) -> pa.Array:
        total = np.full(len(host), model.prior)
        for lists in (host, path):
            lists = lists.fill_null([]) if lists.null_count else lists
            sizes = np.diff(lists.offsets.to_numpy())
            flat = model.weights[lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)]
            np.add.at(total, np.repeat(np.arange(len(sizes)), sizes), flat)
        return pa.array(total)

    return of(host_features, path_features)


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          feature_count: int = 1 << 18) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict and odds (of block, by the words).

    Null urls and urls without ``://`` have empty host and path, fit no rule and are judged by the prior; odds of 0 allow;
    without a page that a rule decides everything else is allowed; null html counts no words; repeated rows stay; other
    columns are not looked at; an empty table gives no rows.
    """
    host, path = parse(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, ruled = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), ruled.alias("ruled"))
    hosts = written(rows.select("host").distinct())
    letters = F.regexp_extract_all("host", F.lit("([a-z]+)"), 1)
    runs = written(hosts.select(F.explode(letters).alias("run")).distinct())
    counts = written(word_counts(pages, html_col))
    split = written(segments(runs, counts))
    placed = hosts.select("host", F.posexplode(letters).alias("at", "run")).join(split, "run")
    named = placed.groupBy("host").agg(F.flatten(F.sort_array(F.collect_list(F.struct("at", "words")))["words"]).alias("words"))
    named = named.select("host", "words", features(F.col("words"), "h:", feature_count).alias("host_features"))
    tokens = features(path_tokens(F.col("path")), "p:", feature_count)
    joined = written(rows.withColumn("path_features", tokens).join(written(named), "host", "left"))
    model = learn(joined.withColumn("host_features", F.coalesce("host_features", F.array().cast("array<int>"))), feature_count)
    log_odds = odds(model, F.col("host_features"), F.col("path_features"))
    word_verdict = F.when(F.col("odds") > 0, "block").otherwise("allow")
    return joined.withColumn("odds", log_odds).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", word_verdict).alias("verdict"), "odds", "words"
    )
