"""SQL for DuckDB that a query's rows have to equal, where SQL can express the method."""

from __future__ import annotations

from concord.llm.rules import Risk

OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def quality_rules_sql(control: Risk) -> str:
    """The counts of every text, the cutoffs that the binomial bound allows, and the verdicts."""
    cutoffs = ", ".join(f"('{rule}', {c!r}::DOUBLE)" for rule, cs in control.cutoffs.items() for c in cs)
    rules = len(control.cutoffs)
    share = control.risk / rules
    return f"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
), pos AS (
  SELECT doc_id, i, list_slice(ws, i, i + 7) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), dup AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM pos) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM dup) GROUP BY doc_id
), m AS (
  SELECT doc_id, stratum, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper, len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN cov USING (doc_id)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), rates AS (
  SELECT doc_id, stratum, base_failed, unnest([
    {{'rule': 'symbol_rate', 'v': n_symbols::DOUBLE / greatest(n_words, 1)}},
    {{'rule': 'upper_rate', 'v': n_upper::DOUBLE / greatest(word_chars, 1)}},
    {{'rule': 'dup_line_rate', 'v': n_dup_lines::DOUBLE / greatest(n_lines, 1)}},
    {{'rule': 'repeat_rate', 'v': n_repeat_words::DOUBLE / greatest(n_words, 1)}}], recursive := true)
  FROM b
), known AS (
  SELECT doc_id, min(quality) AS y FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL
  GROUP BY doc_id HAVING min(quality) = max(quality)
), lab AS (
  SELECT stratum, rule, v, y FROM rates JOIN known USING (doc_id) WHERE NOT base_failed
), cuts(rule, cutoff) AS (VALUES {cutoffs}), sums AS (
  SELECT stratum, rule, cutoff, sum(y)::BIGINT AS n, sum(1 - y)::BIGINT AS m,
         coalesce(sum(y) FILTER (v > cutoff), 0)::BIGINT AS k, coalesce(sum(1 - y) FILTER (v > cutoff), 0)::BIGINT AS caught
  FROM lab JOIN cuts USING (rule) GROUP BY ALL
), allowed AS (
  SELECT *, caught / greatest(m, 1) - k / greatest(n, 1) AS gain FROM sums
  WHERE k < n * {share!r}::DOUBLE AND list_sum(list_transform(range(0, k + 1), lambda i: exp(
          lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}::DOUBLE) + (n - i) * ln(1 - {share!r}::DOUBLE)
        ))) <= {control.level!r}::DOUBLE / (SELECT count(DISTINCT stratum) * {rules} FROM lab)
), best AS (
  SELECT stratum, rule, cutoff FROM allowed WHERE gain > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cutoff DESC) = 1
), gone AS (
  SELECT DISTINCT doc_id FROM rates JOIN best USING (stratum, rule) WHERE v > cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM gone) AS kept
FROM b
"""


def phrases_sql(threshold: int = 10, longest: int = 3, limit: int = 2000, percent: int = 50) -> str:
    """All phrases of every length counted, scored by their weakest cut, and the covered ones dropped."""
    upper = "".join(map(chr, range(65, 91)))
    names = [" || ' ' || ".join(f"ws[i + {j}]" for j in range(n)) for n in range(1, longest + 1)]
    grams = " UNION ALL ".join(
        f"SELECT lang, {n} AS words, {name} AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w)"
        for n, name in enumerate(names, 1)
    )
    spans = [(n, at) for n in range(2, longest) for at in range(1, longest - n + 2)]
    inside = " UNION ALL ".join(
        f"SELECT lang, array_to_string(list_slice(string_split(phrase, ' '), {at}, {at + n - 1}), ' ') AS phrase, f "
        f"FROM c WHERE words > {n} AND words >= {at + n - 1}"
        for n, at in spans
    )
    return f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, words, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL
), c AS (
  SELECT * FROM g WHERE words >= 2 AND f >= {threshold}
), cuts AS (
  SELECT c.*, k, array_to_string(list_slice(string_split(phrase, ' '), 1, k), ' ') AS head,
         array_to_string(list_slice(string_split(phrase, ' '), k + 1, words), ' ') AS tail
  FROM c, range(1, {longest}) AS ks(k) WHERE k < words
), s AS (
  SELECT cuts.lang, cuts.phrase, cuts.f AS a, h.f AS l, t.f AS r, k,
         (1000000::HUGEINT * cuts.f * cuts.f) // (h.f::HUGEINT * t.f) AS score
  FROM cuts JOIN g h ON h.lang = cuts.lang AND h.phrase = head JOIN g t ON t.lang = cuts.lang AND t.phrase = tail
), weakest AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM ({inside}) GROUP BY ALL
), kept AS (
  SELECT weakest.* FROM weakest LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100 * longer.f < {percent} * a
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM g WHERE words = 1 GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= {limit}
"""


def clusters_sql(k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2) -> str:
    """Every round as two expressions: nearest centroids, and the floors of the means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
    SELECT rid, cluster, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM v, c{r}
  ) GROUP BY rid
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, list(floor(total / vectors) ORDER BY i) AS c FROM (
      SELECT cluster, i, sum(e) AS total, count(*) AS vectors
      FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM v JOIN a{r} USING (rid)) GROUP BY cluster, i
    ) GROUP BY cluster
  ) m USING (cluster)
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), x) - 1)::INTEGER AS cluster, x AS c
  FROM v QUALIFY cluster < {k}
), {", ".join(steps)}
SELECT vec_id, cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c, lambda e: e::BIGINT), ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (rid) JOIN c{rounds} USING (cluster)
"""


ORACLE = {
    "op6_quality_rules": quality_rules_sql(Risk()),
    "op8_exact_top_k": OP8,
    "op11_phrase_collocations": phrases_sql(),
    "op12_centroid_clustering": clusters_sql(),
}
