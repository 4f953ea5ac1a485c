"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from strata.llm import embeddings, mixing, quality_rules, secrets

SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def quality_rules_sql() -> str:
    low, high = quality_rules.STRENGTH
    rules = quality_rules.RULES
    counts = ", ".join(f"count(*) FILTER (fails_{r}) AS bad_{r}" for r in rules)
    means = ", ".join(f"greatest(least(avg(bad_{r} / n), 1 - 1e-6), 1e-6) AS m_{r}, var_pop(bad_{r} / n) AS v_{r}" for r in rules)
    strengths = ", ".join(f"m_{r}, greatest(least(CASE WHEN v_{r} > 0 THEN m_{r} * (1 - m_{r}) / v_{r} - 1 ELSE {high} END, {high}), {low}) AS k_{r}" for r in rules)
    limit = "least({1}, m_{0} + {2} * sqrt(m_{0} * (1 - m_{0}) / (k_{0} + 1)))"
    hosts = ", ".join(
        f"(bad_{r} + m_{r} * k_{r}) / (n + m_{r} * k_{r} + (1 - m_{r}) * k_{r}) > {limit.format(r, quality_rules.CONDEMN, quality_rules.SPREAD)} AS host_{r}" for r in rules
    )
    broken = " OR ".join(f"(host_{r} AND fails_{r})" for r in rules)
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, source, t, list_filter(string_split_regex(t, '{SPACE}+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM l WHERE len(ws) > 2),
c AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, ws[p], ws[p + 1], ws[p + 2]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM c WHERE n > 1) GROUP BY doc_id),
m AS (SELECT l.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{SPACE}+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM l LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 AS fails_short, 100 * n_repeat_words > 50 * n_words AS fails_repetitive, 10 * n_symbols > n_words AS fails_symbols, 10 * n_dup_lines > 3 * n_lines AS fails_dup_lines,
  word_chars < 2 * n_words OR word_chars > 15 * n_words AS fails_word_length FROM m),
h AS (SELECT source AS host, count(*)::DOUBLE AS n, {counts} FROM f GROUP BY source),
p AS (SELECT {means} FROM h), k AS (SELECT {strengths} FROM p),
v AS (SELECT host, {hosts} FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails_short OR fails_repetitive AS base_failed, NOT (fails_short OR fails_repetitive) AND NOT ({broken}) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.host"""


def warc_sql() -> str:
    group = "('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))"
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
l AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, octet_length(b) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ({group} & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN l USING (h)"""


def secrets_sql() -> str:
    parts = []
    for i, r in enumerate(secrets.RULES):
        # runs of one class are the same matches with the least length in the pattern, which makes fewer of them
        pattern = (r.pattern.removesuffix("+") + f"{{{r.least},}}" if r.kind == "hex" else r.pattern).replace("'", "''")
        parts.append(f"""SELECT doc_id, {i} AS n, '{r.kind}' AS kind, k, gaps, ms, parts FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS ms,
  regexp_extract_all(t, '{pattern}', {r.group}) AS parts FROM d), unnest(range(1, len(ms) + 1)) u(k) WHERE length(parts[k]) >= {r.least}""")
    counts = ", ".join(f"count(*) FILTER (n = {i}) AS n_{secrets.RULES[i].kind}" for i in range(secrets.BASE))
    length = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(parts)}),
s AS (SELECT doc_id, n, kind, CAST({length.format("gaps[1:k]")} + {length.format("ms[1:k - 1]")} AS BIGINT) AS start, CAST(length(ms[k]) AS BIGINT) AS size FROM a),
j AS (SELECT doc_id, {counts}, string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, n) FILTER (n < {secrets.BASE}) AS base, string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, n) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (doc_id)"""


def embeddings_sql() -> str:
    dot = lambda a, b: f"list_dot_product({a}, {b})"
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
u AS (SELECT * FROM v WHERE {dot("x", "x")} > 0),
e AS (SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  AND {dot("a.x", "b.x")} / (sqrt({dot("a.x", "a.x")}) * sqrt({dot("b.x", "b.x")})) >= {embeddings.THRESHOLD}),
r(i, j) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.j),
c AS (SELECT i, min(j) AS component_id FROM r GROUP BY i)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.i = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.i = vec_id"""


def mixing_sql() -> str:
    most, share = mixing.MOST, mixing.SHARE
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, ([{weights}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}]::DOUBLE AS weight FROM s),
b AS (SELECT *, {most} * source_size / weight AS bound FROM w),
o AS (SELECT *, CAST(sum({most} * source_size) OVER (ORDER BY bound, source NULLS LAST ROWS UNBOUNDED PRECEDING) - {most} * source_size AS DOUBLE) AS cap_before,
  sum(weight) OVER () - sum(weight) OVER (ORDER BY bound, source NULLS LAST ROWS UNBOUNDED PRECEDING) + weight AS open, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM b),
l AS (SELECT *, ({share} * total - cap_before) / open AS level FROM o),
x AS (SELECT coalesce((SELECT level FROM l WHERE level < bound ORDER BY bound, source NULLS LAST LIMIT 1), (SELECT max(bound) FROM l)) AS level),
t AS (SELECT source, source_size, least(CAST({most} * source_size AS DOUBLE), x.level * weight) AS target FROM o, x),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
c AS (SELECT doc_id, size, source_size, target, rate, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c"""
