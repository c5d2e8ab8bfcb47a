"""DuckDB SQL of the queries that SQL can express over whole tables.

The others are held against brute force, round trips or held-out labels in
``tests/llm``: XXH64 with a seed and component labels (op4), score sums in an
order of their own (op3), stored media (op5), iterated moves under quotas (op7),
patterns with look-around (op8) and fitted models (op10, the pipeline).
"""

from __future__ import annotations

from tessera.llm.mixing import CEILING, PACKET, SHARE, WEIGHTS
from tessera.llm.urls import DAMPING, ROUNDS, RULES, THRESHOLD

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Windows are cut from strips of 256 starts, so taking a substring does not walk through a whole text.
OP1 = """WITH texts AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
    strips AS MATERIALIZED (SELECT doc_id, base, h[2 * base + 1 : 2 * (base + 305)] AS strip, least(256, n - 49 - base) AS m FROM (SELECT *, unnest(range(0, n - 49, 256)) AS base FROM texts WHERE n >= 50)),
    windows AS MATERIALIZED (SELECT doc_id, base + o AS p, strip[2 * o + 1 : 2 * o + 100] AS w FROM (SELECT *, unnest(range(m)) AS o FROM strips)),
    hits AS (SELECT doc_id, p FROM windows JOIN (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING count(DISTINCT doc_id) > 1) USING (w) WHERE doc_id > first),
    marked AS (SELECT *, CASE WHEN p <= lag(p) OVER d + 50 THEN 0 ELSE 1 END AS opens FROM hits WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
    spans AS (SELECT doc_id, min(p) AS s, max(p) + 50 AS e FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked) GROUP BY doc_id, k),
    edges AS (SELECT doc_id, s, e FROM spans UNION ALL SELECT doc_id, n, n FROM texts),
    pieces AS (SELECT doc_id, s, coalesce(lag(e) OVER d, 0) AS kept_from, e FROM edges WINDOW d AS (PARTITION BY doc_id ORDER BY s, e)),
    kept AS (SELECT doc_id, unhex(coalesce(string_agg(h[2 * kept_from + 1 : 2 * s], '' ORDER BY s, e), '')) AS kept FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id)
    SELECT t.doc_id, n AS n_bytes, coalesce(r.n_removed, 0)::BIGINT AS n_removed, coalesce(r.n_spans, 0) AS n_spans, sha256(kept) AS kept_sha256 FROM texts t JOIN kept USING (doc_id)
    LEFT JOIN (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id) r ON r.doc_id = t.doc_id"""


def _links(seeds: str, src: str, dst: str, out: str) -> str:
    """CTEs ending in ``out`` (host, score): ROUNDS steps of PageRank from ``seeds`` (host, weight)."""
    parts = [
        f"{out}_seeds AS MATERIALIZED (SELECT host, weight / (SELECT sum(weight) FROM {seeds}) AS weight FROM {seeds} WHERE weight > 0)",
        f"{out}_walks AS MATERIALIZED (SELECT {src} AS src, {dst} AS dst, count(*) OVER (PARTITION BY {src}) AS degree FROM edges)",
        f"{out}_0 AS (SELECT host, weight AS score FROM {out}_seeds)",
    ]
    for k in range(ROUNDS):
        moved = f"SELECT dst AS host, {DAMPING}::DOUBLE * sum(score / degree) AS score FROM {out}_walks JOIN {out}_{k} ON host = src GROUP BY dst"
        parts.append(f"{out}_{k + 1} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT host, weight * (1 - {DAMPING}::DOUBLE) AS score FROM {out}_seeds UNION ALL {moved}) GROUP BY host)")
    return ",\n    ".join([*parts, f"{out} AS (SELECT * FROM {out}_{ROUNDS})"])


_RULES = ", ".join(f"('{r.host}', '{r.path}', {str(r.allow).lower()})" for r in RULES)
OP2 = f"""WITH located AS MATERIALIZED (SELECT page_id, html, {_LOW.format("coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
    rules(rule_host, rule_path, allow) AS (VALUES {_RULES}),
    hits AS (SELECT page_id, arg_max({{'name': rule_host || rule_path, 'allow': allow}}, (length(rule_host || rule_path), NOT allow)) AS hit FROM located JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
    ruled AS MATERIALIZED (SELECT l.*, hit FROM located l LEFT JOIN hits USING (page_id)),
    hosts AS MATERIALIZED (SELECT host, (count(*) FILTER (hit.allow))::DOUBLE AS allowed, (count(*) FILTER (NOT hit.allow))::DOUBLE AS blocked FROM ruled GROUP BY host),
    out_links AS (SELECT host AS src, {_LOW.format('h')} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?https?://([^/?#"''\\s>]*)', 1)) AS h FROM located WHERE host <> '')),
    labelled AS (SELECT string_split(host, '.') AS l FROM hosts WHERE NOT regexp_matches(host, '^[0-9.]+$')),
    up AS (SELECT DISTINCT array_to_string(l[i:], '.') AS src, array_to_string(l[i + 1:], '.') AS dst FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM labelled WHERE len(l) > 2)),
    edges AS MATERIALIZED (SELECT src, dst FROM out_links WHERE src <> dst AND dst <> '' UNION SELECT src, dst FROM up UNION SELECT dst, src FROM up),
    good AS (SELECT host, allowed AS weight FROM hosts), bad AS (SELECT host, blocked AS weight FROM hosts),
    {_links('good', 'src', 'dst', 'trusted')},
    {_links('bad', 'dst', 'src', 'distrusted')},
    scores AS (SELECT host, coalesce(t.score, 0) AS trust, coalesce(d.score, 0) AS distrust FROM hosts LEFT JOIN trusted t USING (host) LEFT JOIN distrusted d USING (host))
    SELECT page_id, host, path, hit.name AS rule, CASE WHEN coalesce(NOT hit.allow, distrust > 0 AND distrust >= {THRESHOLD}::DOUBLE * (trust + distrust)) THEN 'block' ELSE 'allow' END AS verdict, round(trust, 9) AS trust, round(distrust, 9) AS distrust FROM ruled JOIN scores USING (host)"""

OP6 = rf"""WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, CAST('0x' || substr(md5(doc_id || '|0|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS drawn FROM documents),
    per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes GROUP BY source),
    weighed AS (SELECT *, [{', '.join(f'{w}::DOUBLE' for w in WEIGHTS)}][(rank - 1) % {len(WEIGHTS)} + 1] AS weight, {CEILING}::DOUBLE * source_size AS cap FROM per),
    levels AS (SELECT *, cap / weight AS ratio, ({SHARE}::DOUBLE * (SELECT sum(source_size) FROM per) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
    target AS (SELECT source, rank, source_size, CASE WHEN ratio < coalesce(f.level, 'inf'::DOUBLE) THEN cap ELSE f.level * weight END AS target FROM levels, (SELECT arg_min(level, (ratio, rank)) AS level FROM levels WHERE ratio >= level) f),
    queued AS (SELECT doc_id, size, rank, drawn, source_size, target, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY drawn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sizes JOIN target ON sizes.source IS NOT DISTINCT FROM target.source),
    laps AS (SELECT *, before + lap * source_size AS start FROM (SELECT *, unnest([0, 1]) AS lap FROM queued WHERE size > 0)),
    packets AS (SELECT *, start + packet * {PACKET} AS opens, least({PACKET}, size - packet * {PACKET}) AS words FROM (SELECT *, unnest(range((size - 1) // {PACKET} + 1)) AS packet FROM laps WHERE start < target)),
    finished AS (SELECT *, (opens + words) / target AS finish FROM packets WHERE opens < target),
    spent AS (SELECT *, coalesce(sum(words) OVER (ORDER BY finish, rank, lap, drawn, packet, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM finished),
    got AS (SELECT doc_id, sum(least(words, budget - spent))::BIGINT AS taken, max(finish) AS finish FROM spent, (SELECT trunc({SHARE}::DOUBLE * sum(source_size))::BIGINT AS budget FROM per) WHERE spent < budget GROUP BY doc_id)
    SELECT q.doc_id, size, source_size, target, coalesce(taken, 0) AS taken, finish FROM queued q LEFT JOIN got USING (doc_id)"""

OP9 = r"""WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
    windows AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0)),
    starts AS (SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM low, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
    found AS (SELECT doc_id, p, size, item FROM starts JOIN windows USING (size, win)),
    hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS q FROM found) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

ORACLES: dict[str, str] = {"op1_suffix_dedup": OP1, "op2_url_filter": OP2, "op6_fair_mix": OP6, "op9_decontaminate": OP9}
