"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import links

CHAT = """WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(9 + length(replace(replace(role, '<', '<.'), ']', '<|')) + length(replace(text, '<', '<.')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""

# words in windows of 5 and of 10 that occur twice; a repeat of over 50 words is a window of 51 that occurs twice
QUALITY = """WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM docs),
grams AS (SELECT doc_id, i, n, md5(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS g5,
md5(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) AS g10,
md5(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING)) AS g51 FROM words),
twice AS (SELECT doc_id, i, i + 4 <= n AND count(*) OVER (PARTITION BY doc_id, i + 4 <= n, g5) > 1 AS d5,
i + 9 <= n AND count(*) OVER (PARTITION BY doc_id, i + 9 <= n, g10) > 1 AS d10, i + 50 <= n AND count(*) OVER (PARTITION BY doc_id, i + 50 <= n, g51) > 1 AS d51 FROM grams),
held AS (SELECT doc_id, d51, max(d5::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c5,
max(d10::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10 FROM twice),
counted AS (SELECT doc_id, sum(c5)::BIGINT AS n_repeat_words, sum(c10)::BIGINT AS covered_words, bool_or(d51) AS long FROM held GROUP BY 1),
lines AS (SELECT doc_id, (count(*) - count(DISTINCT l))::BIGINT AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
joined AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(w) FOR w IN ws]), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(covered_words, 0) AS covered_words, coalesce(long, false) AS long FROM docs LEFT JOIN counted USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND covered_words <= 0.2::DOUBLE * n_words AND NOT long AS kept FROM joined"""


NEGATIVES = """WITH rows_ AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT coalesce(list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding]), false)),
pairs AS MATERIALIZED (SELECT a.vec_id AS anchor, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor, id, score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score QUALIFY rank <= 10"""


def url_filter(rules: dict[str, str], threshold: float = 0.5, keep: float = 0.85, tolerance: float = 1e-3) -> str:
    """The same fixed-point rounds, one common table expression each, as many as the tolerance may need."""
    iterations = links.rounds(keep, tolerance)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    fits = lambda r: f"(host = {quote(r.partition('/')[0])} OR ends_with(host, {quote('.' + r.partition('/')[0])})) AND starts_with(path, {quote('/' + r.partition('/')[2])})"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN {quote(r)}" for r in sorted(rules, key=lambda r: (-len(r), r))) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN {quote(r)} THEN {quote(v)}" for r, v in rules.items()) + " END"
    out = f"""WITH parsed AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), {quote(links.URL)}, 1), '{links.UPPER}', '{links.LOWER}') AS host, regexp_extract(coalesce(url, ''), {quote(links.URL)}, 2) AS path FROM pages),
ruled AS (SELECT page_id, host, path, {rule} AS rule FROM parsed), judged AS (SELECT *, {verdict} AS by_rule FROM ruled),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS links FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, {quote(links.LINK)}, 1)), '{links.UPPER}', '{links.LOWER}') AS dst FROM parsed) WHERE src <> dst AND src <> '' GROUP BY 1, 2),
hosts AS (SELECT host, floor({links.UNIT} * (count_if(by_rule = 'allow') / count(*)::DOUBLE))::BIGINT AS trust, floor({links.UNIT} * (count_if(by_rule = 'block') / count(*)::DOUBLE))::BIGINT AS distrust FROM judged WHERE host <> '' GROUP BY 1),
nodes AS (SELECT host FROM hosts UNION SELECT src FROM edges UNION SELECT dst FROM edges),
s0 AS MATERIALIZED (SELECT host, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust, coalesce(n, 0) AS n_out, coalesce(trust, 0) AS t, coalesce(distrust, 0) AS d
FROM nodes LEFT JOIN hosts USING (host) LEFT JOIN (SELECT src AS host, sum(links) AS n FROM edges GROUP BY 1) USING (host)),
shares AS MATERIALIZED (SELECT src, dst, links / n_out::DOUBLE AS share FROM edges JOIN s0 ON src = host)"""
    for k in range(iterations):
        out += f""", got{k} AS (SELECT host, sum(a) AS a, sum(b) AS b FROM (SELECT dst AS host, floor(t * share)::BIGINT AS a, 0 AS b FROM shares JOIN s{k} ON host = src UNION ALL SELECT src, 0, floor(d * share)::BIGINT FROM shares JOIN s{k} ON host = dst) GROUP BY 1),
s{k + 1} AS MATERIALIZED (SELECT host, trust, distrust, n_out, round({1 - keep!r}::DOUBLE * trust + {keep}::DOUBLE * CASE WHEN n_out > 0 THEN coalesce(a, 0) ELSE coalesce(a, 0) + t END)::BIGINT AS t,
greatest(distrust, round({keep}::DOUBLE * coalesce(b, 0))::BIGINT) AS d FROM s{k} LEFT JOIN got{k} USING (host))"""
    return out + f"""
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN d >= {int(threshold * links.UNIT)} AND d > t THEN 'block' ELSE 'allow' END) AS verdict FROM judged LEFT JOIN s{iterations} USING (host)"""
