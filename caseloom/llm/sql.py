"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from caseloom.llm import quotes
from caseloom.llm.weak_rules import ACCURACY, HIGH, LOW, PRIOR, RULES
from caseloom.llm.weak_rules import ROUNDS as EM_ROUNDS

WORD = r"[^\x20\x09-\x0D]+"

EXACT = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256
FROM t JOIN g USING (body)
"""

#: Round i of resharing: sources above their cap by the level so far are set to it, the rest share what is left by weight.
ROUNDS = 12


def mix(seed: int = 1, most: int = 3, cycle: int = 3) -> str:
    rounds = "".join(
        f"""
l{i + 1} AS (SELECT coalesce((sum(source_size) - coalesce(sum(CASE WHEN source_size * {most} < weight * level THEN source_size * {most} END), 0))::DOUBLE
    / nullif(sum(CASE WHEN source_size * {most} >= weight * level THEN weight END), 0), max(level)) AS level FROM w, l{i}),"""
        for i in range(ROUNDS)
    )
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {cycle} + 1 AS weight FROM s),
l0 AS (SELECT sum(source_size)::DOUBLE / sum(weight) AS level FROM w),{rounds}
t AS (SELECT source, source_size, least((source_size * {most})::DOUBLE, weight * level) AS target,
    ('0x' || substr(md5(coalesce('s' || source, 'n') || ':{seed}'), 1, 5))::BIGINT / {1 << 20}.0::DOUBLE AS shift FROM w, l{ROUNDS}),
p AS (SELECT d.*, source_size, target, shift, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, doc_id) - 1 AS place
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor((place + 1) * each + shift) - floor(place * each + shift))::BIGINT AS copies FROM p)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM c
"""




def quality() -> str:
    """Counts by unnested windows, then every round of the estimation as a step of its own."""
    votes = []
    for name, (measure, direction, good, bad) in RULES.items():
        value = measure.replace(" / ", "::DOUBLE / ")
        first, second = ("<=", ">=") if direction == "up to" else (">=", "<=")
        votes.append(
            f"CASE WHEN n_words = 0 THEN 0 WHEN {value} {first} {good} THEN 1 WHEN {value} {second} {bad} THEN -1 ELSE 0 END AS {name}"
        )
    odds = " + ".join(f"{n} * ln(a_{n} / (1 - a_{n}))" for n in RULES)
    good = f"1 / (1 + exp(-(ln(prior / (1 - prior)) + {odds})))"
    start = ", ".join(f"{ACCURACY}::DOUBLE AS a_{n}" for n in RULES)

    def accuracy(n: str) -> str:
        right = f"sum(CASE WHEN {n} = 1 THEN g WHEN {n} = -1 THEN 1 - g END * rows)"
        return f"coalesce(least({HIGH}, greatest({LOW}, {right} / sum(rows) FILTER ({n} <> 0))), {ACCURACY}) AS a_{n}"

    rounds = "".join(
        f"""
m{i + 1} AS (SELECT least({HIGH}, greatest(1 - {HIGH}, sum(g * rows) / sum(rows))) AS prior, {', '.join(map(accuracy, RULES))}
  FROM (SELECT patterns.*, {good} AS g FROM patterns, m{i})),"""
        for i in range(EM_ROUNDS)
    )
    columns = "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_exclaims, n_distinct, n_lines"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM x WHERE n > 1)
    GROUP BY doc_id),
c AS (SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
    len(body) - len(translate(body, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_replace(body, '[^\\p{{Lu}}]', '', 'g')) AS n_capitals,
    len(body) - len(translate(body, '!', '')) AS n_exclaims, len(list_distinct(w)) AS n_distinct, len(lines) AS n_lines
    FROM t LEFT JOIN r USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {', '.join(votes)} FROM c),
patterns AS (SELECT {', '.join(RULES)}, count(*) AS rows FROM v WHERE NOT base_failed GROUP BY ALL),
m0 AS (SELECT {PRIOR}::DOUBLE AS prior, {start}),{rounds}
p AS (SELECT v.*, {good} AS p FROM v, m{EM_ROUNDS})
SELECT doc_id, {columns}, base_failed, {', '.join(RULES)}, round(p, 6) AS p_good, NOT base_failed AND p >= 0.5 AS kept FROM p
"""


WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
g AS (SELECT body, max(page_id) AS keep, count(*) AS n FROM p WHERE octet_length(body) >= 1000 GROUP BY body)
SELECT page_id, octet_length(p.body)::BIGINT AS payload_bytes, sha1(p.body) AS payload_digest,
    CASE WHEN n > 1 AND keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n > 1 AND keep <> page_id THEN keep END AS refers_to
FROM p LEFT JOIN g ON p.body = g.body
"""

#: White space as the operator sees it, and a text normalised for comparison.
_BLANK = r"[\t\n\x0B\f\r ]"
_NORM = f"lower(trim(regexp_replace({{0}}, '{_BLANK}+', ' ', 'g'), ' '))"

QUOTES = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split_regex(coalesce(text, ''), '\r?\n') AS lines
    FROM conversations),
l AS (SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM m),
lv AS (SELECT rid, i, len(regexp_replace(regexp_extract(line, '{{QUOTED}}'), '[ \t]', '', 'g')) AS level,
    regexp_replace(line, '{{QUOTED}} ?', '') AS bare FROM l),
ch AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY rid ORDER BY i) THEN 1 ELSE 0 END AS new FROM lv),
bl AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY i) AS blk FROM ch),
p AS (SELECT rid, blk, level, string_agg(bare, chr(10) ORDER BY i) AS text, count(*) AS n FROM bl GROUP BY rid, blk, level),
own AS (SELECT rid, blk, regexp_replace(CASE WHEN lead(blk) OVER (PARTITION BY rid ORDER BY blk) IS NULL THEN text
    ELSE regexp_replace(text, '{{INTRODUCED}}', '', 'g') END, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS text, level FROM p),
c AS (SELECT m.*, coalesce(b.content, '') AS content, coalesce(q.n, 0) AS n_quotes FROM m
    LEFT JOIN (SELECT rid, string_agg(text, chr(10) ORDER BY blk) AS content FROM own WHERE level = 0 AND text <> '' GROUP BY rid) b USING (rid)
    LEFT JOIN (SELECT rid, count(*) AS n FROM p WHERE level > 0 GROUP BY rid) q USING (rid)),
u AS (SELECT conv_id, turn, unnest([content] || string_split_regex(content, '\n[ \t]*\n') || string_split(content, chr(10))) AS unit FROM c),
f AS (SELECT conv_id, {_NORM.format('unit')} AS norm, min(turn) AS source FROM u WHERE {_NORM.format('unit')} <> '' GROUP BY ALL),
k AS (SELECT rid, blk, level, 2 AS rank, {_NORM.format('text')} AS norm FROM p WHERE level > 0
    UNION ALL SELECT rid, blk, level, 1, {_NORM.format('paragraph')} FROM (SELECT rid, blk, level, unnest(paragraphs) AS paragraph
        FROM (SELECT *, string_split_regex(text, '\n[ \t]*\n') AS paragraphs FROM p WHERE level > 0) WHERE len(paragraphs) > 1)
    UNION ALL SELECT rid, blk, level, 0, {_NORM.format('bare')} FROM bl WHERE level > 0),
links AS (SELECT m.conv_id, m.turn, level, blk, max(struct_pack(w := rank, c := len(k.norm), s := source)).s AS source
    FROM k JOIN m USING (rid) JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.norm = k.norm
    WHERE k.norm <> '' AND source < m.turn GROUP BY ALL),
par AS (SELECT conv_id, turn, min(struct_pack(l := level, b := blk, s := source)).s AS parent FROM links GROUP BY ALL),
walk AS (SELECT conv_id, turn, parent AS root, 1 AS depth FROM par
    UNION ALL SELECT w.conv_id, w.turn, par.parent, w.depth + 1 FROM walk w
    JOIN par ON par.conv_id IS NOT DISTINCT FROM w.conv_id AND par.turn = w.root),
far AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM walk GROUP BY ALL)
SELECT c.conv_id, c.turn, c.role, par.parent AS parent_turn, coalesce(far.root, c.turn) AS thread, coalesce(far.depth, 0) AS depth,
    n_quotes, content, row_number() OVER (PARTITION BY c.conv_id
        ORDER BY coalesce(far.root, c.turn) NULLS LAST, c.turn NULLS LAST, c.role NULLS FIRST, content) - 1 AS position
FROM c LEFT JOIN par ON par.conv_id IS NOT DISTINCT FROM c.conv_id AND par.turn = c.turn
LEFT JOIN far ON far.conv_id IS NOT DISTINCT FROM c.conv_id AND far.turn = c.turn
""".replace("{QUOTED}", quotes.QUOTED).replace("{INTRODUCED}", quotes.INTRODUCED)

#: Filters row by row and order by order, without masks or counts of masks.
AUDIT = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality IS NOT DISTINCT FROM 1) AS good, bool_or(toxic IS NOT DISTINCT FROM 1) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT t.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [x.f FOR x IN [{{'f': 'A', 'b': len(w) < 200}}, {{'f': 'B', 'b': 100 * len(list_distinct(w)) < 50 * len(w)}},
        {{'f': 'C', 'b': 100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body)}},
        {{'f': 'D', 'b': regexp_matches(body, '[#$%&*|]')}},
        {{'f': 'E', 'b': coalesce(min(t.doc_id) OVER (PARTITION BY body) < t.doc_id, t.doc_id IS NULL
            AND min(t.doc_id) OVER (PARTITION BY body) IS NOT NULL)}}] IF x.b] AS fails
    FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM c a, c b, c, c d, c e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, string_split(substr(filter_order, 1, step - 1), '') AS earlier
    FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
r AS (SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT list_contains(fails, own) AND NOT list_has_any(fails, earlier)), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, earlier)), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (list_contains(fails, own) AND list_has_any(fails, earlier)), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = [own]), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, earlier)), 0)::BIGINT AS good_lost,
    coalesce(sum(x) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, earlier)), 0)::BIGINT AS toxic_lost
    FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""

#: Conversations in parts, formatted, with the links of their messages.
CHAT = f"""
WITH o AS ({QUOTES})
SELECT conv_id, CAST(position // {quotes.PART} AS BIGINT) AS part, count(*) AS n_messages,
    string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || content || '<|im_end|>', chr(10) ORDER BY position) AS formatted,
    string_agg(concat_ws('/', coalesce(CAST(turn AS VARCHAR), '-'), coalesce(CAST(parent_turn AS VARCHAR), '-'),
        coalesce(CAST(thread AS VARCHAR), '-'), depth, n_quotes), ' ' ORDER BY position) AS links
FROM o GROUP BY ALL
"""

ORACLES = {"op2_quotation_linking": CHAT, "op6_quality_rules": quality(), "op9_warc": WARC, "op4_exact_dedup": EXACT, "op10_mix": mix(), "op12_filter_audit": AUDIT}
