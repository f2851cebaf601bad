"""The same queries as plain SQL, for checking results with another engine."""

from __future__ import annotations

from caseloom.functions.codes import CHAPTERS
from caseloom.functions.numbers import SCORE_GROUPS, count_groups
from caseloom.operators.comorbidity import CONDITIONS, SEVERE_OVER_MILD, WEIGHTS, rule_rows

TOKEN_SQL = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"

ADMISSIONS = """admissions AS (
  SELECT o_orderkey AS n, o_custkey AS patient_id, o_orderdate AS admit,
         CASE o_orderstatus WHEN 'O' THEN '1' WHEN 'F' THEN '3' ELSE '7' END AS disposition,
         o_custkey % 73 + 18 AS age, o_orderkey % 14 + 1 AS los
  FROM orders)"""

ENCOUNTERS = (
    ADMISSIONS
    + """, encounters AS (
  SELECT *, CASE WHEN lead(admit) OVER (PARTITION BY patient_id ORDER BY admit, n) <= admit + INTERVAL 30 DAY
                 THEN 1 ELSE 0 END AS label
  FROM admissions)"""
)

CODES = """base_lines AS (
  SELECT *, chr(CAST(65 + l_partkey % 26 AS INTEGER))
            || lpad(CAST((l_partkey * 37 + l_suppkey) % 100 AS VARCHAR), 2, '0')
            || CAST(CAST(l_quantity AS INTEGER) % 10 AS VARCHAR) AS base
  FROM lineitem),
codes AS (
  SELECT l_orderkey AS n, l_linenumber AS line,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS pos,
         CASE WHEN l_discount = 0.1 THEN NULL WHEN l_tax = 0.0 THEN substr(base, 1, 2)
              WHEN l_linestatus = 'O' THEN lower(base) ELSE base END AS dx,
         CAST(l_partkey AS VARCHAR) AS cpt
  FROM base_lines)"""

DICTIONARY = """dictionary AS (
  SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS description FROM part WHERE p_partkey % 10 <> 0)"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


RULES = f"rules(prefix, condition) AS (VALUES {_values(rule_rows())})"
_FLAGS = ", ".join(f"coalesce(bool_or(condition = '{c}'), false) AS {c}" for c in CONDITIONS)


FLAGS = f"""flags AS (
  SELECT n, {_FLAGS}
  FROM codes LEFT JOIN rules ON starts_with(upper(trim(dx)), prefix)
  GROUP BY n)"""
_SUM = " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w in WEIGHTS.items())
_LESS = " ".join(f"- CASE WHEN {a} AND {b} THEN {WEIGHTS[b]} ELSE 0 END" for a, b in SEVERE_OVER_MILD)


def _scores() -> str:
    return f"{CODES}, {RULES}, {FLAGS}, scores AS (SELECT n, {_SUM} {_LESS} AS score FROM flags)"


SCORES = _scores()
SCORED = f"""{ENCOUNTERS}, {SCORES}, scored AS (
  SELECT e.*, coalesce(s.score, 0) AS score FROM encounters e LEFT JOIN scores s USING (n))"""


def _chapter(code: str) -> str:
    prefix = f"upper(substr(trim({code}), 1, 3))"
    cases = " ".join(f"WHEN {prefix} BETWEEN '{lo}' AND '{hi}' THEN '{name}'" for lo, hi, name in CHAPTERS)
    return (
        f"CASE WHEN {code} IS NULL OR {code} = '' THEN NULL WHEN length({prefix}) < 3 THEN 'Incomplete Code' "
        f"{cases} ELSE 'Unclassified Code' END"
    )


def _distribution(with_sql: str, source: str, bucket: str, order) -> str:
    return f"""WITH {with_sql}, categories(category, ord) AS (VALUES {_values((c, i + 1) for i, c in enumerate(order))}),
counted AS (SELECT {bucket} AS category, count(*) AS encounters FROM {source} GROUP BY 1),
shared AS (SELECT *, 100.0::DOUBLE * encounters / CAST(sum(encounters) OVER () AS DOUBLE) AS pct FROM counted)
SELECT category, encounters, pct, ord FROM shared JOIN categories USING (category)"""


def _count_bucket(value: str, noun: str) -> str:
    few, many, unknown = count_groups(noun)
    return (
        f"CASE WHEN {value} IS NULL OR {value} < 0 THEN '{unknown}' WHEN {value} <= 5 THEN '{few}' ELSE '{many}' END"
    )


def _count_dist(code: str, noun: str) -> str:
    counted = f"""{ADMISSIONS}, {CODES}, line_counts AS (SELECT n, count({code}) AS k FROM codes GROUP BY n),
recorded AS (SELECT a.n, c.k FROM admissions a LEFT JOIN line_counts c USING (n))"""
    return _distribution(counted, "recorded", _count_bucket("k", noun), count_groups(noun))


_VALID = "count(*) FILTER (WHERE {0} IS NOT NULL AND trim({0}) NOT IN ('', 'nan', 'missing'))"

NARRATIVES = f"""{SCORED}, {DICTIONARY},
titled AS (SELECT n, pos, dx, {_chapter('dx')} AS title, description
           FROM codes LEFT JOIN dictionary ON trim(cpt) = code WHERE pos <= 5),
firsts AS (
  SELECT n, 'This patient was admitted to the hospital' || CASE
      WHEN dx IS NULL OR trim(dx) = '' THEN ''
      WHEN title NOT IN ('Unclassified Code', 'Incomplete Code') THEN ' primarily for ' || title
      ELSE ' with primary diagnosis code ' || dx END || '.' AS text
  FROM titled WHERE pos = 1),
also_items AS (
  SELECT n, title, min(pos) AS place FROM titled
  WHERE pos > 1 AND title NOT IN ('Unclassified Code', 'Incomplete Code') GROUP BY n, title),
also AS (SELECT n, 'Co-occurring conditions included ' || string_agg(title, ', ' ORDER BY place) || '.' AS text
         FROM also_items GROUP BY n),
done_items AS (SELECT n, description, min(pos) AS place FROM titled WHERE description IS NOT NULL GROUP BY n, description),
done AS (SELECT n, 'Key procedures performed included ' || string_agg(description, ', ' ORDER BY place) || '.' AS text
         FROM done_items GROUP BY n),
narratives AS (
  SELECT e.n, e.label, concat_ws(' ', coalesce(firsts.text, 'This patient was admitted to the hospital.'), also.text,
    'The calculated Charlson Comorbidity Index score for this encounter was ' || CAST(e.score AS VARCHAR) || '.',
    done.text) AS prompt
  FROM scored e LEFT JOIN firsts ON e.n = firsts.n LEFT JOIN also ON e.n = also.n LEFT JOIN done ON e.n = done.n)"""

COHORT = {
    "encounter_compare": f"""WITH {SCORED}, counts AS (
  SELECT n, {_VALID.format('dx')} AS dx_codes, {_VALID.format('cpt')} AS cpt_codes FROM codes GROUP BY n)
SELECT CASE label WHEN 0 THEN 'Not Readmitted' ELSE 'Readmitted' END AS status, count(*) AS encounters,
       avg(age) AS mean_age, avg(los) AS mean_los, avg(score) AS mean_score,
       avg(coalesce(dx_codes, 0)) AS mean_dx, avg(coalesce(cpt_codes, 0)) AS mean_cpt
FROM scored LEFT JOIN counts USING (n) GROUP BY label""",
    "readmit_ratio": f"""WITH {ENCOUNTERS}, counted AS (SELECT label, count(*) AS encounters FROM encounters GROUP BY label),
shared AS (SELECT *, 100.0::DOUBLE * encounters / CAST(sum(encounters) OVER () AS DOUBLE) AS pct FROM counted)
SELECT CASE label WHEN 0 THEN 'Not Readmitted' ELSE 'Readmitted' END AS status, encounters, pct,
       printf('%.1f%%', pct) AS share_text FROM shared""",
    "diagnosis_count_dist": _count_dist("dx", "Diagnoses"),
    "procedure_count_dist": _count_dist("cpt", "Procedures"),
    "score_dist": _distribution(
        SCORED,
        "scored",
        "CASE WHEN score IS NULL OR score < 0 THEN 'Unknown Score' WHEN score = 0 THEN '0 (No Comorbidities)' "
        "WHEN score <= 4 THEN CAST(score AS VARCHAR) WHEN score <= 6 THEN '5-6' WHEN score <= 9 THEN '7-9' "
        "ELSE '10+ (Very High Risk)' END",
        SCORE_GROUPS,
    ),
    "lenient_cast_bucket": _distribution(
        """written AS (
  SELECT TRY_CAST(CASE event_type WHEN 'error' THEN 'n/a' WHEN 'view' THEN json_extract_string(props, '$.k') || '.5'
    WHEN 'click' THEN ' ' || json_extract_string(props, '$.k') || ' '
    WHEN 'purchase' THEN '-' || json_extract_string(props, '$.k') END AS DOUBLE) AS v FROM events)""",
        "written",
        _count_bucket("v", "Diagnoses"),
        count_groups("Diagnoses"),
    ),
    "cohort_exclude": f"""WITH {ADMISSIONS},
kept AS (SELECT disposition, count(*) AS encounters FROM admissions WHERE disposition <> '7' GROUP BY disposition)
SELECT disposition, encounters, n_name AS description
FROM kept LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = disposition""",
    "valid_code_count": f"""WITH {ADMISSIONS}, {CODES}, counts AS (
  SELECT n, {_VALID.format('dx')} AS dx_codes, {_VALID.format('cpt')} AS cpt_codes FROM codes GROUP BY n)
SELECT n, coalesce(dx_codes, 0) AS dx_codes, coalesce(cpt_codes, 0) AS cpt_codes
FROM admissions LEFT JOIN counts USING (n)""",
    "clean_codes": """WITH raw AS (
  SELECT *, CASE WHEN l_discount = 0.1 THEN 'nan' WHEN l_tax = 0.0 THEN '   ' ELSE ' ' || l_partkey || ' ' END AS r
  FROM lineitem), cleaned AS (SELECT *, nullif(nullif(trim(r), ''), 'nan') AS code FROM raw)
SELECT CAST(l_orderkey AS VARCHAR) AS n, l_linenumber AS line, code, coalesce(code, 'missing') AS code_or_missing,
       'missing' AS second_code, CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS INTEGER) ELSE 0 END AS amount
FROM cleaned""",
    "dictionary_dedupe": """WITH ranked AS (
  SELECT CAST(p_partkey % 700 AS VARCHAR) AS code, p_name AS description,
         row_number() OVER (PARTITION BY p_partkey % 700 ORDER BY p_partkey DESC) AS r FROM part)
SELECT code, description FROM ranked WHERE r = 1""",
    "procedure_lookup": f"""WITH {CODES}, {DICTIONARY}
SELECT n, line, cpt, description FROM codes LEFT JOIN dictionary ON trim(cpt) = code""",
    "chapter_lookup": f"WITH {CODES} SELECT n, line, dx, {_chapter('dx')} AS title FROM codes",
    "comorbidity_flags": f"""WITH {ADMISSIONS}, {CODES}, {RULES}, {FLAGS}
SELECT n, {', '.join(f'coalesce({c}, false) AS {c}' for c in CONDITIONS)} FROM admissions LEFT JOIN flags USING (n)""",
    "comorbidity_score": f"""WITH {ADMISSIONS}, {SCORES}
SELECT n, coalesce(score, 0) AS score FROM admissions LEFT JOIN scores USING (n)""",
    "narrative": f"WITH {NARRATIVES} SELECT n, prompt, label FROM narratives",
    "ordinal_suffix": """SELECT o_orderkey AS n, o_orderkey || CASE
  WHEN o_orderkey % 100 BETWEEN 10 AND 20 THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st'
  WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal FROM orders""",
    "feature_tier": f"""WITH {ADMISSIONS}, {SCORES}, wide AS (
  SELECT n, {', '.join(f"max(CASE WHEN pos = {i} THEN {c} END) AS {c}{i}" for c in ('dx', 'cpt') for i in range(1, 6))}
  FROM codes GROUP BY n)
SELECT a.n, coalesce(score, 0) AS score, {', '.join(f'{c}{i}' for c in ('dx', 'cpt') for i in range(1, 6))}
FROM admissions a LEFT JOIN scores s ON a.n = s.n LEFT JOIN wide w ON a.n = w.n""",
    "feature_tier_rich": f"""WITH {ADMISSIONS}, {SCORES}, wide AS (
  SELECT n, count(*) FILTER (WHERE pos <= 34 AND dx IS NOT NULL AND trim(dx) NOT IN ('', 'nan', 'missing')) AS dx_codes,
         {_VALID.format('cpt')} AS cpt_codes,
         string_agg(coalesce(dx, '-'), '|' ORDER BY pos) FILTER (WHERE pos <= 34) AS dx, string_agg(cpt, '|' ORDER BY pos) AS cpt
  FROM codes WHERE pos <= 100 GROUP BY n)
SELECT n, coalesce(dx_codes, 0) AS dx_codes, coalesce(cpt_codes, 0) AS cpt_codes, coalesce(score, 0) AS score,
  coalesce(dx, '') AS dx, coalesce(cpt, '') AS cpt
FROM admissions LEFT JOIN scores USING (n) LEFT JOIN wide USING (n)""",
    "codes_long": f"""WITH {CODES}
SELECT n, 'dx' AS kind, pos, dx AS code FROM codes WHERE pos <= 34 AND dx IS NOT NULL
UNION ALL SELECT n, 'cpt', pos, cpt FROM codes WHERE pos <= 100""",
    "narrative_lengths": f"""WITH {NARRATIVES}, lengths AS (
  SELECT len(regexp_extract_all(lower(prompt), '{TOKEN_SQL}')) AS length FROM narratives)
SELECT count(*) AS count, avg(length) AS mean, round(stddev_samp(length), 6) AS std, min(length) AS min,
  max(length) AS max, quantile_cont(length, 0.25) AS q25, quantile_cont(length, 0.5) AS q50,
  quantile_cont(length, 0.75) AS q75 FROM lengths""",
}

WORDS = f"words AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN_SQL}') AS w FROM documents)"
VOCAB = f"""{WORDS}, vocab_counts AS (
  SELECT token, count(*) AS occurrences FROM (SELECT unnest(w) AS token FROM words) GROUP BY token),
vocab AS (SELECT token, occurrences, row_number() OVER (ORDER BY occurrences DESC, token) + 3 AS token_id
          FROM vocab_counts)"""
IDS = f"""{VOCAB}, placed AS (
  SELECT doc_id, unnest(w[1:510]) AS token, generate_subscripts(w[1:510], 1) AS pos FROM words),
id_texts AS (
  SELECT doc_id, count(*) AS k, string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY pos) AS t
  FROM placed LEFT JOIN vocab USING (token) GROUP BY doc_id),
ids AS (SELECT doc_id, coalesce(k, 0) + 2 AS size, CASE WHEN k IS NULL THEN '2,3' ELSE '2,' || t || ',3' END AS ids
        FROM words LEFT JOIN id_texts USING (doc_id))"""
LENGTHS = f"{WORDS}, lengths AS (SELECT len(w) AS length FROM words)"

_ORDER = "md5({0} || ':42')"
SPLIT = f"""ordered AS (
  SELECT n, label, row_number() OVER (PARTITION BY label ORDER BY {_ORDER.format('n')}, n) AS r,
         count(*) OVER (PARTITION BY label) AS size FROM encounters),
parts AS (SELECT n, label, CASE WHEN r <= ceil(0.2 * size) THEN 'test' ELSE 'train' END AS part FROM ordered)"""
PLAIN_SPLIT = f"""plain_parts AS (
  SELECT n, CASE WHEN row_number() OVER (ORDER BY {_ORDER.format('n')}, n) <= ceil(0.2 * count(*) OVER ())
                 THEN 'test' ELSE 'train' END AS part FROM admissions)"""
DRAWS = """draws AS (SELECT d AS draw, CAST('0x' || substr(md5(d || ':draw:42'), 1, 15) AS BIGINT)
                     % (SELECT count(*) FROM pool) AS place FROM range(5000) t(d)),
drawn AS (SELECT n, draw FROM draws JOIN
  (SELECT n, row_number() OVER (ORDER BY md5(n || ':42'), n) - 1 AS place FROM pool) USING (place))"""
#: Every cell of the 34 + 100 code columns; empty ones are the level "missing".
FILLED = f"""{CODES}, filled AS (
  SELECT n, 'dx' || lpad(CAST(pos AS VARCHAR), 3, '0') AS col, dx AS code FROM codes WHERE pos <= 34 AND dx IS NOT NULL
  UNION ALL SELECT n, 'cpt' || lpad(CAST(pos AS VARCHAR), 3, '0'), cpt FROM codes WHERE pos <= 100)"""
CELLS = f"""{FILLED}, cols AS (
  SELECT 'dx' || lpad(CAST(range AS VARCHAR), 3, '0') AS col FROM range(1, 35)
  UNION ALL SELECT 'cpt' || lpad(CAST(range AS VARCHAR), 3, '0') FROM range(1, 101)),
cells AS (SELECT a.n, c.col, coalesce(f.code, 'missing') AS code
          FROM admissions a CROSS JOIN cols c LEFT JOIN filled f ON f.n = a.n AND f.col = c.col)"""
FOLDS = f"""folds AS (
  SELECT n, label, (row_number() OVER (PARTITION BY label ORDER BY {_ORDER.format('n')}, n) - 1) % 3 AS fold
  FROM encounters)"""
SCORED_DOCUMENTS = """scored AS (
  SELECT doc_id, quality AS label, n_chars, (n_chars % 1000) / 1000.0::DOUBLE AS score,
         CASE WHEN (n_chars % 1000) / 1000.0::DOUBLE > 0.5 THEN 1 ELSE 0 END AS predicted
  FROM labels JOIN documents USING (doc_id))"""


def _cells(source: str) -> str:
    return f"""cells AS (SELECT count(*) FILTER (label = 1 AND predicted = 1) AS tp,
  count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
  count(*) FILTER (label = 0 AND predicted = 0) AS tn FROM {source})"""


def _ratio(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0::DOUBLE ELSE CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) END"


METRICS = {
    "accuracy": _ratio("tp + tn", "(tp + fn + fp + tn)"),
    "precision": _ratio("tp", "(tp + fp)"),
    "recall": _ratio("tp", "(tp + fn)"),
    "f1": _ratio("2 * tp", "(2 * tp + fp + fn)"),
}


def _ranks(source: str) -> str:
    return f"""tied AS (SELECT score, CAST(sum(label) AS BIGINT) AS p, CAST(sum(1 - label) AS BIGINT) AS q
                        FROM {source} GROUP BY score),
ranked AS (SELECT score, p, q, CAST(sum(p) OVER w AS BIGINT) - p AS p_before, CAST(sum(q) OVER w AS BIGINT) - q AS q_before,
  CAST(sum(p) OVER () AS BIGINT) AS p_all, CAST(sum(q) OVER () AS BIGINT) AS q_all FROM tied WINDOW w AS (ORDER BY score))"""


AUC = "sum(p * (q_before + q / 2.0::DOUBLE)) / (CAST(max(p_all) AS DOUBLE) * CAST(max(q_all) AS DOUBLE))"


def _sizes(section: str, source: str) -> str:
    return f"""SELECT '{section}' AS section, 'rows' AS key, CAST(count(*) AS DOUBLE) AS value FROM {source}
UNION ALL SELECT '{section}', 'class_' || c, CAST(count(*) FILTER (label = c) AS DOUBLE)
FROM {source}, (VALUES (0), (1)) v(c) GROUP BY c"""


TRAINING = {
    "vocab": f"WITH {VOCAB} SELECT token, occurrences, token_id FROM vocab",
    "encode_pad": f"WITH {IDS} SELECT doc_id, 512 AS size, ids || repeat(',0', CAST(512 - size AS INTEGER)) AS ids FROM ids",
    "attention_mask": f"""WITH {WORDS}, kept AS (SELECT doc_id, least(len(w), 510) + 2 AS real_tokens FROM words)
SELECT doc_id, real_tokens, repeat('1', CAST(real_tokens AS INTEGER)) || repeat('0', CAST(512 - real_tokens AS INTEGER)) AS mask
FROM kept""",
    "batch_pad": f"""WITH {IDS}, batched AS (
  SELECT doc_id, doc_id // 4 AS batch, size AS own, max(size) OVER (PARTITION BY doc_id // 4) AS size, ids FROM ids)
SELECT doc_id, batch, size, ids || repeat(',0', CAST(size - own AS INTEGER)) AS ids FROM batched""",
    "truncation_stats": f"""WITH {LENGTHS}, lost AS (SELECT length, greatest(length - 510, 0) AS lost FROM lengths)
SELECT count(*) AS narratives, count(*) FILTER (lost > 0) AS truncated,
  CAST(count(*) FILTER (lost > 0) AS DOUBLE) / count(*) * 100 AS pct_truncated,
  CAST(sum(lost) AS DOUBLE) / count(*) AS mean_lost_all,
  CASE WHEN count(*) FILTER (lost > 0) = 0 THEN 0.0 ELSE CAST(sum(lost) AS DOUBLE) / count(*) FILTER (lost > 0) END
    AS mean_lost_truncated, max(lost) AS max_lost FROM lost""",
    "length_describe": f"""WITH {LENGTHS} SELECT count(*) AS count, avg(length) AS mean,
  round(stddev_samp(length), 6) AS std, min(length) AS min, max(length) AS max, quantile_cont(length, 0.25) AS q25,
  quantile_cont(length, 0.5) AS q50, quantile_cont(length, 0.75) AS q75 FROM lengths""",
    "split_stratified": f"WITH {ENCOUNTERS}, {SPLIT} SELECT n, label, part FROM parts",
    "split_random": f"WITH {ADMISSIONS}, {PLAIN_SPLIT} SELECT n, age, part FROM plain_parts JOIN admissions USING (n)",
    "sample_without": f"""WITH {ADMISSIONS} SELECT n, patient_id FROM admissions
QUALIFY row_number() OVER (ORDER BY {_ORDER.format('n')}, n) <= 1000""",
    "bootstrap_with": f"""WITH {ENCOUNTERS}, pool AS (SELECT n FROM encounters WHERE label = 1), {DRAWS}
SELECT n, patient_id, draw FROM drawn JOIN encounters USING (n)""",
    "balanced_train": f"""WITH {ENCOUNTERS}, {SPLIT}, train AS (SELECT n, label FROM parts WHERE part = 'train'),
pool AS (SELECT n FROM train WHERE label = 1), {DRAWS},
undersampled AS (SELECT n, label, -1 AS draw FROM train WHERE label = 0
  QUALIFY row_number() OVER (ORDER BY {_ORDER.format('n')}, n) <= 5000)
SELECT n, label, draw FROM undersampled UNION ALL SELECT n, 1, draw FROM drawn""",
    "kfold": f"WITH {ENCOUNTERS}, {FOLDS} SELECT n, label, fold FROM folds",
    "ordinal_encode": f"""WITH {ADMISSIONS}, {PLAIN_SPLIT}, {CELLS}, levels AS (
  SELECT DISTINCT col, code FROM cells JOIN plain_parts USING (n) WHERE part = 'train'),
numbered AS (SELECT col, code, row_number() OVER (PARTITION BY col ORDER BY code) - 1 AS ordinal FROM levels)
SELECT n, string_agg(CAST(coalesce(ordinal, -1) AS VARCHAR), ',' ORDER BY col) FILTER (starts_with(col, 'dx')) AS dx,
  string_agg(CAST(coalesce(ordinal, -1) AS VARCHAR), ',' ORDER BY col) FILTER (starts_with(col, 'cpt')) AS cpt
FROM cells LEFT JOIN numbered USING (col, code) GROUP BY n""",
    "category_map": f"""WITH {ADMISSIONS}, {CELLS}, levels AS (SELECT DISTINCT col, code FROM cells)
SELECT col, code, row_number() OVER (PARTITION BY col ORDER BY code) - 1 AS ordinal FROM levels""",
    "embedding_sizes": f"""WITH {ADMISSIONS}, {CELLS}, counted AS (
  SELECT col, count(DISTINCT code) AS levels FROM cells GROUP BY col)
SELECT col, levels, least(50, (levels + 1) // 2) AS width FROM counted""",
    "standardize": f"""WITH {ADMISSIONS}, {PLAIN_SPLIT}, fitted AS (
  SELECT avg(age) AS ma, stddev_pop(age) AS sa, avg(los) AS ml, stddev_pop(los) AS sl
  FROM admissions JOIN plain_parts USING (n) WHERE part = 'train')
SELECT n, round((age - ma) / sa, 6) AS age_z, round((los - ml) / sl, 6) AS los_z FROM admissions, fitted""",
    "target_encode": f"""WITH {ENCOUNTERS}, {FILLED}, {FOLDS}, rows_in AS (
  SELECT n, label, fold, col, code FROM folds JOIN filled USING (n)),
per_fold AS (SELECT fold, CAST(sum(label) AS BIGINT) AS p, count(*) AS k FROM folds GROUP BY fold),
total AS (SELECT CAST(sum(p) AS BIGINT) AS p, CAST(sum(k) AS BIGINT) AS k FROM per_fold),
prior AS (SELECT fold, CAST(total.p - per_fold.p AS DOUBLE) / CAST(total.k - per_fold.k AS DOUBLE) AS prior
          FROM per_fold, total),
own AS (SELECT col, code, fold, CAST(sum(label) AS BIGINT) AS p, count(*) AS k FROM rows_in GROUP BY ALL),
every AS (SELECT col, code, CAST(sum(p) AS BIGINT) AS p, CAST(sum(k) AS BIGINT) AS k FROM own GROUP BY ALL),
stats AS (SELECT col, code, fold, every.p - own.p AS p, every.k - own.k AS k FROM own JOIN every USING (col, code))
SELECT n, label, fold, col, code, (stats.p + prior * 10.0::DOUBLE) / (stats.k + 10.0::DOUBLE) AS encoded
FROM rows_in JOIN prior USING (fold) JOIN stats USING (col, code, fold)""",
    "confusion_matrix": f"""WITH {SCORED_DOCUMENTS}, {_cells('scored')}
SELECT 'NOT_READMITTED' AS true_class, 'NOT_READMITTED' AS predicted_class, tn AS rows FROM cells
UNION ALL SELECT 'NOT_READMITTED', 'READMITTED', fp FROM cells
UNION ALL SELECT 'READMITTED', 'NOT_READMITTED', fn FROM cells
UNION ALL SELECT 'READMITTED', 'READMITTED', tp FROM cells""",
    "binary_metrics": f"""WITH {SCORED_DOCUMENTS}, {_cells('scored')}
SELECT {', '.join(f'{sql} AS {name}' for name, sql in METRICS.items())} FROM cells""",
    "roc_auc": f"WITH {SCORED_DOCUMENTS}, {_ranks('scored')} SELECT {AUC} AS auc FROM ranked",
    "roc_curve": f"""WITH {SCORED_DOCUMENTS}, {_ranks('scored')} SELECT score AS threshold,
  CAST(q_all - q_before AS DOUBLE) / CAST(q_all AS DOUBLE) AS fpr, CAST(p_all - p_before AS DOUBLE) / CAST(p_all AS DOUBLE) AS tpr
FROM ranked""",
    "eval_summary": f"""WITH {SCORED_DOCUMENTS}, marked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_ORDER.format('doc_id')}, doc_id)
            <= ceil(0.2 * count(*) OVER (PARTITION BY label)) AS in_test FROM scored),
test AS (SELECT * FROM marked WHERE in_test), train AS (SELECT * FROM marked WHERE NOT in_test),
{_cells('test')}, {_ranks('test')}
{_sizes('original_train', 'scored')} UNION ALL {_sizes('train', 'train')} UNION ALL {_sizes('test', 'test')}
UNION ALL SELECT 'parameters', 'threshold', 0.5 UNION ALL SELECT 'parameters', 'test_share', 0.2
{' '.join(f"UNION ALL SELECT 'metrics', '{name}', {sql} FROM cells" for name, sql in METRICS.items())}
UNION ALL SELECT 'metrics', 'auc', {AUC} FROM ranked""",
    "softmax_argmax": """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS z FROM embeddings),
e AS (SELECT vec_id, label, z, list_transform(z, lambda x: exp(x - list_max(z))) AS w FROM v)
SELECT vec_id, label, list_position(z, list_max(z)) - 1 AS predicted_label, round(w[2] / list_sum(w), 6) AS probability
FROM e""",
    "sigmoid_threshold": """WITH p AS (SELECT event_id, 1.0 / (1.0 + exp(-((value - 50.0) / 25.0))) AS p FROM events)
SELECT event_id, round(p, 6) AS probability, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS predicted_label,
  CASE WHEN p > 0.5 THEN 'READMITTED' ELSE 'NOT_READMITTED' END AS predicted_name FROM p""",
}

_BALANCED = "CAST(5000 AS BIGINT) AS train_0, CAST(5000 AS BIGINT) AS train_1"
_TESTED = f"WITH {ENCOUNTERS}, {SPLIT} SELECT n, label, true AS valid, {_BALANCED} FROM parts WHERE part = 'test'"

#: Leaves of four fixed trees and a class, as the leaf queries place encounters.
_LEAVES = (
    "CASE WHEN age < 40 THEN 0 WHEN age < 65 THEN 1 ELSE 2 END",
    "CASE WHEN los <= 4 THEN 0 WHEN los <= 10 THEN 1 ELSE 2 END",
    "CASE disposition WHEN '1' THEN 0 WHEN '3' THEN 1 ELSE 2 END",
    "CASE WHEN age >= 60 AND los > 7 THEN 1 ELSE 0 END",
)
_PLACED = "CASE WHEN age >= 60 OR los > 10 THEN 1 ELSE 0 END AS label"


def _refit(rate: float = 0.5, penalty: float = 3.0) -> str:
    """Tree after tree: sums per leaf at the margin so far, then the next margin."""
    p = "1 / (1 + exp(-m{0}))"
    steps = [f"{ADMISSIONS}, x0 AS (SELECT n, {_PLACED}, 0.0::DOUBLE AS m0, {', '.join(f'{c} AS l{i}' for i, c in enumerate(_LEAVES))} FROM admissions)"]
    for i in range(len(_LEAVES)):
        now = p.format(i)
        steps.append(f"t{i} AS (SELECT l{i} AS leaf, sum(label - {now}) AS g, sum({now} * (1 - {now})) AS h FROM x{i} GROUP BY l{i})")
        steps.append(f"x{i + 1} AS (SELECT x{i}.*, m{i} + {rate}::DOUBLE * g / (h + {penalty}) AS m{i + 1} FROM x{i} JOIN t{i} ON l{i} = leaf)")
    return ", ".join(steps)


_TREES = range(len(_LEAVES))
_STAGES = " UNION ALL ".join(
    f"""SELECT {i + 1} AS trees, count(*) FILTER (label = 1 AND m{i + 1} > 0) AS tp, count(*) FILTER (label = 0 AND m{i + 1} > 0) AS fp,
  count(*) FILTER (label = 1 AND m{i + 1} <= 0) AS fn FROM x{len(_LEAVES)}"""
    for i in _TREES
)

MODELS = {
    "rf_rows": _TESTED,
    "gbt_rows": _TESTED,
    "mlp_rows": _TESTED,
    "text_rows": f"""WITH {ENCOUNTERS}, {PLAIN_SPLIT}
SELECT n, label, true AS valid, {_BALANCED} FROM plain_parts JOIN encounters USING (n) WHERE part = 'test'""",
    "importance_check": "SELECT 135 AS features, true AS valid",
    "grid_check": """SELECT "numTrees", "maxDepth", "minInstancesPerNode", true AS valid
FROM (VALUES (200), (300)) t("numTrees"), (VALUES (20), (30)) d("maxDepth"), (VALUES (2), (4)) l("minInstancesPerNode")""",
    "planted_models": f"""WITH {SCORED}, sized AS (SELECT score >= 2 AS planted, ceil(0.2 * count(*)) AS tested FROM scored GROUP BY 1)
SELECT model, CAST(sum(tested) AS BIGINT) AS tested, true AS found
FROM sized, (VALUES ('forest'), ('boosting'), ('network')) models(model) GROUP BY model""",
    "leaf_refit": f"WITH {_refit()} "
    + " UNION ALL ".join(
        f"SELECT {i} AS tree, leaf, round(g, 6) AS gradient, round(h, 6) AS hessian, round(0.5::DOUBLE * g / (h + 3.0), 6) AS value FROM t{i}"
        for i in _TREES
    ),
    "staged_f1": f"""WITH {_refit()}, stages AS ({_STAGES}),
scored AS (SELECT *, CASE WHEN tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM stages)
SELECT trees, tp, fp, fn, round(f1, 9) AS f1, trees = (SELECT trees FROM scored ORDER BY f1 DESC, trees LIMIT 1) AS chosen FROM scored""",
    "positive_f1": f"""WITH {ADMISSIONS}, x AS (SELECT {_PLACED}, {_LEAVES[3]} AS said FROM admissions)
SELECT round(2.0::DOUBLE * count(*) FILTER (label = 1 AND said = 1)
  / (count(*) FILTER (label = 1) + count(*) FILTER (said = 1)), 9) AS f1 FROM x""",
    "stream_rows": f"""WITH cut AS (
  SELECT CAST(trunc(epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) * 0.8::DOUBLE) AS BIGINT) AS micros FROM events),
later AS (
  SELECT event_id AS n, CAST(event_type = 'error' AS INTEGER) AS label, user_id,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events, cut WHERE epoch_us(ts) >= micros),
named AS (
  SELECT n, label, chr(65 + k % 26) || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') AS dx,
         'I' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') AS second FROM later),
codes AS (SELECT n, dx FROM named UNION ALL SELECT n, second FROM named), {RULES}, {FLAGS},
scores AS (SELECT n, {_SUM} {_LESS} AS score FROM flags)
SELECT n, {_chapter('dx')} AS title, score, label, true AS valid FROM named JOIN scores USING (n)""",
}

_REPORT = TRAINING["eval_summary"]

MORE = {
    "ordered_target": f"""WITH {ENCOUNTERS}, {FILLED}, rows_in AS (SELECT n, label, col, code FROM encounters JOIN filled USING (n)),
prior AS (SELECT avg(label) AS prior FROM encounters),
earlier AS (SELECT n, col, code, coalesce(sum(label) OVER w, 0) AS p, count(*) OVER w AS k FROM rows_in
  WINDOW w AS (PARTITION BY col, code ORDER BY {_ORDER.format('n')}, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT n, col, code, round((p + prior) / (k + 1.0::DOUBLE), 9) AS encoded FROM earlier, prior""",
    "unbalanced_train": f"""WITH {ENCOUNTERS}, {SPLIT} SELECT n, label, CAST(-1 AS BIGINT) AS draw FROM parts WHERE part = 'train'""",
    "sketched_lengths": """SELECT quantile, count(*) AS rows, true AS in_bounds
FROM documents, (VALUES ('q25'), ('q50'), ('q75'), ('q95')) q(quantile) GROUP BY quantile""",
    "sketched_levels": f"WITH {FILLED} SELECT col, count(DISTINCT code) AS levels, true AS in_bounds FROM filled GROUP BY col",
    "rejected_rows": f"""WITH {ADMISSIONS} SELECT
  CASE n % 20 WHEN 1 THEN concat_ws(',', n, age) WHEN 2 THEN concat_ws(',', n, age, los, 'x') WHEN 3 THEN concat_ws(',', '', age, los)
    WHEN 4 THEN concat_ws(',', n, 'about ' || age, los) ELSE CAST(n AS VARCHAR) END AS line,
  CASE n % 20 WHEN 1 THEN 'number of fields' WHEN 2 THEN 'number of fields' WHEN 3 THEN 'no encounter id'
    WHEN 4 THEN 'no number in AGE' ELSE 'kept' END AS outcome,
  CASE WHEN n % 20 IN (1, 2, 3, 4) THEN NULL ELSE CAST(CAST(age AS DOUBLE) AS VARCHAR) END AS age FROM admissions""",
    "bucketed_score": f"""WITH {ENCOUNTERS}, {SCORES}
SELECT n, coalesce(score, 0) AS score, label FROM encounters LEFT JOIN scores USING (n)""",
    "monthly_admissions": f"""WITH {ADMISSIONS}
SELECT strftime(admit, '%Y-%m') AS month, count(*) AS encounters, CAST(sum(los) AS BIGINT) AS days FROM admissions
WHERE strftime(admit, '%Y-%m') BETWEEN '1995-01' AND '1995-06' GROUP BY 1""",
    "streamed_labels": f"""WITH {ENCOUNTERS}
SELECT n, label FROM encounters WHERE admit < (SELECT max(admit) FROM encounters) - INTERVAL 33 DAY""",
}

DATASETS = {
    "narrative_csv": f"WITH {NARRATIVES} SELECT prompt, label, count(*) AS encounters FROM narratives GROUP BY ALL",
    "encounter_csv": f"""WITH {ADMISSIONS}, {CODES}
SELECT CAST(n AS VARCHAR) AS n, 'dx' AS kind, pos, trim(dx) AS code FROM codes WHERE pos <= 34 AND dx IS NOT NULL
UNION ALL SELECT CAST(n AS VARCHAR), 'cpt', pos, cpt FROM codes WHERE pos <= 100
UNION ALL SELECT CAST(n AS VARCHAR), 'age', 0, CAST(CAST(age AS DOUBLE) AS VARCHAR) FROM admissions""",
    "token_dataset": f"""WITH {IDS}
SELECT doc_id, ids || repeat(',0', CAST(512 - size AS INTEGER)) AS ids, size AS real_tokens FROM ids""",
    "summary_log": f"""WITH report AS ({_REPORT})
SELECT run_id, section, key, value, true AS timed FROM report, (VALUES ('first'), ('second')) runs(run_id)""",
    "shuffled_preview": f"WITH {ADMISSIONS} SELECT n, age FROM admissions ORDER BY {_ORDER.format('n')}, n LIMIT 100",
    "decoded_levels": f"WITH {FILLED} SELECT n, col, code FROM filled",
    "level_sizes": f"WITH {FILLED} SELECT col, count(DISTINCT code) AS levels FROM filled GROUP BY col",
    "best_threshold": f"""WITH {SCORED_DOCUMENTS}, runs AS (
  SELECT cut, count(*) FILTER (score > cut / 10.0::DOUBLE AND label = 1) AS tp,
         count(*) FILTER ((score > cut / 10.0::DOUBLE) <> (label = 1)) AS wrong
  FROM scored, range(10) cuts(cut) GROUP BY cut)
SELECT CAST(cut AS INTEGER) AS cut, 2.0::DOUBLE * tp / (2 * tp + wrong) AS f1 FROM runs ORDER BY f1 DESC, cut DESC LIMIT 1""",
    "mapped_batches": "SELECT doc_id, length(coalesce(text, '')) AS characters FROM documents",
}
