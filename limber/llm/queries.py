"""The queries of this package and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from limber.llm import exact_dedup, filter_audit, html_extract, license_scan, mixing, near_dedup, packing, quality, substring_dedup, token_counts, toxicity, vector_codes, warc
from limber.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_lengths(table(spark, sf_dir, "documents")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_weights(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_substrings(table(spark, sf_dir, "documents"), with_text=False)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_report(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


ALL = (
    op1_exact_dedup,
    op2_quality_rules,
    op3_packing,
    op4_token_counts,
    op5_mixing,
    op6_toxicity,
    op7_near_dedup,
    op8_html_extraction,
    op9_substring_dedup,
    op10_license_scan,
    op11_warc,
    op12_filter_audit,
    op13_vector_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


SPACE = r"[\x20\x09-\x0D]+"
WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '')"

OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') AS norm FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM ranked
"""

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM starts),
hit AS (SELECT doc_id, s FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM hit),
listed AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM listed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _line_fails(line: str) -> str:
    count = lambda pattern: f"len(regexp_extract_all({line}, '{pattern}'))"
    n, noise, shouts = count(r"[^\x20\x09-\x0D]+"), count("[#*$%&]{2,}"), count("!{2,}")
    bars = f"({count('[|•]')} + CASE WHEN contains({line}, '«') THEN 0 ELSE {count('»')} END)"
    phrases = " || ".join(f"regexp_extract_all(lower({line}), {_quoted(p)}, 1)" for p in (quality.FURNITURE, quality.CALL))
    furniture = f"5 * len(regexp_extract_all(array_to_string({phrases}, ' '), '[^ ]+')) > 2 * {n}"
    return (
        f"(({bars} >= 2 AND {bars} * 5 >= {n}) OR ({noise} >= 1 AND {noise} * 10 >= {n} * 3) OR ({shouts} >= 1 AND {shouts} * 10 >= {n} * 3)"
        f" OR ({n} BETWEEN 1 AND 12 AND {furniture}) OR ({n} >= 40 AND NOT regexp_matches({line}, '{quality.SENTENCE_MARKS}')))"
    )


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (
    SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))
),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c >= 2) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words,
    length(regexp_replace(array_to_string(list_filter(l, lambda x: NOT {_line_fails("x")}), ''), '{SPACE}', '', 'g')) AS clean_chars
  FROM d LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, clean_chars::BIGINT AS clean_chars,
  (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)
    AND 100 * (word_chars - clean_chars) <= {quality.MAX_LOST_PERCENT} * word_chars AS kept
FROM m
"""


def _op10_sql() -> str:
    upper = "".join(map(chr, range(65, 91)))
    split = r"regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(upper, upper.lower())
    places = []
    for phrase, label in license_scan.PHRASES.items():
        here = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase))
        places.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {here}), lambda i: {{'word': i - 1, 'label': '{label}'}})")
    rows = []
    for number, (label, text) in enumerate(license_scan.TEMPLATES):
        ws = [w.decode() for w in license_scan.license_words(text)]
        size = len(set(ws))
        need, room = math.ceil(license_scan.CONTAINMENT * size - 1e-9), math.ceil(license_scan.STRETCH * len(ws))
        rows.append(f"({number}, '{label}', {sorted(set(ws))}, {size}, {need}, {room})")
    joined = lambda x: f"coalesce(array_to_string(list_sort(list_distinct({x})), ','), '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
p AS (SELECT r, doc_id, len(w) AS n_words, {' || '.join(places)} AS places FROM d),
t(number, label, words, size, need, room) AS (VALUES {', '.join(rows)}),
tw AS (SELECT number, room, need, unnest(words) AS word FROM t),
u AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
every AS (SELECT r, number, i, word, room, need FROM u JOIN tw USING (word)),
hits AS (SELECT * FROM every SEMI JOIN (SELECT r, number FROM every GROUP BY r, number, need HAVING count(DISTINCT word) >= need) USING (r, number)),
windows AS (SELECT a.r, a.number, a.i, count(DISTINCT b.word) AS c FROM hits a JOIN hits b ON a.r = b.r AND a.number = b.number AND b.i > a.i - a.room AND b.i <= a.i GROUP BY a.r, a.number, a.i, a.need HAVING count(DISTINCT b.word) >= a.need),
blocks AS (SELECT r, list(DISTINCT label) AS labels, max(c::DOUBLE / size) AS share FROM windows JOIN t USING (number) GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base,
  list_min(list_transform(places, lambda x: x.word))::BIGINT AS first_word, list_max(list_transform(places, lambda x: x.word))::BIGINT AS last_word,
  {joined("list_transform(places, lambda x: x.label)")} AS base_labels,
  {joined("list_transform(places, lambda x: x.label) || coalesce(labels, []::VARCHAR[])")} AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM p LEFT JOIN blocks USING (r)
"""


OP11_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p),
m AS (SELECT *, payload_bytes >= {warc.LEAST_REVISIT} AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM f)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to FROM m
"""

OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS} AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
k AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN k USING (doc_id)
),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
s AS (SELECT filter_order, step, filter_order[step] AS letter, left(filter_order, step - 1) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
h AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails, contains(fails, letter) AS hit,
    len(list_filter(range(1, step), lambda i: contains(fails, earlier[i]))) > 0 AS gone
  FROM c, s
),
r AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN hit OR gone THEN 0 ELSE n END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM h GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r
"""


def _op13_sql() -> str:
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    assigned = lambda i: f"""a{i} AS (
  SELECT x.r, x.p, arg_min(e, d * {2 * entries} + e) AS e, min(d) AS d FROM (
    SELECT x.r, x.p, b.e, list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{i} b ON b.p = x.p) x GROUP BY x.r, x.p
)"""  # noqa: E731
    moved = lambda i: f"""m{i} AS (
  SELECT p, e, list(floor(s / n)::BIGINT ORDER BY j) AS x FROM (
    SELECT p, e, j, sum(c)::DOUBLE AS s, count(*) AS n FROM (SELECT a.p, a.e, unnest(x.x) AS c, unnest(range(0, len(x.x))) AS j FROM a{i} a JOIN x ON x.r = a.r AND x.p = a.p) GROUP BY p, e, j
  ) GROUP BY p, e
), b{i + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.e = b.e)"""  # noqa: E731
    rounds = ", ".join(f"{assigned(i)}, {moved(i)}" for i in range(vector_codes.ROUNDS))
    last = vector_codes.ROUNDS
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: floor({vector_codes.SCALE} * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), x AS (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM (SELECT r, v, unnest(range(0, {parts})) AS p FROM k)),
b0 AS (SELECT p, r - 1 AS e, x FROM x WHERE r <= {entries}),
{rounds}, {assigned(last)},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last}),
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (r), h
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL, "op2_quality_rules": OP2_SQL, "op9_substring_dedup": OP9_SQL, "op10_license_scan": _op10_sql(), "op11_warc": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_vector_codes": _op13_sql(),
    }
