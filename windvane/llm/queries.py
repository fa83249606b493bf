"""Queries of this subpackage, one per operator, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from windvane.llm import conversation_repair, decontaminate, exact_dedup, language_id, line_dedup, lm_score, minhash_dedup, mixing, quality, secret_scan, spelling_variants, toxicity, warc
from windvane.llm.crc_sql import CRC_TABLE, crc32, utf8

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS place FROM d)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY place) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size, place = 1 AS kept, text_sha256
FROM r""")
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op2_language_id")
def op2_language_id(spark, sf_dir):
    return language_id.language_predictions(table(spark, sf_dir, "documents"))


@query("op4_mixing")
def op4_mixing(spark, sf_dir):
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


@query("op7_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id""")
def op7_line_dedup(spark, sf_dir):
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


@query("op6_minhash_dedup", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [list_aggregate(words, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: list_aggregate(words[i:i + 4], 'string_agg', ' '))) END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (shingle) WHERE a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS least FROM documents UNION SELECT p.a, r.least FROM r JOIN p ON p.b = r.node WHERE r.least < p.a),
c AS (SELECT node, min(least) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(shingles) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.node = s.doc_id""")
def op6_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_groups(table(spark, sf_dir, "documents")).drop("mark", "size", "comp")


@query("op10_decontaminate")
def op10_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark", "size")


def _base32(sha1: str) -> str:
    """SQL for the base32 form of a hexadecimal SHA-1: five bytes give eight digits."""
    digits = " || ".join(f"to_base(CAST('0x' || substr({sha1}, {1 + 10 * i}, 10) AS BIGINT), 32, 8)" for i in range(4))
    return f"translate(lower({digits}), '0123456789abcdefghijklmnopqrstuv', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"


@query("op3_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
m AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS digest, max(page_id) OVER (PARTITION BY body) AS response FROM p)
SELECT page_id, payload_bytes, {_base32("digest")} AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to
FROM m""")
def op3_warc(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"))


@query("op8_quality")
def op8_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_lm_score")
def op5_lm_score(spark, sf_dir):
    return lm_score.perplexity_scores(table(spark, sf_dir, "documents"))


_BARE = r"regexp_replace(text, '[\x20\x09-\x0D]+$', '')"


@query("op13_conversation_repair", f"""
WITH RECURSIVE {CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc32(utf8("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))"))} % 20 AS kind FROM conversations, crc_table),
g AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM g),
f AS (SELECT *, substr(role, 1, 1) AS initial, {_BARE} = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
        NOT regexp_matches({_BARE}, '[.!?]$') AS cut FROM o),
t AS (SELECT *, CASE WHEN blank THEN 'b' WHEN again THEN 'd' WHEN cut THEN 't' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM f),
m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM t GROUP BY conv_id),
steps AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS v(p, c, q)),
gap AS (SELECT * FROM (VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')) AS v(p, q, c, a)),
edits AS (
  SELECT t.conv_id, t.pos, s.p, s.q, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS c, 'K' AS a FROM t JOIN steps s ON s.c = t.initial WHERE fault IN ('', 't')
  UNION ALL SELECT t.conv_id, t.pos, s.p, s.q, 3 + CASE WHEN fault = 't' THEN 3 ELSE 0 END, 'R' FROM t JOIN steps s ON s.c IN ('u', 'a') WHERE fault IN ('', 't')
  UNION ALL SELECT t.conv_id, t.pos, v.p, v.p, 4, 'D' FROM t, (VALUES (0), (1), (2), (3)) AS v(p)),
moves AS (
  SELECT conv_id, pos, e.p, gap.q, min({{'c': e.c + gap.c, 'a': e.a || gap.a}}) AS x FROM edits e JOIN gap ON gap.p = e.q GROUP BY ALL),
paths AS (
  SELECT m.conv_id, 0::BIGINT AS pos, gap.q, {{'c': gap.c, 'a': gap.a}} AS x FROM m, gap WHERE gap.p = 0
  UNION ALL
  SELECT r.conv_id, r.pos + 1, v.q, min({{'c': r.x.c + v.x.c, 'a': r.x.a || v.x.a}}) FROM paths r JOIN moves v ON v.conv_id IS NOT DISTINCT FROM r.conv_id AND v.pos = r.pos + 1 AND v.p = r.q GROUP BY ALL),
best AS (SELECT m.conv_id, min(x) AS x FROM m JOIN paths r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.pos = m.n AND r.q IN (0, 3) GROUP BY ALL),
letters AS (SELECT conv_id, unnest(string_split(x.a, '')) AS edit, unnest(range(len(x.a))) AS nth, len(replace(x.a, 'D', '')) % 2 AS odd FROM best WHERE x.a <> ''),
placed AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS pos, count(*) FILTER (edit <> 'D') OVER w - 1 - odd AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY nth)),
mended AS (SELECT p.conv_id, string_agg(CASE WHEN p.edit = 'K' THEN t.role WHEN p.place % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN p.edit = 'I' THEN '' ELSE t.text END, chr(10) ORDER BY p.nth) AS whole
  FROM placed p LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.pos = p.pos WHERE p.edit <> 'D' GROUP BY p.conv_id)
SELECT c.conv_id, coalesce(m.gaps, 0) AS gaps, coalesce(m.blank, 0) AS blank, coalesce(m.duplicate, 0) AS duplicate, coalesce(m.truncated, 0) AS truncated, coalesce(m.illegal, 0) AS illegal,
       coalesce(b.x.c, 0)::BIGINT AS cost, coalesce(b.x.a, '') AS audit, sha256(coalesce(d.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN mended d ON d.conv_id IS NOT DISTINCT FROM c.conv_id""")
def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_digests(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


@query("op11_spelling_variants", f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY ALL),
h AS (SELECT run, n, {crc32(utf8("concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run)"))} AS h FROM d, crc_table),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
g AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
e AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM g),
one AS (SELECT DISTINCT e.word, e.n, v.word AS other, v.n AS other_n FROM e JOIN v ON v.word = e.a || e.b),
p AS (SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM e x JOIN e y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT * FROM one UNION ALL SELECT other, other_n, word, n FROM one),
f AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM p),
forms AS (SELECT v.word, v.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.other_n >= 2 * v.n THEN f.other END AS form, CASE WHEN f.other_n >= 2 * v.n THEN f.other_n END AS form_n
  FROM v LEFT JOIN f ON f.word = v.word AND f.place = 1),
c AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, forms.form FROM c JOIN forms ON forms.word = c.at WHERE forms.form IS NOT NULL)
SELECT forms.word, forms.form, c.at AS root, forms.n, forms.n_near, forms.form_n FROM c JOIN forms ON forms.word = c.word JOIN forms l ON l.word = c.at AND l.form IS NULL""")
def op11_spelling_variants(spark, sf_dir):
    return spelling_variants.variant_forms(table(spark, sf_dir, "documents"))


@query("op12_secret_scan")
def op12_secret_scan(spark, sf_dir):
    return secret_scan.secret_digests(table(spark, sf_dir, "documents"))
