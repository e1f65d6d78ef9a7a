"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import align, chat, decontaminate, host_rules, html_text, langid, licenses, mixture, parity_join, quality, repair, url_rules, vector_join
from weftline.llm.common import hash_fold, table

#: Fixed by the contract: host, path, verdict.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(hash_fold("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.where(hash_fold("doc_id", 4) != 2))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(hash_fold("doc_id", 5) == 0, F.lit(False))
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(hash_fold("doc_id", 5) != 0))
    return quality.rate(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan_licenses(docs, licenses.fit(docs))
    families = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"])))
    return found.select(
        "doc_id",
        F.array_join(families, ",").alias("families"),
        F.size("licenses").cast("long").alias("n_paragraphs"),
        F.coalesce(F.array_max(F.transform("licenses", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = turns.unionByName(extra).withColumn("parts", chat.text_part(F.col("text")))
    return chat.chat_digests(chat.format_chat(rows))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_rules.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_rules.host_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_kept")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.repair_report(repair.faults(rows, F.col("present")))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_report(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_language": op1_language,
        "op2_quality": op2_quality,
        "op3_source_mix": op3_source_mix,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_licenses": op5_licenses,
        "op6_chat_format": op6_chat_format,
        "op7_url_rules": op7_url_rules,
        "op8_near_vectors": op8_near_vectors,
        "op9_main_text": op9_main_text,
        "op10_decontaminate": op10_decontaminate,
        "op11_host_rules": op11_host_rules,
        "op12_repair": op12_repair,
        "op13_align": op13_align,
    }


_ESCAPED = "replace(replace(replace(replace(replace({0}, '\\', '\\e'), '<|', '\\l|'), '</s>', '\\l/s>'), '[INST]', '\\iINST]'), '[/INST]', '\\i/INST]')"

OP6_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(23 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP7_SQL = """
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM pages),
best AS (
  SELECT n, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM u JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (n)
"""

OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT row_no, list_slice(w, i, i + 4) AS s FROM (SELECT row_no, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT row_no, count(*) AS n FROM g GROUP BY row_no),
p AS (
  SELECT a, b FROM (SELECT x.row_no AS a, y.row_no AS b, count(*) AS shared FROM g x JOIN g y ON x.s = y.s AND x.row_no <> y.row_no GROUP BY 1, 2)
  JOIN n na ON na.row_no = a JOIN n nb ON nb.row_no = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
r(a, b) AS (SELECT row_no, row_no FROM d UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT d.doc_id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN r ON r.a = d.row_no JOIN d o ON o.row_no = r.b LEFT JOIN n ON n.row_no = d.row_no GROUP BY d.row_no, d.doc_id
"""

OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS row_no, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (
  SELECT x.row_no AS a, y.row_no AS b FROM ok x JOIN ok y ON x.row_no <> y.row_no AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
r(a, b) AS (SELECT row_no, row_no FROM v UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT r.a AS row_no, min(o.vec_id) AS component_id FROM r JOIN v o ON o.row_no = r.b GROUP BY r.a),
k AS (SELECT a AS row_no, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c USING (row_no) LEFT JOIN k USING (row_no)
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g FROM (
    SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT row_no, n, i, list_slice(w, i, i + n - 1) AS g FROM (
    SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT row_no, grams.n AS n, i, item_id FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
pos AS (SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(i, i + n)) AS p FROM hits) GROUP BY row_no),
its AS (SELECT row_no, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row_no, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (row_no) LEFT JOIN its USING (row_no)
"""

_OP11_RULES = ("short", "repeated", "symbols", "lines")
#: Shrunk rate of a host: mean if rates vary between hosts no more than counts do, else by mean and strength of the beta prior.
_OP11_RATE = "CASE WHEN hosts < 2 OR {0}_f = 0 OR {0}_f = n_all OR {0}_b <= 0 THEN {0}_m ELSE ({0} + {0}_m * greatest({0}_v / {0}_b - 1, 0)) / (n + greatest({0}_v / {0}_b - 1, 0)) END"

OP11_SQL = (
    r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT row_no, i, list_slice(w, i, i + 2) AS g FROM (SELECT row_no, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT row_no, unnest(range(i, i + 3)) AS p FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, g) AS c FROM g) WHERE c > 1),
m AS (
  SELECT row_no, doc_id, source, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN (SELECT row_no, count(DISTINCT p) AS n FROM r GROUP BY row_no) USING (row_no)),
f AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeated, 10 * n_symbols > word_chars AS symbols, 10 * n_dup_lines > 3 * n_lines AS lines FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, """
    + ", ".join(f"CAST(count(*) FILTER ({r}) AS DOUBLE) AS {r}" for r in _OP11_RULES)
    + " FROM f GROUP BY source),\nt AS (SELECT count(*) AS hosts, sum(n) AS n_all, sum(n * n) AS n_2, "
    + ", ".join(f"sum({r}) AS {r}_f, sum({r} * {r} / n) AS {r}_2" for r in _OP11_RULES)
    + " FROM h),\nu AS (SELECT *, "
    + ", ".join(f"{r}_f / n_all AS {r}_m, {r}_f / n_all * (1 - {r}_f / n_all) AS {r}_v" for r in _OP11_RULES)
    + " FROM t),\nb AS (SELECT *, "
    + ", ".join(f"({r}_2 - n_all * {r}_m * {r}_m - (hosts - 1) * {r}_v) / nullif(n_all - n_2 / n_all, 0) AS {r}_b" for r in _OP11_RULES)
    + " FROM u),\nj AS (SELECT source, greatest("
    + ", ".join(_OP11_RATE.format(r) for r in _OP11_RULES)
    + ") <= 0.5 AS host_kept FROM h, b)\n"
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeated AS base_failed, host_kept AND NOT (short OR repeated) AS kept, host_kept
FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source
"""
)

#: After each row every state is reached by its cheapest edits, the ASCII-least of several. q: insertions in a state and where they lead.
OP12_SQL = r"""
WITH RECURSIVE z AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS k
  FROM conversations, z),
d AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last FROM d),
f AS (
  SELECT conv_id, i, turn, role, text, left(role, 1) AS first, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM p),
q(state, n, mid, roles) AS (VALUES
  (0, 0, 0, []), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
  (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])),
s AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM conversations
  UNION ALL
  SELECT conv_id, i, state, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best FROM (
      SELECT s.conv_id, f.i, s.cost + 2 * q.n + CASE e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost, s.audit || repeat('I', q.n) || e AS audit,
        CASE WHEN e = 'D' THEN mid WHEN e = 'R' THEN CASE mid WHEN 2 THEN 3 ELSE 2 END ELSE CASE first WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS state,
        s.said || q.roles || CASE e WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE mid WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] END AS said
      FROM s JOIN f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = s.i + 1 JOIN q ON q.state = s.state, (VALUES ('D'), ('K'), ('R')) AS v(e)
      WHERE e = 'D' OR fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR first = 's' AND mid = 0 OR first = 'u' AND mid <> 2 OR first = 'a' AND mid = 2)))
  WHERE best = 1),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(first) OVER (PARTITION BY conv_id ORDER BY i) || first AS pair FROM f) GROUP BY conv_id),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS best FROM (
    SELECT s.conv_id, gaps, blank, duplicate, truncated, illegal, s.cost + 2 * len(x.roles) AS cost, s.audit || repeat('I', len(x.roles)) AS audit, s.said || x.roles AS said
    FROM s LEFT JOIN n ON s.conv_id IS NOT DISTINCT FROM n.conv_id JOIN (VALUES (0, []), (1, ['user:', 'assistant:']), (2, ['assistant:']), (3, [])) AS x(state, roles) ON x.state = s.state
    WHERE s.i = coalesce(n.n, 0)))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(cost AS BIGINT) AS cost, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
FROM o WHERE best = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_host_rules": OP11_SQL, "op12_repair": OP12_SQL, "op4_jaccard_join": OP4_SQL, "op8_near_vectors": OP8_SQL, "op6_chat_format": OP6_SQL, "op7_url_rules": OP7_SQL, "op10_decontaminate": OP10_SQL}
