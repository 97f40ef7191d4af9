"""The queries of this package and their SQL: thin digests of the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, exact_dedup, html_content, jaccard, licenses, mixing, packing, phrases, repair, repeats, sharding, toxicity
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "n_spans", F.to_json("spans").alias("spans"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licensed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_duplicates(docs, keep_text=False).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.similar_groups(docs).select("doc_id", "n_shingles", "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    first = F.round(F.try_element_at("positions", F.lit(1)), 6).alias("first_position")
    digest = mixed.select("doc_id", "size", "source_size", "target", "taken", first)
    return digest.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    test = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.format_chat(turns.unionByName(test))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.without_repeats(docs, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(repair.damage(table(spark, sf_dir, "conversations")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_nearest_neighbours, op3_license_scan, op4_exact_dedup, op5_sharding, op6_html_extraction, op7_jaccard_join, op8_mixing, op9_chat_format, op10_packing, op11_suffix_dedup, op12_conversation_repair, op13_collocations)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": _OP4, "op7_jaccard_join": _OP7, "op8_mixing": _OP8, "op9_chat_format": _OP9, "op11_suffix_dedup": _OP11, "op12_conversation_repair": _OP12, "op13_collocations": _OP13}


_OP4 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_OP7 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS MATERIALIZED (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (
  SELECT doc_id AS x, doc_id AS r FROM documents
  UNION SELECT l.y, reach.r FROM reach JOIN links l ON l.x = reach.x AND reach.r < l.y
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST(min(reach.r) AS BIGINT) AS component_id
FROM sets s JOIN reach ON reach.x = s.doc_id GROUP BY s.doc_id, s.s
"""

_OP8 = r"""
WITH docs AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, source,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ' ', coalesce(text, ''))) AS key FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source
), weighed AS (SELECT *, CAST(place % 3 + 1 AS BIGINT) AS weight, CAST(source_size * 3 AS DOUBLE) / (place % 3 + 1) AS fill FROM sources),
steps AS (
  SELECT fill, place, CAST((SELECT sum(source_size) FROM weighed) - coalesce(sum(source_size * 3) OVER w, 0) AS DOUBLE)
    / CAST((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM weighed WINDOW w AS (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, place, source_size, least(CAST(source_size * 3 AS DOUBLE), weight * (SELECT arg_min(level, fill) FROM steps WHERE level <= fill)) AS target FROM weighed
), placed AS (
  SELECT d.*, t.place, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), once AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(before + size <= target AS INT) + CAST(source_size + before + size <= target AS INT) + CAST(2 * source_size + before + size <= target AS INT) END AS copies FROM placed
), lacking AS (SELECT *, target - sum(copies * size) OVER (PARTITION BY source) AS room FROM once),
more AS (
  SELECT doc_id, key, later, later * 2 + size <= room * 2 AS extra FROM (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM lacking WHERE size > 0 AND copies < 3 AND size <= room) m
), done AS (
  SELECT l.*, (place % 3 - 1) * 0.5::DOUBLE AS slope, CAST(CASE WHEN m.extra THEN 1 ELSE 0 END AS BIGINT) AS extra,
    CASE WHEN copies > 0 OR m.extra THEN least(1.0::DOUBLE, CAST(CASE WHEN copies > 0 THEN before ELSE target - room + later END AS DOUBLE) / target) END AS share
  FROM lacking l LEFT JOIN more m ON m.doc_id = l.doc_id AND m.key = l.key
)
SELECT doc_id, size, source_size, target, CAST((copies + extra) * size AS BIGINT) AS taken,
  round(CASE WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + slope * share * 4) - (1 - slope)) / (slope * 2) END, 6) + 0.0 AS first_position
FROM done
"""

_OP9 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(role) + length(text) + len(regexp_extract_all(role || chr(0) || text, '<\\*/?s>|\[\\*/?INST\]')) AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) + count(*) * 17 + 3 AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = """
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
stretches AS (SELECT row, n_bytes, j, substr(h, 800 * j + 1, 1600) AS c FROM (SELECT *, unnest(range((n_bytes + 399) // 400)) AS j FROM docs)),
windows AS (SELECT row, 400 * j + k AS i, CASE WHEN 400 * j + k + 400 <= n_bytes THEN md5_number(substr(c, 2 * k + 1, 800)) END AS w, substr(c, 2 * k + 1, 2) AS byte FROM stretches, range(400) r(k) WHERE 400 * j + k < n_bytes),
twice AS (SELECT w FROM windows WHERE w IS NOT NULL GROUP BY w HAVING count(*) > 1),
hit AS (SELECT v.row, v.i, v.byte, CASE WHEN t.w IS NOT NULL THEN v.i END AS start FROM windows v LEFT JOIN twice t ON t.w = v.w),
covered AS (SELECT row, i, byte, max(start) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM hit),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY row ORDER BY i), false) AS opens FROM covered),
summed AS (
  SELECT row, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM edges GROUP BY row
)
SELECT d.doc_id, d.n_bytes, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.n_spans, 0) AS n_spans, sha256(unhex(coalesce(s.kept, ''))) AS kept_sha256
FROM docs d LEFT JOIN summed s ON s.row = d.row
"""

_OP13 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) t(k) WHERE len(w) >= k)
), counts AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, c.w, unnest(range(1, c.k)) AS cut FROM (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1) c
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, h.f AS l, t.f AS r, o.n, CAST(1000::HUGEINT * c.a * o.n // (h.f::HUGEINT * t.f) AS BIGINT) AS score
  FROM cuts c JOIN totals o ON o.lang = c.lang
  JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.cut+1:], ' ')
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (
  SELECT * FROM lowest p WHERE NOT EXISTS (
    SELECT 1 FROM counts q WHERE q.lang = p.lang AND q.f >= p.a AND q.k > len(string_split(p.phrase, ' ')) AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""

_OP12 = r"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''),
      lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT) % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, left(role, 1) AS c FROM damaged
), judged AS (
  SELECT *, CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN last IN ('.', '!', '?') THEN '-' ELSE 't' END AS fault,
    lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM judged GROUP BY conv_id
), layers AS (
  SELECT conv_id, 0 AS i, {'c': 0, 'a': '', 't': ''} AS q0, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS q1, {'c': 5, 'a': 'I', 't': chr(10) || 'user:'} AS q2, {'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS q3 FROM counted
  UNION ALL
  SELECT conv_id, i, q0, q1, q2, least(q3, {'c': q2.c + 5, 'a': q2.a || 'I', 't': q2.t || chr(10) || 'assistant:'}) AS q3 FROM (
    SELECT conv_id, i, q0, q1, q3, least(q2, {'c': q0.c + 5, 'a': q0.a || 'I', 't': q0.t || chr(10) || 'user:'}, CASE WHEN q1 IS NOT NULL THEN {'c': q1.c + 5, 'a': q1.a || 'I', 't': q1.t || chr(10) || 'user:'} END,
      CASE WHEN q3 IS NOT NULL THEN {'c': q3.c + 5, 'a': q3.a || 'I', 't': q3.t || chr(10) || 'user:'} END) AS q2 FROM (
      SELECT l.conv_id, j.i, {'c': q0.c + 2, 'a': q0.a || 'D', 't': q0.t} AS q0,
        least(CASE WHEN q1 IS NOT NULL THEN {'c': q1.c + 2, 'a': q1.a || 'D', 't': q1.t} END, CASE WHEN ok AND j.c = 's' THEN {'c': q0.c + more, 'a': q0.a || 'K', 't': q0.t || said} END) AS q1,
        least({'c': q2.c + 2, 'a': q2.a || 'D', 't': q2.t}, CASE WHEN ok AND j.c = 'u' THEN {'c': q0.c + more, 'a': q0.a || 'K', 't': q0.t || said} END,
          CASE WHEN ok AND j.c = 'u' AND q1 IS NOT NULL THEN {'c': q1.c + more, 'a': q1.a || 'K', 't': q1.t || said} END, CASE WHEN ok AND j.c = 'u' THEN {'c': q3.c + more, 'a': q3.a || 'K', 't': q3.t || said} END,
          CASE WHEN ok THEN {'c': q0.c + more + 1, 'a': q0.a || 'R', 't': q0.t || chr(10) || 'user:' || text} END, CASE WHEN ok AND q1 IS NOT NULL THEN {'c': q1.c + more + 1, 'a': q1.a || 'R', 't': q1.t || chr(10) || 'user:' || text} END,
          CASE WHEN ok THEN {'c': q3.c + more + 1, 'a': q3.a || 'R', 't': q3.t || chr(10) || 'user:' || text} END) AS q2,
        least({'c': q3.c + 2, 'a': q3.a || 'D', 't': q3.t}, CASE WHEN ok AND j.c = 'a' THEN {'c': q2.c + more, 'a': q2.a || 'K', 't': q2.t || said} END,
          CASE WHEN ok THEN {'c': q2.c + more + 1, 'a': q2.a || 'R', 't': q2.t || chr(10) || 'assistant:' || text} END) AS q3
      FROM layers l JOIN (SELECT *, fault NOT IN ('b', 'd') AS ok, CASE fault WHEN 't' THEN 5 ELSE 0 END AS more, chr(10) || role || ':' || text AS said FROM judged) j
        ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i + 1))
), ended AS (
  SELECT l.conv_id, least(q0, q3) AS best FROM layers l JOIN counted k ON k.conv_id IS NOT DISTINCT FROM l.conv_id AND k.rows = l.i
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
