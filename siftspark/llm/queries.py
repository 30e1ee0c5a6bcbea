"""The registered queries of this subpackage: each applies an operator to a whole table; SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm import conversation_repair, licenses, line_dedup, line_rules, minhash_dedup, packing, pu_quality, secret_scan, sentencepiece_ops, substring_dedup, topk_search, url_filter, vector_codes
from siftspark.llm._shared import small_batches, table

SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out_rows(id_col: str = "doc_id"):
    """A quarter of the ids, by crc32 of their text; their labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    scored = pu_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out_rows())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return line_rules.apply_line_rules(table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.hosts_of(pages).filter(url_filter.listed_host(F.col("host"))))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return found.drop("_t1", "_t2")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes its ids again."""
    small_batches(spark, 2000)
    coded = sentencepiece_ops.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), decoded_col="text")
    return coded.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.audited_digests(conversation_repair.damaged(rows), rows)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings")).withColumn("code", F.lower(F.hex("code")))


def _codes_sql(rounds: int = 4) -> str:
    """Codebooks and codes of `embeddings`, a round of training after the other."""
    steps = ["""
v AS MATERIALIZED (SELECT vec_id, label, [floor(1024 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, e[part * (len(e) // 4) + 1 : (part + 1) * (len(e) // 4)] AS x FROM v, range(4) AS t(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < 256)"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, label, p.part, x, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
  SELECT vec_id, label, p.part, x, entry, list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS d FROM p JOIN b{r} AS b USING (part)) AS p GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT part, entry, list(floor(s / n) ORDER BY pos) AS c FROM (
  SELECT part, entry, pos, sum(x[pos]) AS s, count(*) AS n FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS pos FROM a{r}) GROUP BY ALL) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{r} AS b LEFT JOIN m{r} AS m USING (part, entry))""")
    return f"""
WITH {",".join(steps)},
s AS (SELECT sha256(coalesce(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos), '')) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(c) AS x, unnest(range(len(c))) AS pos FROM b{rounds})),
o AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, s"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def _repair_sql() -> str:
    """The cheapest edits row by row: for each state, the least of cost (nine digits) and letters."""

    def add(state: str, cost: str, letter: str) -> str:
        return f"(lpad((left({state}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{letter}')"

    def least(*x: str) -> str:
        return f"least({', '.join(x)})"

    def only(test: str, x: str) -> str:
        return f"CASE WHEN {test} THEN {x} END"

    turn = ("s0", "s1", "s3")
    inserts = {
        "s2": least("s2", *(add(s, "3", "I") for s in turn)),
        "s3": least("s3", add("s2", "3", "I"), *(add(s, "6", "II") for s in ("s0", "s1"))),
    }
    stay = "f NOT IN ('b', 'd')"
    edits = {
        "s0": add("s0", "4", "D"),
        "s1": least(add("s1", "4", "D"), only(f"{stay} AND ini = 's'", add("s0", "t", "K"))),
        "s2": least(add("s2", "4", "D"), *(only(f"{stay} AND ini = 'u'", add(s, "t", "K")) for s in turn), *(only(stay, add(s, "(3 + t)", "R")) for s in turn)),
        "s3": least(add("s3", "4", "D"), only(f"{stay} AND ini = 'a'", add("s2", "t", "K")), only(stay, add("s2", "(3 + t)", "R"))),
    }
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  [ord(c)::BIGINT for c in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS b FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda acc, x: list_reduce(list_prepend(xor(acc, x), range(8)),
  lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) % 20 AS h FROM k),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE h WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS ini, rtrim(text, {SPACE_SQL}) AS bare FROM d),
r AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS f, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
s AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM conversations
  UNION ALL
  SELECT conv_id, i, {", ".join(f"{x} AS {c}" for c, x in edits.items())}
  FROM (SELECT p.conv_id, r.i, r.ini, r.f, CASE WHEN r.f = 't' THEN 3 ELSE 0 END AS t, s0, s1, {", ".join(f"{x} AS {c}" for c, x in inserts.items())}
    FROM s AS p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1)),
e AS (SELECT conv_id, left(x, 9)::BIGINT AS cost, substr(x, 10) AS audit FROM (
  SELECT conv_id, {least("s0", inserts["s3"])} AS x FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
l AS (SELECT conv_id, letter, pos, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(length(audit))) AS pos FROM e WHERE audit <> '')),
o AS (SELECT l.*, r.role, coalesce(CASE WHEN letter <> 'I' THEN r.text END, '') AS text, row_number() OVER (PARTITION BY l.conv_id ORDER BY pos) - 1 AS p,
  first_value(letter = 'K' AND r.ini = 's') OVER (PARTITION BY l.conv_id ORDER BY pos) AS led
  FROM l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i WHERE letter <> 'D'),
x AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (p - led::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS whole FROM o GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 'b') AS blank, count(*) FILTER (WHERE f = 'd') AS duplicate,
  count(*) FILTER (WHERE f = 't') AS truncated, count(*) FILTER (WHERE i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT e.conv_id, {", ".join(f"coalesce({k}, 0) AS {k}" for k in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM e.conv_id"""


QUERIES = {f.__name__: f for f in (op1_quality, op2_line_dedup, op3_line_rules, op4_minhash_dedup, op5_topk_search, op6_packing, op7_secret_scan, op8_url_filter, op9_licenses, op10_sentencepiece, op11_conversation_repair, op12_vector_codes, op13_substring_dedup)}

ORACLES = {
    "op2_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM d),
k AS (SELECT *, {LOWER_SQL.format(f"trim(line, {SPACE_SQL})")} AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, k.line, k.i, coalesce(o.owner < k.doc_id, false) AS lost FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op3_line_rules": f"""
WITH d AS (SELECT doc_id, 'h' || source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS x FROM d)),
g AS (SELECT doc_id, i, word, lead(word) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
rw AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM r WHERE n > 1) GROUP BY doc_id),
ws AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n, {LOWER_SQL.format(f"trim(line, {SPACE_SQL})")} AS key FROM l),
dl AS (SELECT doc_id, sum(c - 1)::BIGINT AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS c FROM lw WHERE n > 0 GROUP BY ALL) GROUP BY doc_id),
h AS (SELECT host, greatest(10.0, 0.01 * count(DISTINCT doc_id)) AS lim FROM d GROUP BY host),
f AS (SELECT host, key FROM lw JOIN h USING (host) WHERE n > 0 GROUP BY host, key, lim HAVING count(DISTINCT doc_id) > lim),
rm AS (SELECT doc_id, sum(n)::BIGINT AS n_removed_words FROM lw JOIN f USING (host, key) WHERE n > 0 GROUP BY doc_id),
s AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS n_removed_words
  FROM d LEFT JOIN ws USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN rm USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.5 * n_words AS kept FROM s""",
    "op5_topk_search": """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e::DOUBLE[], v.e::DOUBLE[])::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_url_filter": f"""
WITH u AS (SELECT page_id, {LOWER_SQL.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rh, rp, rv) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in url_filter.RULES)}),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
x AS (SELECT u.*, rule, rv, regexp_matches(host, '(^|[.\\-])({"|".join(url_filter.LISTED_WORDS)})([.\\-]|$)') AS listed FROM u LEFT JOIN m USING (page_id))
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM x""",
    "op11_conversation_repair": _repair_sql(),
    "op12_vector_codes": _codes_sql(),
    "op13_substring_dedup": """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS x FROM documents),
w AS (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS i FROM d),
g AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(x) - 11)) AS i, unnest([md5(array_to_string(x[k : k + 12], ' ')) for k in range(1, len(x) - 11)]) AS gram FROM d WHERE len(x) >= 13),
o AS (SELECT gram, min(doc_id) AS owner FROM g GROUP BY gram),
l AS (SELECT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN o USING (gram) WHERE owner < doc_id),
r AS (SELECT doc_id, i, true AS lost FROM l GROUP BY doc_id, i),
k AS (SELECT doc_id, count(*) AS n_words, count(lost) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE lost IS NULL) AS kept FROM w LEFT JOIN r USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
}
