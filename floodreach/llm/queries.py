"""Registered queries of the pipeline operators, each over its whole table, and their SQL counterparts where SQL can state them."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, collocations, decontaminate, langid, licences, merkle, quality_model, quality_rules, secrets, simhash, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_key")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.judge(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.judge(_table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id bigint, turn bigint, role string, text string")
    return chat.judge(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(text, '(\\|<\|im_start\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', '\1+', 'g'))
             + length(regexp_replace(role, '(\\|\n|<\|im_start\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', '\1+', 'g')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + length('<|im_start|>') + 1 + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY 1
"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.judge(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(_table(spark, sf_dir, "documents")).drop("text_key", "host")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.judge(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for an outside block list: the hosts of the corpus whose MD5 begins with 0."""
    pages = _table(spark, sf_dir, "pages")
    host, _ = urlfilter.host_and_path(F.col("url"))
    listed = pages.select(host.alias("host")).filter("host <> ''").distinct().filter(F.startswith(F.md5("host"), F.lit("0")))
    return urlfilter.judge(pages, listed)


OP10_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(name, prefix, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (SELECT page_id, host, path, arg_max(name || prefix, length(name || prefix)) AS rule, arg_max(verdict, length(name || prefix)) AS v
        FROM p LEFT JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix) GROUP BY 1, 2, 3)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host <> '' AND starts_with(md5(host), '0') THEN 'block' ELSE 'allow' END) AS verdict FROM fit
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), min_count=100, top=2000)


OP11_SQL = r"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
f AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(w) >= k)) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE k > 1),
inside AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, a FROM (SELECT lang, phrase, a, k, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) t(m) WHERE m < k)),
told AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN told USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS x, array_to_string(string_split(phrase, ' ')[cut + 1:k], ' ') AS y FROM kept, range(1, 5) t(cut) WHERE cut < k),
s AS (SELECT cuts.*, l.a AS l, r.a AS r, n, CAST((CAST(1000 AS HUGEINT) * cuts.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
      FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y JOIN total ON total.lang = cuts.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents")).drop("source")


# CRC-32 of a decimal number, by its reflected polynomial; levels of the trees by recursion
OP12_SQL = r"""
WITH RECURSIVE poly AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, source, lang, n_chars, text, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])) AS inverted FROM documents, poly),
f AS (SELECT *, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')) AS fields,
             CASE WHEN inverted & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS struck FROM d),
leaf AS MATERIALIZED (SELECT doc_id, source, sha256(fields || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(fields || coalesce(strlen(struck) || ':' || struck, '-')) AS tampered FROM f),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid FROM leaf),
low AS (SELECT 0 AS level, sid, pos AS i, leaf AS h, count(*) OVER (PARTITION BY sid) AS n FROM placed
        UNION ALL SELECT level + 1, sid, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY level, sid, i // 3),
sub AS MATERIALIZED (SELECT sid, h, level FROM low WHERE n = 1),
high AS (SELECT 0 AS level, sid AS i, h, count(*) OVER () AS n FROM sub
         UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY level, i // 3),
lows AS MATERIALIZED (SELECT * FROM low), highs AS MATERIALIZED (SELECT * FROM high),
steps AS MATERIALIZED (
  SELECT p.sid, p.pos, l.level AS step, coalesce(string_agg(l.h, '' ORDER BY l.i) FILTER (l.i < p.pos // CAST(pow(3, l.level) AS BIGINT)), '') AS x, coalesce(string_agg(l.h, '' ORDER BY l.i) FILTER (l.i > p.pos // CAST(pow(3, l.level) AS BIGINT)), '') AS y
  FROM placed p JOIN lows l ON l.sid = p.sid AND l.n > 1 AND l.i // 3 = p.pos // CAST(pow(3, l.level + 1) AS BIGINT) GROUP BY ALL
  UNION ALL
  SELECT p.sid, p.pos, s.level + g.level, coalesce(string_agg(g.h, '' ORDER BY g.i) FILTER (g.i < p.sid // CAST(pow(3, g.level) AS BIGINT)), ''), coalesce(string_agg(g.h, '' ORDER BY g.i) FILTER (g.i > p.sid // CAST(pow(3, g.level) AS BIGINT)), '')
  FROM placed p JOIN sub s ON s.sid = p.sid JOIN highs g ON g.n > 1 AND g.i // 3 = p.sid // CAST(pow(3, g.level + 1) AS BIGINT) GROUP BY p.sid, p.pos, s.level, g.level),
proofs AS (SELECT sid, pos, sha256(string_agg(x || y, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY 1, 2),
walk AS (SELECT sid, pos, 0 AS step, tampered AS h FROM placed UNION ALL SELECT w.sid, w.pos, w.step + 1, sha256(s.x || w.h || s.y) FROM walk w JOIN steps s USING (sid, pos, step)),
ends AS (SELECT sid, pos, arg_max(h, step) AS folded_root FROM walk GROUP BY 1, 2)
SELECT doc_id, leaf, sub.h AS subroot, r.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = r.h AS verified
FROM placed JOIN sub USING (sid) JOIN ends USING (sid, pos) LEFT JOIN proofs USING (sid, pos), (SELECT h FROM highs WHERE n = 1) r
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


REGISTRY = {
    "op1_decontaminate": (op1_decontaminate, OP1_SQL),
    "op2_licences": (op2_licences, licences.sql()),
    "op3_bpe": (op3_bpe, None),
    "op4_quality": (op4_quality, None),
    "op5_language": (op5_language, None),
    "op6_chat": (op6_chat, OP6_SQL),
    "op7_secrets": (op7_secrets, None),
    "op8_quality_rules": (op8_quality_rules, None),
    "op9_simhash": (op9_simhash, None),
    "op10_url_filter": (op10_url_filter, OP10_SQL),
    "op11_collocations": (op11_collocations, OP11_SQL),
    "op12_merkle": (op12_merkle, OP12_SQL),
    "op13_toxicity": (op13_toxicity, None),
}
