"""The queries op1 to op10 and pipeline over the driver's tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, line_dedup, quality, sstable, substring, token_counts, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 4), ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
c AS (SELECT doc_id, text, w, l, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
  coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * (length(text) - length(replace(text, '!', ''))) > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 3 * n_words OR word_chars > 12 * n_words
  OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) > 9 * n_lines OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * n_lines
  OR 2 * len(list_filter(w, lambda x: regexp_matches(x, '^[^A-Za-z]*[A-Z][A-Z]+[^a-z]*$'))) > n_words) AS kept
FROM b
"""


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"), window=35, batches=3).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, hash(array_to_string(list_slice(w, s, s + 34), ' ')) AS h, md5(array_to_string(list_slice(w, s, s + 34), ' ')) AS t FROM (SELECT *, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
twice AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY h, t) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM twice),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.verdicts(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


#: Words of an item or a document, and its windows as strings with their places.
_OP5_SQL = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS lower),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), upper, lower), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, letters),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), upper, lower), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, letters),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, s, s + 12), ' ') AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS t FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw USING (n, t)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


_OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 3), ' ') AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 2))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
often AS (SELECT t FROM sh GROUP BY t HAVING count(*) > 1),
common AS (SELECT * FROM sh SEMI JOIN often USING (t)),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM common x JOIN common y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


URL_RULES = [urls.Rule("com", "/en/", "block"), urls.Rule("example.com", "/en/7", "allow"), urls.Rule("net", "/de/", "allow"), urls.Rule("example.net", "/de/8", "block"), urls.Rule("org", "/es/", "block")]
#: Where no rule above fits: hosts whose names say what they are.
BLOCK_GLOBS = [("*cheap-pills*", "*"), ("*spam-farm*", "*")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES, BLOCK_GLOBS)


_OP7_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
r AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host LIKE '%cheap-pills%' OR host LIKE '%spam-farm%' THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model, threshold=0.3)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=2, with_lengths=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), "longest_run")


def op10_line_dedup_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_line_dedup in which a line of 50 words or more is a run by itself."""
    out = line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=2, long_words=50)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_OP10_SQL = r"""
WITH a AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
f AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS filled FROM a),
n AS (SELECT *, sum(CAST(filled AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f),
pairs AS (SELECT doc_id, n, line, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS next FROM n WHERE filled),
later AS (SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, n) AS k FROM pairs WHERE next IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest([n, n + 1]) AS n FROM later),
same AS (SELECT a.doc_id, a.n, b.doc_id AS other, b.n - a.n AS gap FROM n a JOIN n b ON a.filled AND b.filled AND a.line = b.line AND (a.doc_id <> b.doc_id OR a.n <> b.n)),
runs AS (SELECT doc_id, count(*) AS c FROM (SELECT *, n - row_number() OVER (PARTITION BY doc_id, other, gap ORDER BY n) AS island FROM same) GROUP BY doc_id, other, gap, island HAVING count(*) >= 2),
longest AS (SELECT doc_id, max(c) AS c FROM runs GROUP BY doc_id)
SELECT n.doc_id, coalesce(any_value(longest.c), 0) AS longest_run, CAST(count(*) FILTER (WHERE filled) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE filled AND gone.n IS NOT NULL) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT filled OR gone.n IS NULL), '')) AS kept_sha256
FROM n LEFT JOIN gone ON n.doc_id = gone.doc_id AND n.n = gone.n LEFT JOIN longest ON longest.doc_id = n.doc_id GROUP BY n.doc_id
"""


_OP10_LONG_SQL = r"""
WITH a AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
f AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS filled FROM a),
n AS (SELECT *, sum(CAST(filled AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f),
pairs AS (SELECT doc_id, n, line, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS next FROM n WHERE filled),
later AS (SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, n) AS k FROM pairs WHERE next IS NOT NULL) WHERE k > 1),
long AS (SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) AS k FROM n WHERE filled AND len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50) WHERE k > 1),
gone AS (SELECT doc_id, unnest([n, n + 1]) AS n FROM later UNION SELECT doc_id, n FROM long)
SELECT n.doc_id, CAST(count(*) FILTER (WHERE filled) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE filled AND gone.n IS NOT NULL) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT filled OR gone.n IS NULL), '')) AS kept_sha256
FROM n LEFT JOIN gone ON n.doc_id = gone.doc_id AND n.n = gone.n GROUP BY n.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_bpe_codec, op3_substring_dedup, op4_token_counts, op5_decontaminate, op6_ngram_jaccard, op7_url_filter, op8_toxicity, op9_token_shards, op10_line_dedup, op10_line_dedup_long)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": _OP1_SQL, "op10_line_dedup": _OP10_SQL, "op10_line_dedup_long": _OP10_LONG_SQL, "op3_substring_dedup": _OP3_SQL, "op5_decontaminate": _OP5_SQL, "op6_ngram_jaccard": _OP6_SQL, "op7_url_filter": _OP7_SQL}
