"""Queries over cleaning, text, links, dedup and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical, relational, stats, validation
from .tables import query, table

def _titles(spark, sf_dir):
    """doc_id, title (the first line), description (the next line), class (source)."""
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.get(lines, 0).alias("title"), F.coalesce(F.get(lines, 1), F.lit("")).alias("description"), F.col("source").alias("class"), "lang")


_TITLES = "titles AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 2) AS description, source AS class, lang FROM documents)"


@query(f"""WITH {_TITLES} SELECT title, description, class, min(doc_id) AS doc_id FROM titles
WHERE title IS NOT NULL AND class IS NOT NULL AND trim(title) <> '' AND trim(description) <> '' AND NOT starts_with(title, 'The') GROUP BY ALL""")
def clean_documents(spark, sf_dir):
    rows = _titles(spark, sf_dir).na.drop(how="any", subset=["title", "class"]).na.drop(how="all", subset=["title", "description"])
    rows = rows.where((F.trim("title") != "") & (F.trim("description") != "") & ~F.startswith("title", F.lit("The")))
    return rows.groupBy("title", "description", "class").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def exact_dedup_keep_first(spark, sf_dir):
    digests = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return digests.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT DISTINCT role, length(text) > 200 AS long_text FROM conversations")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("role", (F.char_length("text") > 200).alias("long_text")).dropDuplicates()


@query(f"""WITH {_TITLES}, f AS (SELECT class, CASE WHEN regexp_matches(title, '[A-Za-z]') THEN 'english' ELSE 'other' END AS style, regexp_replace(title, '[^\\p{{L}}]', '', 'g') AS letters,
  regexp_matches(title, '[0-9]') AS digit, title = description AS same, len(list_filter(regexp_split_to_array(trim(title), '\\s+'), lambda x: x <> '')) AS wt, len(list_filter(regexp_split_to_array(trim(description), '\\s+'), lambda x: x <> '')) AS wd FROM titles)
SELECT class, count(*) AS n_examples, 0.0::DOUBLE AS pct_greek, round(100 * avg(CAST(style = 'english' AS INT)), 2) AS pct_english, 0.0::DOUBLE AS pct_mixed, round(100 * avg(CAST(style = 'other' AS INT)), 2) AS pct_other,
  round(100 * avg(CAST(letters <> '' AND letters = upper(letters) AS INT)), 2) AS pct_uppercase, round(100 * avg(CAST(digit AS INT)), 2) AS pct_digit, round(100 * avg(CAST(same AS INT)), 2) AS pct_same,
  round(median(wt), 1) AS median_title_words, round(median(wd), 1) AS median_description_words FROM f GROUP BY class""")
def style_profile(spark, sf_dir):
    return stats.style_profile(_titles(spark, sf_dir), "class", "title", "description")


@query("""SELECT p_partkey AS part_id, replace(replace(p_name, 'green', 'verdant'), 'red', 'crimson') AS name, p_name <> replace(replace(p_name, 'green', 'verdant'), 'red', 'crimson') AS changed,
  CASE p_brand WHEN 'Brand#11' THEN 'house' WHEN 'Brand#12' THEN 'house' ELSE p_brand END AS brand, CASE p_size % 3 WHEN 0 THEN '10' WHEN 1 THEN '20' END AS size_code, CAST(NULL AS VARCHAR) AS note, 'catalog' AS origin FROM part""")
def value_map_rename(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size").withColumnsRenamed({"p_partkey": "part_id", "p_name": "name", "p_brand": "brand"})
    rows = validation.replaced(rows, ["name"], {"green": "verdant", "red": "crimson"}).replace({"Brand#11": "house", "Brand#12": "house"}, subset=["brand"])
    code = validation.coded((F.col("p_size") % 3).cast("string"), {"0": 10, "1": 20})
    return rows.select("part_id", "name", "changed", "brand", code.cast("string").alias("size_code"), F.lit(None).cast("string").alias("note"), F.lit("catalog").alias("origin"))


@query(r"""WITH k AS (SELECT doc_id, replace(lower(trim(text)), 'ß', 'ss') AS folded, lower(text) AS low FROM documents)
SELECT doc_id, md5(trim(regexp_replace(translate(strip_accents(folded), '‐‑‒–—−"«»', '------   '), '\s+', ' ', 'g'))) AS key_a, md5(trim(regexp_replace(strip_accents(folded), '\s+', ' ', 'g'))) AS key_b,
  md5(trim(regexp_replace(folded, '\s+', ' ', 'g'))) AS key_c, md5(trim(regexp_replace(low, '\s+', ' ', 'g'))) AS key_d FROM k""")
def text_key_normalize(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.text_key(text)).alias("key_a"), F.md5(T.plain_text_key(text)).alias("key_b"), F.md5(T.caseless_key(text)).alias("key_c"), F.md5(T.lower_key(text)).alias("key_d"))


_GREEK = [("  «Κτίριο» – Α ", "laptop computers", "Laptop Dell"), ("εξοπλισμός", "eksoplismos", "ΟΔΟΣ"), ("κτιρίου και", "κτίρια", ""), ("λογιστικό", "λογισμικό", "pos")]
_GREEK_SQL = "(VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(_GREEK)) + ") AS g(id, a, b, c)"


@query(f"""SELECT id, list_extract(['κτιριο - α', 'εξοπλισμοσ', 'κτιριου και', 'λογιστικο'], id + 1) AS key_a, list_extract(['«κτιριο» – α', 'εξοπλισμοσ', 'κτιριου και', 'λογιστικο'], id + 1) AS key_b,
  list_extract([0.0, 1.0, 1.0, 0.0], id + 1)::DOUBLE AS score_ab, list_extract([0.5, 0.0, 0.0, 0.0], id + 1)::DOUBLE AS score_bc, list_extract(['mixed', 'mixed', 'greek', 'greek'], id + 1) AS style FROM {_GREEK_SQL}""")
def greek_fixtures(spark, sf_dir):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(_GREEK)], "id int, a string, b string, c string")
    words = rows.select("id", "a", "b", "c", *[T.normalized_words(T.tokens(F.col(c))).alias(f"w{c}") for c in "abc"])
    return words.select("id", T.text_key(F.col("a")).alias("key_a"), T.plain_text_key(F.col("a")).alias("key_b"), T.overlap_score(F.col("wa"), F.col("wb")).alias("score_ab"), T.overlap_score(F.col("wb"), F.col("wc")).alias("score_bc"), T.language_style(F.concat("a", "b")).alias("style"))


def _latin_sql(e: str) -> str:
    for a, b in T.LATIN_SPELLINGS:
        e = f"replace({e}, '{a}', '{b}')"

    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        e = f"regexp_replace({e}, '{c}{c}+', '{c}', 'g')"
    return e


_LEXICAL = f"""
texts AS (SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'i', item_id, coalesce(text, '') FROM benchmark),
raw AS (SELECT DISTINCT kind, id, unnest(regexp_extract_all(strip_accents(replace(lower(t), 'ß', 'ss')), '[a-z0-9]+')) AS x FROM texts),
spelled AS (SELECT x, {_latin_sql('x')} AS w FROM (SELECT DISTINCT x FROM raw)),
kept AS (SELECT DISTINCT kind, id, w FROM raw JOIN spelled USING (x) WHERE length(w) >= 2 AND w NOT IN (SELECT unnest(__STOP__))),
sized AS (SELECT kind, id, w, count(*) OVER (PARTITION BY kind, id) AS n FROM kept),
vocabulary AS (SELECT DISTINCT kind, w, left(w, 5) AS begin FROM kept),
same AS (SELECT a.w AS wa, b.w AS wb FROM vocabulary a JOIN vocabulary b ON a.kind = 'd' AND b.kind = 'i' AND a.begin = b.begin
  WHERE CASE WHEN least(length(a.w), length(b.w)) < 5 THEN a.w = b.w ELSE left(a.w, greatest(5, CAST(ceil(7 * least(length(a.w), length(b.w)) / 10) AS INT))) = left(b.w, greatest(5, CAST(ceil(7 * least(length(a.w), length(b.w)) / 10) AS INT))) END),
m AS (SELECT a.id AS doc_id, b.id AS item_id, a.n AS nd, b.n AS ni, count(DISTINCT wa) AS ca, count(DISTINCT wb) AS cb FROM sized a JOIN same ON a.kind = 'd' AND a.w = wa JOIN sized b ON b.kind = 'i' AND b.w = wb GROUP BY ALL),
lexical AS (SELECT doc_id, item_id, round(CASE WHEN nd <= ni THEN ca / nd ELSE cb / ni END, 6) AS score FROM m)"""


_LEXICAL = _LEXICAL.replace("__STOP__", "[" + ", ".join(f"'{w}'" for w in T.stop_words()) + "]")


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text"


@query(f"WITH {_LEXICAL} SELECT doc_id, item_id, score FROM lexical")
def lexical_overlap(spark, sf_dir):
    """Whole texts against all items; pairs that it lacks score 0."""
    return lexical.overlap(*_texts(spark, sf_dir))


@query(f"""WITH {_LEXICAL}, bands AS (SELECT CASE WHEN score = 0 THEN '= 0' WHEN score < 0.1 THEN '0–0.1' ELSE '>= 0.1' END AS band, count(*) AS n FROM lexical GROUP BY 1
UNION ALL SELECT '= 0', (SELECT count(*) FROM documents) * (SELECT count(*) FROM benchmark) - (SELECT count(*) FROM lexical)) SELECT band, CAST(sum(n) AS BIGINT) AS n FROM bands GROUP BY band HAVING sum(n) > 0""")
def lexical_band_counts(spark, sf_dir):
    """All pairs of whole texts and items; the pairs that score 0 are what is left."""
    scores = lexical.score_counts(*_texts(spark, sf_dir)).groupBy(T.lexical_band(F.col("score")).alias("band")).agg(F.sum("n").alias("n"))
    counted = lambda name: table(spark, sf_dir, name).agg(F.count("*").alias(name))
    total = counted("documents").crossJoin(counted("benchmark")).select(F.lit("= 0").alias("band"), (F.col("documents") * F.col("benchmark")).alias("n"))  # one row
    scores = scores.where("band <> '= 0'")
    zero = total.union(scores.select(F.lit("= 0"), -F.col("n"))).groupBy("band").agg(F.sum("n").alias("n")).where("n > 0")
    return scores.union(zero)


@query("""SELECT doc_id, list_filter([CASE WHEN lower(trim(lang)) IN ('fr', 'es') THEN 'lang' END, CASE WHEN lower(trim(source)) IN ('fr', 'es', 'src3') THEN 'source' END], lambda x: x IS NOT NULL) AS fields,
  lower(trim(lang)) IN ('fr', 'es') OR source = 'src3' AS marked FROM documents""")
def marker_detection(spark, sf_dir):
    found = validation.marked_columns(["lang", "source"], ["FR", "es ", "Src3"])
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("fields")).withColumn("marked", F.size("fields") > 0)


@query("""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_nationkey END AS nk FROM supplier), n AS (SELECT n_nationkey AS nk, n_name, n_regionkey FROM nation UNION ALL SELECT NULL, 'unknown', NULL)
SELECT s_suppkey, CAST(s.nk AS VARCHAR) AS nationkey, n_name, r_name FROM s LEFT JOIN n ON s.nk IS NOT DISTINCT FROM n.nk LEFT JOIN region ON n_regionkey = r_regionkey""")
def dim_attach_left(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 10 != 0, F.col("s_nationkey")).alias("nationkey"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name", "n_regionkey")
    nations = nations.union(spark.range(1).select(F.lit(None).cast("int"), F.lit("unknown"), F.lit(None).cast("int")))
    out = relational.null_safe_join(suppliers, nations, ["nationkey"])
    return out.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", F.col("nationkey").cast("string").alias("nationkey"), "n_name", "r_name")


@query("""WITH o AS (SELECT o_orderkey, o_custkey AS k, o_orderpriority AS p, CAST(floor(o_totalprice) AS BIGINT) % 7 AS z FROM orders), c AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN c_custkey - 1 ELSE c_custkey END AS k, c_custkey FROM customer),
m AS (SELECT k, count(*) AS n, min(c_custkey) AS c_custkey FROM c GROUP BY k), j AS (SELECT o.*, coalesce(n, 0) AS n, c_custkey FROM o LEFT JOIN m USING (k)),
r AS (SELECT *, CASE WHEN z = 0 THEN 'excluded' WHEN p = '1-URGENT' THEN 'unknown' WHEN n = 0 THEN 'no match' WHEN n > 1 THEN 'several matches' END AS reason FROM j)
SELECT o_orderkey, c_custkey, CASE WHEN reason IS NOT NULL THEN reason WHEN row_number() OVER (PARTITION BY k, reason IS NULL ORDER BY o_orderkey) > 1 THEN 'duplicate' END AS reason FROM r""")
def exact_one_link_reasons(spark, sf_dir):
    """All orders against all customers, of which every fifth has the key of the one before it, so that all reasons occur."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), "o_orderpriority", (F.floor("o_totalprice") % 7).alias("z"))
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select(F.when(key % 5 == 0, key - 1).otherwise(key).alias("k"), "c_custkey")
    out = relational.link_exactly_one(orders, customers, ["k"], "c_custkey", [F.asc("o_orderkey")], F.col("z") == 0, F.col("o_orderpriority") != "1-URGENT")
    return out.select("o_orderkey", "c_custkey", "reason")


@query("""SELECT doc_id, 'reserved' AS part FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) UNION ALL SELECT doc_id, 'free' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def semi_anti_reserved(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    reserved = documents.join(labels.where("quality = 0"), "doc_id", "left_semi").withColumn("part", F.lit("reserved"))
    return reserved.union(documents.join(labels, "doc_id", "left_anti").withColumn("part", F.lit("free")))


@query("""WITH r AS (SELECT o_custkey AS client, o_orderkey % 20 AS one, o_orderpriority AS two FROM orders), k AS (SELECT o_custkey AS client, o_orderkey % 20 AS one, o_orderpriority AS two FROM orders WHERE o_orderstatus = 'F')
SELECT client, one, two, count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.client = r.client AND k.one = r.one) AND NOT EXISTS (SELECT 1 FROM k WHERE k.client = r.client AND k.two = r.two) GROUP BY ALL""")
def anti_either_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("client"), (F.col("o_orderkey") % 20).alias("one"), F.col("o_orderpriority").alias("two"), "o_orderstatus")
    return relational.anti_either(rows, rows.where("o_orderstatus = 'F'"), "client", "one", "two").groupBy("client", "one", "two").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id END AS wanted, md5(text) AS t FROM documents), f AS (SELECT md5(text) AS t, min(doc_id) AS first FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT doc_id, coalesce(i.doc_id2, first, -1) AS matched_id, CASE WHEN i.doc_id2 IS NOT NULL THEN 'id' WHEN first IS NOT NULL THEN 'text' END AS method FROM l LEFT JOIN (SELECT doc_id AS doc_id2 FROM documents WHERE doc_id % 2 = 0) i ON wanted = doc_id2 LEFT JOIN f USING (t)""")
def coalesced_match(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("t"))
    right = rows.where("doc_id % 2 = 0").select(F.col("doc_id").alias("wanted"), "t")
    left = rows.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(-1)).otherwise(F.col("doc_id")).alias("wanted"), "t")
    return relational.coalesced_match(left, right, "wanted", ["t"], [F.asc("wanted")]).select("doc_id", F.coalesce("matched_id", F.lit(-1)).alias("matched_id"), "method")


@query("SELECT source, lang, min(doc_id) AS least_id, count(*) AS n FROM documents GROUP BY ALL")
def least_id_fallback(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))


@query("""SELECT a.conv_id, a.turn AS one, b.turn AS two FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND (CASE WHEN a.turn % 4 = 3 THEN NULL ELSE a.role END) IS NOT DISTINCT FROM (CASE WHEN b.turn % 4 = 3 THEN NULL ELSE b.role END) AND a.turn < b.turn""")
def context_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("turn") % 4 != 3, F.col("role")).alias("role"), "turn")
    one = rows.select("conv_id", "role", F.col("turn").alias("one"))
    two = rows.select("conv_id", "role", F.col("turn").alias("two"))
    return relational.null_safe_join(one, two, ["conv_id", "role"], "inner").where("one < two").select("conv_id", "one", "two")


@query("SELECT md5(text) AS t, min(lang) AS low, max(lang) AS high, count(*) AS n_rows FROM (SELECT text, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE lang END AS lang FROM documents) GROUP BY text HAVING min(lang) <> max(lang)")
def label_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.md5("text").alias("t"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("lang")).alias("lang"))
    return relational.conflicts(rows, ["t"], "lang")


@query("SELECT doc_id FROM (SELECT doc_id, min(l) OVER (PARTITION BY text) AS a, max(l) OVER (PARTITION BY text) AS b FROM (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE lang END AS l FROM documents)) WHERE a = b")
def conflicting_groups_dropped(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("t"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("lang")).alias("lang"))
    return relational.drop_conflicts(rows, ["t"], "lang").select("doc_id")


@query("SELECT md5(text) AS t, doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY CASE source WHEN 'src7' THEN 1 WHEN 'src3' THEN 2 ELSE 3 END, doc_id) = 1")
def priority_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.md5("text").alias("t"), "doc_id", "source")
    return relational.priority_dedup(rows, ["t"], "source", ["src7", "src3"], [F.asc("doc_id")])


@query("""SELECT 0::BIGINT AS repeated_left, 0::BIGINT AS repeated_right, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS left_without, 0::BIGINT AS right_without, (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE CAST(n_chars > 1000 AS INT) <> quality) AS disagree""")
def join_decisions_validated(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("quality"))
    return relational.join_validated(documents, table(spark, sf_dir, "labels"), "doc_id", ["quality"])[1]


@query("SELECT doc_id, format('F{:05d}', row_number() OVER (ORDER BY doc_id DESC)) AS id FROM documents")
def sequential_ids(spark, sf_dir):
    return relational.padded_ids(table(spark, sf_dir, "documents").select("doc_id"), "F", 5, [F.desc("doc_id")])


@query(f"""WITH {_TITLES}, m AS (SELECT doc_id, trim(regexp_replace(lower(CASE WHEN doc_id % 11 = 0 THEN '' ELSE title END), '\\s+', ' ', 'g')) AS t, trim(regexp_replace(lower(description), '\\s+', ' ', 'g')) AS d, CASE WHEN doc_id % 13 = 0 THEN 'src99' ELSE class END AS c FROM titles WHERE doc_id % 2 = 0),
r AS (SELECT trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS t, trim(regexp_replace(lower(description), '\\s+', ' ', 'g')) AS d, class AS c FROM titles WHERE doc_id % 2 = 1),
f AS (SELECT doc_id, t = '' OR d = '' OR c = '' AS has_empty_field, c NOT IN (SELECT c FROM r) AS invalid_expense_class, doc_id > min(doc_id) OVER (PARTITION BY t, d, c) AS duplicate_synthetic, EXISTS (SELECT 1 FROM r WHERE r.t = m.t AND r.d = m.d AND r.c = m.c) AS exact_real_copy FROM m),
g AS (SELECT *, concat_ws('; ', CASE WHEN has_empty_field THEN 'empty required field' END, CASE WHEN invalid_expense_class THEN 'unknown expense class' END, CASE WHEN duplicate_synthetic THEN 'duplicate synthetic example' END, CASE WHEN exact_real_copy THEN 'exact copy of real example' END) AS s FROM f)
SELECT doc_id, has_empty_field, invalid_expense_class, duplicate_synthetic, exact_real_copy, s = '' AS static_valid, CASE WHEN s = '' THEN 'ok' ELSE s END AS static_reason FROM g""")
def static_validation(spark, sf_dir):
    rows = _titles(spark, sf_dir)
    made = rows.where("doc_id % 2 = 0").withColumns({"title": F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("title")), "class": F.when(F.col("doc_id") % 13 == 0, "src99").otherwise(F.col("class"))})
    out = validation.static_validate(made, rows.where("doc_id % 2 = 1"), "title", "description", "class", "doc_id")
    return out.select("doc_id", "has_empty_field", "invalid_expense_class", "duplicate_synthetic", "exact_real_copy", "static_valid", "static_reason")


@query(f"""WITH {_TITLES} SELECT doc_id, CASE WHEN trim(title) = '' OR trim(description) = '' THEN 'INVALID' WHEN class <> (CASE WHEN doc_id % 6 = 0 THEN 'src1' ELSE class END) THEN 'INVALID' WHEN doc_id % 4 = 1 THEN 'UNCERTAIN' WHEN lang = 'de' THEN 'UNCERTAIN' END AS verdict FROM titles""")
def decision_chain_positive(spark, sf_dir):
    rows = _titles(spark, sf_dir).withColumns({"other": F.when(F.col("doc_id") % 6 == 0, "src1").otherwise(F.col("class")), "key": F.when(F.col("doc_id") % 4 == 1, "x").otherwise(F.col("doc_id").cast("string")), "context": F.when(F.col("lang") == "de", " ").otherwise(F.col("lang"))})
    return rows.select("doc_id", validation.positive_check(["title", "description"], "class", "other", "key", ["context"]).alias("verdict"))


@query(f"""WITH {_TITLES} SELECT doc_id, CASE WHEN trim(title) = '' OR trim(description) = '' OR lang = 'es' THEN 'UNCERTAIN' END AS verdict FROM titles""")
def decision_chain_negative(spark, sf_dir):
    rows = _titles(spark, sf_dir).withColumn("class", F.when(F.col("lang") == "es", "").otherwise(F.col("class")))
    return rows.select("doc_id", validation.negative_check(["title", "description"], "class", "class").alias("verdict"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'reject_static' WHEN doc_id % 7 = 0 THEN 'validation_error' WHEN quality = 0 THEN 'reject_semantic' WHEN (doc_id % 100) / 100.0 < 0.8 THEN 'manual_review' ELSE 'pass' END AS status FROM labels""")
def status_cascade(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 5 != 0).alias("static_valid"), F.when(F.col("doc_id") % 7 == 0, "timeout").alias("semantic_error"), (F.col("quality") == 1).alias("semantic_valid"), ((F.col("doc_id") % 100) / 100).alias("semantic_confidence"))
    return rows.select("doc_id", validation.validation_status().alias("status"))


@query("""SELECT count(*) FILTER (WHERE NOT l_quantity > 0) AS bad_quantity, count(*) FILTER (WHERE NOT l_discount <= 0.05) AS high_discount,
  (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 > 0)) AS orphans, (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)) AS repeated,
  (SELECT count(*) FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier))) AS shared FROM lineitem""")
def expectation_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount")
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0")
    one = validation.expectations(lines, {"bad_quantity": F.col("l_quantity") > 0, "high_discount": F.col("l_discount") <= 0.05})
    counted = lambda df, name: df.agg(F.count("*").alias(name))
    shared = validation.shared_keys(lines, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), ["l_suppkey"])
    return one.crossJoin(counted(validation.missing_references(lines, "l_orderkey", orders, "o_orderkey"), "orphans")).crossJoin(counted(validation.repeated_keys(lines, ["l_orderkey", "l_linenumber"]), "repeated")).crossJoin(counted(shared, "shared"))  # one-row tables


@query("""WITH v(id, title, description, category, subcategory, ce, pe, decision) AS (VALUES (1, 'Αγορά laptop', 'για γραφείο', 'IT', 'laptops', 'laptop!', 'it laptops', 'DIRECT'), (2, 'Chair', '', 'Office', 'chairs', 'table', 'CHAIRS', 'NO'), (3, 'Chair', 'blue', 'Office', 'chairs', '', 'desk', 'DIRECT'), (4, 'Chair', 'blue', 'Office', 'chairs', '', 'office', 'NO'))
SELECT id, list_extract(['', 'client_evidence not verbatim', 'client_evidence missing; program_evidence not verbatim', ''], id) AS problem, list_extract(['Match', 'No match', 'Match', 'No match'], id) AS label FROM v""")
def evidence_check(spark, sf_dir):
    rows = [(1, "Αγορά laptop", "για γραφείο", "IT", "laptops", "laptop!", "it laptops", "DIRECT"), (2, "Chair", "", "Office", "chairs", "table", "CHAIRS", "NO"), (3, "Chair", "blue", "Office", "chairs", "", "desk", "DIRECT"), (4, "Chair", "blue", "Office", "chairs", "", "office", "NO")]
    df = spark.createDataFrame(rows, "id int, title string, description string, category string, subcategory string, ce string, pe string, decision string")
    return df.select("id", validation.evidence_problem(["title", "description"], ["category", "subcategory"], "ce", "pe", "decision").alias("problem"), validation.decision_label(F.col("decision"), F.lit("positive")).alias("label"))


@query("""SELECT doc_id, left(sha256('text=' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || chr(31) || 'lang=' || lang || chr(31)), 24) AS fingerprint, left(sha256(lang || chr(10) || '<<prompt-file-boundary>>' || chr(10)), 16) AS prompt_hash FROM documents""")
def pair_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint({"text": F.col("text"), "lang": F.col("lang")}).alias("fingerprint"), T.prompt_hash(F.col("lang")).alias("prompt_hash"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'Event ' || event_type || ' of user ' || user_id AS line, '[' || user_id || ']' AS ids FROM events""")
def json_reply_parse(spark, sf_dir):
    from ..operators.external import parse_reply

    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.concat(F.lit("```json\n"), "props", F.lit("\n```")).alias("reply"))
    parsed = parse_reply(rows, "reply", "k bigint")
    return parsed.select("event_id", "parsed.k", T.template("Event {type} of user {user}", type=F.col("event_type"), user=F.col("user_id")).alias("line"), F.to_json(F.array("user_id")).alias("ids"))


@query("""SELECT * FROM (VALUES (0, true, true, '3'), (1, true, true, NULL), (2, true, false, NULL), (3, false, false, '0')) AS v(id, agreed, flagged, number)""")
def value_parsers(spark, sf_dir):
    rows = spark.createDataFrame([(0, "True", "true", "3.7"), (1, "1.0", "Yes", "x"), (2, "", "", ""), (3, "false", "maybe", "0")], "id int, a string, b string, n string")
    return rows.select("id", T.agreement(F.col("a")).alias("agreed"), T.lenient_boolean(F.col("b")).alias("flagged"), T.to_int_or_none(F.col("n")).cast("string").alias("number"))


@query("""SELECT doc_id, quality, toxic, row_number() OVER (ORDER BY CASE WHEN quality = 1 - toxic THEN 0 ELSE 1 END, source, doc_id) AS place FROM labels JOIN documents USING (doc_id) QUALIFY place <= 50""")
def review_order(spark, sf_dir):
    """A report of the first 50 rows to review, agreements first."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    top = rows.orderBy(F.when(F.col("quality") == 1 - F.col("toxic"), 0).otherwise(1), "source", "doc_id").limit(50)
    place = F.expr("row_number() OVER (ORDER BY CASE WHEN quality = 1 - toxic THEN 0 ELSE 1 END, source, doc_id)").cast("bigint")  # 50 rows
    return top.select("doc_id", "quality", "toxic", place.alias("place"))


@query("SELECT r_regionkey AS id, r_name AS name, CAST(NULL AS VARCHAR) AS region FROM region UNION ALL SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) FROM nation")
def union_fill_missing(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    return regions.unionByName(nations, allowMissingColumns=True)


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def key_intersection(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("""SELECT grp, key, value FROM (VALUES (1, 'Title', 'second'), (1, 'Description', 'about'), (2, 'Title', 'other')) AS v(grp, key, value)""")
def metadata_cells(spark, sf_dir):
    from ..sources.tables import metadata

    cells = [(1, 0, 0, " Title "), (1, 0, 1, "first"), (1, 1, 0, "Description"), (1, 1, 1, "about"), (1, 2, 1, "Title"), (1, 2, 2, "second"), (2, 0, 0, "Title"), (2, 0, 1, "other"), (2, 1, 0, "Note"), (2, 1, 1, "n")]
    return metadata(spark.createDataFrame(cells, "grp int, row int, col int, value string"), "grp", "row", "col", "value", ["Title", "Description"])
