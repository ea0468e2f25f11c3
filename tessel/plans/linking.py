"""Queries over links between tables, keys, caches and workbooks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks, external, ranking, relational, splitting, validation
from ..scratch import new_path
from ..sources import tables, workbook
from .tables import RANKED, per_client, query, table


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, s_nationkey AS nation FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey),
g AS (SELECT l_orderkey, arg_min(struct_pack(n := nation), l_linenumber).n AS first_one, CASE WHEN bool_and(nation IS NOT NULL) AND min(nation) = max(nation) THEN min(nation) END AS only_one FROM l GROUP BY l_orderkey)
SELECT o_orderkey, CAST(first_one AS VARCHAR) AS first_nation, CAST(only_one AS VARCHAR) AS only_nation FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""")
def two_hop_links(spark, sf_dir):
    """Orders through their lines to the suppliers' nations: by the first line, and where all lines agree. Of lines with the same
    number the first in the table is the first, as it is in the SQL; lines without a number are no first lines."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    order = [F.asc("l_linenumber"), F.asc("file"), F.asc("row")]
    link = lambda rows, middle, name, **more: relational.link_two_hops(rows, middle, suppliers, ["l_orderkey"], ["l_suppkey"], "s_nationkey", order, **more).withColumnRenamed("s_nationkey", name)
    out = link(link(orders, lines.where("l_linenumber IS NOT NULL"), "first_nation"), lines, "only_nation", unanimous=True)
    return out.select(F.col("l_orderkey").alias("o_orderkey"), F.col("first_nation").cast("string").alias("first_nation"), F.col("only_nation").cast("string").alias("only_nation"))


@query("""SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS repeated_left, (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)) AS repeated_right, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS unmatched""")
def indicated_join_counts(spark, sf_dir):
    return relational.join_indicated(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])[1]


@query("SELECT doc_id, labels.doc_id IS NOT NULL AS matched FROM documents LEFT JOIN labels USING (doc_id)")
def indicated_join(spark, sf_dir):
    joined, _ = relational.join_indicated(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])
    return joined.select("doc_id", "matched")


@query("SELECT doc_id, lang, quality, length(text) AS n FROM documents JOIN labels USING (doc_id)")
def three_way_join(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return relational.join_all([documents.select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"), documents.select("doc_id", F.char_length("text").cast("bigint").alias("n"))], ["doc_id"])


@query("WITH n AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) + 1 AS sheet_row FROM nation) SELECT s_suppkey, n_name FROM supplier JOIN n ON sheet_row - 2 = s_nationkey")
def positional_join(spark, sf_dir):
    """Suppliers joined with nations by the place of a row below a header: the first row of data is row 2."""
    nations = relational.numbered(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), [F.asc("n_nationkey")], "sheet_row", 2)
    return table(spark, sf_dir, "supplier").join(nations.withColumn("place", F.col("sheet_row") - 2), F.col("place") == F.col("s_nationkey")).select("s_suppkey", "n_name")


@query("""WITH p AS (SELECT a.vec_id AS client_id, b.vec_id AS candidate_id, round(greatest(-1, least(1, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 9) AS s, unnest(CASE WHEN a.vec_id % 4 = b.vec_id % 4 THEN ['class', 'class+source'] ELSE ['class'] END) AS scope
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT client_id, candidate_id, scope, row_number() OVER (PARTITION BY client_id, scope ORDER BY s DESC, candidate_id) AS rank FROM p""")
def candidate_scopes(spark, sf_dir):
    """Ranks of the candidates of a class, and of those of the same source (a remainder of the identifier) alone."""
    rows = table(spark, sf_dir, "embeddings").withColumn("source", F.col("vec_id") % 4)

    def plain(marked):
        pairs = ranking.scoped_pairs(marked, "vec_id", "label", "source", "embedding", marked.where("__client"))
        rank = F.expr("row_number() OVER (PARTITION BY client_id, scope ORDER BY similarity DESC, candidate_id)").cast("bigint")
        return pairs.select("client_id", "candidate_id", "scope", rank.alias("rank"))

    return blocks.by_client(rows, "vec_id", "label", "embedding", blocks.scopes(), "client_id {id}, candidate_id {id}, scope string, rank bigint", plain, "source")


@query(f"WITH {RANKED} SELECT client_id, candidate_id, round(similarity, 6) AS similarity, distance_rank FROM ranked WHERE distance_rank <= 10")
def nearest_in_class(spark, sf_dir):
    plain = lambda rows: ranking.top_k(rows, 10).select("client_id", "candidate_id", F.round("similarity", 6).alias("similarity"), "distance_rank", F.col("distance_rank").alias("rank"))
    return per_client(spark, sf_dir, blocks.nearest(10, None, 6), "client_id {id}, candidate_id {id}, similarity double, distance_rank bigint, rank bigint", plain).drop("rank")


@query("SELECT source, doc_id, position FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS position FROM documents) WHERE position <= 10")
def first_chunk_per_class(spark, sf_dir):
    return ranking.first_chunks(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.asc("doc_id")], 10).select("source", "doc_id", "position")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'toxic ' || toxic WHEN doc_id % 7 = 1 THEN NULL ELSE 'quality ' || quality END AS label FROM labels")
def label_precedence(spark, sf_dir):
    """A manual label (of every third row; blank for the others) before the one that stands."""
    manual = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" toxic "), "toxic")).otherwise("  ")
    standing = F.when(F.col("doc_id") % 7 != 1, F.concat(F.lit("quality "), "quality"))
    return table(spark, sf_dir, "labels").select("doc_id", validation.first_given(manual, standing).alias("label"))


@query("WITH k AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text) SELECT (SELECT count(*) FROM documents) AS n_input, (SELECT count(*) FROM k) AS n_kept, (SELECT count(*) FROM documents ANTI JOIN k USING (doc_id)) AS n_removed, true AS conserved")
def row_conservation(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("t"))
    kept = relational.keep_first(rows, ["t"], [F.asc("doc_id")])
    return validation.conservation(rows, kept, rows.join(kept, "doc_id", "left_anti"))


@query("SELECT conv_id, max(CASE role WHEN 'system' THEN 'training' WHEN 'tool' THEN 'test' END) AS split FROM conversations WHERE role IN ('system', 'tool') GROUP BY conv_id HAVING count(DISTINCT role) = 1")
def fixed_splits(spark, sf_dir):
    """Splits that some turns of a conversation fix for all of it; those whose turns disagree are left out before."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("role") == "system", "training").when(F.col("role") == "tool", "test").alias("split"))
    sound = relational.drop_conflicts(rows.where(F.col("split").isNotNull()), ["conv_id"], "split")
    return splitting.fixed_splits(sound, "conv_id", "split")


@query(r"""SELECT doc_id, md5(trim(regexp_replace(replace(lower(split_part(text, chr(10), 1)), 'ß', 'ss'), '\s+', ' ', 'g')) || chr(31) || lower(source)) AS joined_key, md5(trim(split_part(text, chr(10), 1)) || chr(31) || source) AS exact_key,
  sha256('{"id":' || doc_id || ',"lang":"' || lang || '"}') AS cache_key FROM documents""")
def key_variants(spark, sf_dir):
    first = F.get(F.split("text", "\n"), 0)
    exact = T.exact_key(first, F.col("source"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(T.joined_key(first, F.col("source"))).alias("joined_key"), F.md5(F.concat_ws("\x1f", exact["part_0"], exact["part_1"])).alias("exact_key"), T.cache_key({"lang": F.col("lang"), "id": F.col("doc_id")}).alias("cache_key")
    )


@query("""SELECT * FROM (VALUES (1, 'straße ﬁne ſ σισυφοσ', true), (2, 'ώ και ά', true), (3, 'i̇stanbul ŉ', true)) AS v(id, folded, as_python)""")
def casefold_fixtures(spark, sf_dir):
    """Full Unicode folding, beside what Python's casefold says."""
    texts = [(1, "STRAẞE ﬁne ſ ΣΙΣΥΦΟΣ"), (2, "Ώ ΚΑΙ Ά"), (3, "İstanbul ŉ")]
    rows = spark.createDataFrame([(i, t, t.casefold()) for i, t in texts], "id int, t string, python string")
    folded = T.casefold(F.col("t"))
    shown = {1: "straße ﬁne ſ σισυφοσ", 3: "i̇stanbul ŉ"}
    original = F.coalesce(F.create_map(*[F.lit(x) for kv in shown.items() for x in kv])[F.col("id")], folded)
    return rows.select("id", F.when(folded == F.col("python"), original).alias("folded"), (folded == F.col("python")).alias("as_python"))


@query("SELECT max(len(embedding)) * 0 AS wrong_size, 0::BIGINT AS not_finite, 0::BIGINT AS not_unit, 0::BIGINT AS wrong_rows, count(*) AS n FROM embeddings")
def embedding_cache_checks(spark, sf_dir):
    """Unit vectors written to a cache, replaced, read back and checked."""
    from ..functions.vector import l2_normalize

    rows, path = table(spark, sf_dir, "embeddings"), new_path(spark, "embedding-cache")
    unit = rows.select("vec_id", l2_normalize(F.col("embedding")).alias("embedding"))
    tables.write_cache(unit.where("vec_id % 2 = 0"), path)
    tables.write_cache(unit, path)
    size = rows.select(F.max(F.size("embedding"))).first()[0]
    cache, checks = external.checked_embeddings(tables.read_cache(spark, path), size, rows.count())
    return checks.crossJoin(cache.agg(F.count("*").alias("n"))).select(F.col("wrong_size").cast("bigint"), "not_finite", "not_unit", "wrong_rows", "n")  # one-row tables


@query("SELECT event_id, CAST(length(event_type) AS FLOAT) AS x FROM events")
def encoded_rows(spark, sf_dir):
    """Rows with the embedding of their text, of which each distinct one is encoded once."""
    made = external.encode_rows(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", lambda: lambda texts: [[float(len(t))] for t in texts])
    return made.select("event_id", F.col("embedding")[0].alias("x"))


@query("SELECT r_regionkey AS seed, CAST(NULL AS VARCHAR) AS issue, r_name || ' ' || i AS name FROM region, range(2) t(i) UNION ALL SELECT 0, '2 items, 3 expected', NULL")
def generated_rows(spark, sf_dir):
    """Two rows from each seed; the seed 0 expected three."""
    seeds = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("seed"), "r_name", F.when(F.col("r_regionkey") == 0, 3).otherwise(2).alias("wanted"))
    make = lambda: lambda seed: json.dumps({"items": [{"name": f"{seed['r_name']} {i}"} for i in range(2)]})
    return external.generate_rows(seeds, "seed", make, "items", ["name"], "wanted")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'MATCH' ELSE 'NO_MATCH' END AS verdict, 'guideline ' || toxic AS reason FROM labels")
def guideline_judged(spark, sf_dir):
    """Verdicts by a guideline, a call for ten rows, of which the first attempt of each call fails."""

    def make():
        calls = []

        def judge(rows):
            calls.append(len(rows))
            if len(calls) % 2:
                raise ConnectionError("busy")
            return [{"verdict": "MATCH" if r["quality"] else "NO_MATCH", "reason": f"guideline {r['toxic']}"} for r in rows]

        return judge

    return external.judge_rows(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", make, batch=10, attempts=3, wait=0.0).select("doc_id", "verdict", "reason")


@query("SELECT 'Nations' AS sheet, CAST(row_number() OVER (ORDER BY n_nationkey) + 1 AS BIGINT) AS row_in_sheet, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation UNION ALL SELECT 'Regions & more', row_number() OVER (ORDER BY r_regionkey) + 1, CAST(r_regionkey AS VARCHAR), r_name FROM region")
def workbook_round_trip(spark, sf_dir):
    """Two tables as the formatted sheets of one workbook, read back by names in another case and spacing."""
    path = new_path(spark, "workbook") + "/book.xlsx"
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    workbook.write_workbook({"Nations": nations, "Regions & more": regions}, path, overwrite=True, widths={"n_name": 30})
    one, two = workbook.read_sheet(spark, path, " nations"), workbook.read_sheet(spark, path, "REGIONS&MORE")
    named = lambda df, sheet, key, name: df.select(F.lit(sheet).alias("sheet"), "row_in_sheet", F.col(key).alias("key"), F.col(name).alias("name"))
    return named(one, "Nations", "n_nationkey", "n_name").union(named(two, "Regions & more", "r_regionkey", "r_name"))
