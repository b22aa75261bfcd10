"""Keyword, vector and hybrid search over the documents and embeddings."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, changes, keyword_index, vector_index
from ..operators import search as se
from .base import NOW, datasets, discard, query, scratch, stored, t
from .catalogue import organizations, translations

QUERIES_SQL = """q AS (SELECT item_id AS query_id, list_distinct([x for x in string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') if x <> ''][1:2]) AS terms FROM benchmark)"""
#: The nine fields of a dataset put together, by id; a query's words stand in any of them.
FIELDS_SQL = """fields AS (SELECT doc_id, concat_ws(' ', split_part(text, chr(10), 1), CASE WHEN doc_id % 3 = 0 THEN 'alpha: ' || substr(split_part(text, chr(10), 1), 1, 20) END, text, upper(source),
      CASE WHEN doc_id % 10 = 0 THEN lang END, lang, 'size:' || CAST(least(n_chars // 1000, 9) AS VARCHAR), cols, ents) AS f FROM documents
      LEFT JOIN (SELECT l_orderkey AS doc_id, string_agg(l_linenumber || l_returnflag, ' ') AS cols FROM lineitem GROUP BY 1) USING (doc_id)
      LEFT JOIN (SELECT doc_id, string_agg(label, ' ') AS ents FROM (SELECT DISTINCT l_orderkey AS doc_id, 'S' || l_suppkey AS label FROM lineitem) GROUP BY 1) USING (doc_id))"""
TOKENS_SQL = f"""{FIELDS_SQL}, tok AS (SELECT doc_id, unnest([x for x in string_split_regex(lower(f), '[^\\p{{L}}\\p{{N}}]+') if x <> '']) AS w FROM fields),
    len AS (SELECT d.doc_id, count(w) AS l FROM documents d LEFT JOIN tok t ON t.doc_id = d.doc_id GROUP BY 1), tf AS (SELECT doc_id, w, count(*) AS tf FROM tok GROUP BY 1, 2)"""
BM25_SQL = f"""{QUERIES_SQL}, {TOKENS_SQL}, qt AS (SELECT query_id, unnest(terms) AS w FROM q), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
    st AS (SELECT count(*) AS n, avg(l) AS a FROM len), sc AS (SELECT query_id, tf.doc_id, count(*) AS met,
      sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score
      FROM qt JOIN tf USING (w) JOIN df USING (w) JOIN len ON len.doc_id = tf.doc_id, st GROUP BY 1, 2),
    kw AS (SELECT query_id, doc_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc JOIN q USING (query_id) WHERE met = len(terms) QUALIFY rank <= 50)"""


def queries(spark: SparkSession, d: str) -> DataFrame:
    """The first two words of each benchmark passage."""
    words = F.slice(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != ""), 1, 2)
    return t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.array_distinct(words), " ").alias("query"))


def titles(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"))


def search_documents(spark: SparkSession, d: str) -> DataFrame:
    """The nine fields of each dataset; lines of orders are its columns and suppliers its entities."""
    line = t(spark, d, "lineitem").withColumn("dataset_id", F.col("l_orderkey").cast("string"))
    cols = line.select("dataset_id", F.col("l_linenumber").alias("position"), F.concat("l_linenumber", "l_returnflag").alias("name"))
    ents = line.select("dataset_id", F.concat(F.lit("supplier:"), "l_suppkey").alias("entity_id"), F.concat(F.lit("S"), "l_suppkey").alias("label"))
    ds = datasets(spark, d).withColumn("groups", F.array().cast("array<string>"))
    return se.search_documents(ds, catalog.first_translation(translations(spark, d)), organizations(spark, d), cols, ents)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return search_documents(spark, d).withColumn("id", F.col("id").cast("long"))


def keyword(spark: SparkSession, d: str) -> DataFrame:
    return se.keyword_search(queries(spark, d), documents(spark, d), keyword_index.FIELDS, 50)


@query(f"WITH {BM25_SQL} SELECT query_id, id, rank, round(score, 3) AS score FROM kw")
def k1_keyword(spark: SparkSession, d: str) -> DataFrame:
    return keyword(spark, d).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 3).alias("score"))


def _indexed(spark: SparkSession, d: str) -> str:
    """An index that three runs made: it began with other texts of the German documents, without the French ones and with
    copies of src5's under other ids. What an index run finds changed is replaced or added, and what isn't in the catalogue goes."""
    docs = stored(documents(spark, d).withColumn("fp", F.sha2(F.concat_ws("|", *keyword_index.FIELDS), 256)), "search-documents")
    lang, copied = F.regexp_extract("tag_labels", r"^\S*", 0), F.col("publisher_label") == "SRC5"
    old = docs.where(lang != "fr").withColumn("description_bg", F.when(lang == "de", F.reverse("description_bg")).otherwise(F.col("description_bg")))
    old = old.withColumn("fp", F.when(lang == "de", "x").otherwise(F.col("fp")))
    ghosts = docs.where(copied).withColumn("id", -1 - F.col("id"))
    path = scratch(spark, "keyword-index")
    keyword_index.build(old.unionByName(ghosts), path, 0)
    prints = lambda rows: rows.select("id", F.col("fp").alias("content_fp"), F.col("fp").alias("embed_fp"))
    known = old.select("id")
    actions = changes.index_actions(prints(docs).withColumn("embed_text", F.lit("x")), prints(old).withColumn("model_id", F.lit("m")), known, known, "m")
    todo = stored(docs.join(actions.where("keyword = 'update'").select("id"), "id", "left_semi"), "search-changed")
    was_german = F.regexp_extract("tag_labels", r"^\S*", 0) == "de"
    keyword_index.update(path, 1, todo.where(was_german))
    keyword_index.update(path, 2, todo.where(~was_german), changes.index_orphans(docs, ghosts))
    discard(docs, todo)
    return path


@query(f"WITH {BM25_SQL} SELECT state, query_id, id, rank, round(score, 3) AS score FROM kw, (VALUES ('updated'), ('merged')) s(state)")
def k1_index(spark: SparkSession, d: str) -> DataFrame:
    """The same searches over a lasting index, after runs that changed it and after those were merged."""
    path, asked = _indexed(spark, d), queries(spark, d)
    updated = stored(keyword_index.search(spark, path, asked)[0], "index-hits")
    keyword_index.merge(spark, path, 3)
    both = [x.select(F.lit(state).alias("state"), "query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 3).alias("score")) for state, x in (("updated", updated), ("merged", keyword_index.search(spark, path, asked)[0]))]
    return both[0].unionByName(both[1])


def _vec_sql(every: int) -> str:
    """SQL of the first 50 hits of each ``every``-th vector."""
    return f"""vq AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % {every} = 0), vs AS (SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM vq, embeddings),
    vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM vs QUALIFY rank <= 50)"""


VEC_SQL = _vec_sql(100)


def vector(spark: SparkSession, d: str, every: int = 100) -> DataFrame:
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return se.vector_search(e.where(f"id % {every} = 0").select(F.col("id").alias("query_id"), "vector"), e, 50)


@query(f"WITH {_vec_sql(50)} SELECT query_id, id, rank, round(score, 5) AS score FROM vec")
def k2_vector(spark: SparkSession, d: str) -> DataFrame:
    return vector(spark, d, 50).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query(f"WITH {VEC_SQL} SELECT CAST(query_id AS VARCHAR) AS query_id, 'v' || id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, 'v' || id) AS rank, round(score, 5) AS score FROM vs QUALIFY rank <= 50")
def k2_index(spark: SparkSession, d: str) -> DataFrame:
    """The same searches over a lasting index under string ids, after a run that replaced the vectors of label 1, added those of label 2 and purged the copies of label 3's."""
    e = t(spark, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("id"), F.col("embedding").alias("vector"), "vec_id", "label")
    label = F.coalesce("label", F.lit(0))
    old = e.where(label != 2).select("id", F.when(label == 1, F.reverse("vector")).otherwise(F.col("vector")).alias("vector"))
    ghosts = e.where(label == 3).select(F.concat(F.lit("ghost"), "id").alias("id"), "vector")
    path = scratch(spark, "vector-index")
    vector_index.build(old.unionByName(ghosts), path, 0)
    vector_index.update(path, 1, e.where(label.isin(1, 2)).select("id", "vector"), ghosts.select("id"))
    hits = vector_index.search(spark, path, e.where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "vector"), 50)[0]
    return hits.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


HYBRID_SQL = f"""{BM25_SQL}, {VEC_SQL}, fused AS (SELECT query_id, id, coalesce(1.0 / (60 + k.rank), 0) + coalesce(1.0 / (60 + v.rank), 0) AS score,
    CASE WHEN k.rank IS NULL THEN 'semantic' WHEN v.rank IS NULL THEN 'keyword' ELSE 'hybrid' END AS kind FROM (SELECT query_id * 100 AS query_id, id, rank FROM kw) k FULL JOIN vec v USING (query_id, id)),
    hyb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM fused QUALIFY rank <= {{top}})"""


def hybrid(spark: SparkSession, d: str, top: int) -> DataFrame:
    """Keyword query i and vector query 100 i are taken as one search."""
    k = keyword(spark, d).withColumn("query_id", F.col("query_id") * 100)
    fused = se.fuse(k, vector(spark, d), 100)
    return se.ranked(fused.select("query_id", "id", F.round("score", 12).alias("score"), "kind"), top)


@query(f"WITH {HYBRID_SQL.replace('{top}', '5')} SELECT query_id, id, kind, rank FROM hyb")
def k3_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(spark, d, 5).select("query_id", "id", "kind", F.col("rank").cast("long").alias("rank"))


@query(
    f"WITH {HYBRID_SQL.replace('{top}', '5')} SELECT query_id, id, split_part(text, chr(10), 1) AS title, CASE WHEN id % 2 = 0 AND source IS NOT NULL THEN source ELSE CAST(id AS VARCHAR) END AS path FROM hyb LEFT JOIN documents ON doc_id = id"
)
def k4_decorated(spark: SparkSession, d: str) -> DataFrame:
    arts = t(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("dataset_id"), F.concat_ws("/", "source", "doc_id").alias("path"), F.lit(1).alias("created_at"))
    return se.decorate(hybrid(spark, d, 5), titles(spark, d), arts).select("query_id", "id", "title", "path")


@query(f"WITH {HYBRID_SQL.replace('{top}', '100')} SELECT query_id, id, rank FROM hyb JOIN documents ON doc_id = id WHERE doc_id % 20 <> 0 AND lang = 'en'")
def k5_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = datasets(spark, d).where(catalog.catalogue_filter(F.lit(NOW), tags=["en"])).select(F.col("id").cast("long").alias("id"))
    return se.filtered_search(hybrid(spark, d, 100), rows).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {HYBRID_SQL.replace('{top}', '100')}, h AS (SELECT query_id, id, 0 AS source, rank AS pos FROM hyb JOIN documents ON doc_id = id WHERE source = 'src3'),
        m AS (SELECT query_id, doc_id AS id, 1 AS source, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS pos FROM (SELECT DISTINCT query_id FROM hyb), documents WHERE source = 'src3'),
        b AS (SELECT query_id, id, min(source) AS source, arg_min(pos, (source, pos)) AS pos FROM (SELECT * FROM h UNION ALL SELECT * FROM m) GROUP BY 1, 2)
        SELECT query_id, id, source, row_number() OVER (PARTITION BY query_id ORDER BY source, pos) AS place FROM b QUALIFY place <= 8"""
)
def k6_backfill(spark: SparkSession, d: str) -> DataFrame:
    hits = hybrid(spark, d, 100)
    scope = t(spark, d, "documents").where("source = 'src3'").select(F.col("doc_id").alias("id"), F.col("source").alias("region"))
    asked = hits.select("query_id", F.lit("src3").alias("region")).distinct()
    return se.backfilled(hits, scope, asked, 8).withColumn("place", F.col("place").cast("long"))


def lines_of(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a document are the rows of its one resource."""
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("resource_id"), F.posexplode(F.split("text", "\n")).alias("row_no", "text"))


def _packs_sql(hits: str) -> str:
    """SQL of the packs of the ranked ``hits`` under the operator's own limits."""
    return f"""r AS (SELECT query_id, rank, doc_id, pos, line FROM {hits} JOIN (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) ON doc_id = id WHERE rank <= 3 AND pos <= 1000),
        u AS (SELECT *, sum(length(line) + 1) OVER w AS used, row_number() OVER w AS no FROM r WINDOW w AS (PARTITION BY query_id ORDER BY rank, doc_id, pos))
        SELECT query_id, md5(string_agg(line, chr(10) ORDER BY no)) AS pack FROM u WHERE used <= 90000 OR no = 1 GROUP BY 1"""


@query(f"WITH {BM25_SQL}, {_packs_sql('kw')}")
def k7_grounding(spark: SparkSession, d: str) -> DataFrame:
    """The packs of the keyword hits alone: 3 hits, 1000 rows a resource, 90,000 characters."""
    return se.grounding_pack(keyword(spark, d), lines_of(spark, d)).select("query_id", F.md5("pack").alias("pack"))


@query(f"WITH {HYBRID_SQL.replace('{top}', '5')}, {_packs_sql('hyb')}")
def k7_grounding_pack(spark: SparkSession, d: str) -> DataFrame:
    """The packs of the hybrid hits: 3 hits, 1000 rows a resource, 90,000 characters."""
    return se.grounding_pack(hybrid(spark, d, 5), lines_of(spark, d)).select("query_id", F.md5("pack").alias("pack"))


def _embed(texts: list[str]) -> list[list[float]]:
    """A stand-in model that refuses texts with a year in brackets."""
    if any("(19" in x or "%%%" in x for x in texts):
        raise ValueError("refused")
    return [[float(len(x) % 7), 1.0] for x in texts]


@query(
    """SELECT CASE WHEN trim(description) = '' THEN 'empty_text' WHEN contains(description, '%%%') OR contains(description, '(19') THEN 'ValueError: refused' ELSE 'ok' END AS reason, count(*) AS n FROM datasets GROUP BY 1""",
    "datasets",
)
def k8_embed_changed(spark: SparkSession, d: str) -> DataFrame:
    """The first run over all datasets and their whole descriptions, counted by outcome."""
    text = F.col("description")
    rows = datasets(spark, d).select("id", text.alias("embed_text"), F.when(F.trim(text) == "", "empty_text").otherwise("embedded").alias("vector"))
    good, bad = se.embed_changed(rows, _embed)
    return good.select(F.lit("ok").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _embed_whole(texts: list[str]) -> list[list[float]]:
    """A stand-in model whose vectors depend on every character; it refuses the same texts as ``_embed``."""
    _embed(texts)
    digests = [hashlib.md5(x.encode()).hexdigest() for x in texts]
    return [[float(len(x)), float(int(h[:5], 16)), float(int(h[5:10], 16))] for x, h in zip(texts, digests, strict=True)]


def index_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents, ledger and the two stores of an index run over all datasets.

    The run before it read another text of the German ones, had another model for the French ones and lost the vectors of src5.
    """
    english = catalog.first_translation(translations(spark, d)).select(F.col("subject").alias("id"), F.col("text").alias("en"))
    none = F.lit(None).cast("string")
    ds = datasets(spark, d)
    text = se.embedding_text(F.col("title"), F.col("en"), F.col("description"), none, none)
    rows = ds.join(english, "id", "left").select("id", "publisher_id", F.element_at("tags", 1).alias("lang"), text.alias("embed_text"))
    rows = rows.withColumn("embed_fp", F.sha2("embed_text", 256)).withColumn("content_fp", F.sha2(F.concat_ws("|", "publisher_id", "lang", "embed_fp"), 256))
    ledger = rows.select("id", "content_fp", F.when(F.col("lang") == "de", "x").otherwise(F.col("embed_fp")).alias("embed_fp"), F.when(F.col("lang") == "fr", "m#16").otherwise("m#32").alias("model_id"))
    return rows.select("id", "content_fp", "embed_fp", "embed_text"), ledger, ds.select("id"), ds.where("publisher_id <> 'src5'").select("id")


@query(
    """, e AS (SELECT id, publisher_id, tags[1] AS lang, concat_ws(chr(10), CASE WHEN trim(title) <> '' THEN title END, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'alpha: ' || substr(title, 1, 20) END,
         CASE WHEN trim(description) <> '' THEN description END) AS t FROM datasets),
       x AS (SELECT id, t, trim(t) = '' AS blank, contains(t, '(19') OR contains(t, '%%%') AS bad FROM e
         WHERE trim(t) = '' OR coalesce(lang IN ('de', 'fr'), false) OR NOT coalesce(publisher_id <> 'src5', false))
       SELECT id, CASE WHEN blank THEN 'empty_text' WHEN bad THEN 'ValueError: refused' ELSE 'ok' END AS reason,
         CASE WHEN NOT blank AND NOT bad THEN md5(concat_ws(',', length(t), CAST('0x' || substr(md5(t), 1, 5) AS INTEGER), CAST('0x' || substr(md5(t), 6, 5) AS INTEGER))) END AS vector FROM x""",
    "datasets",
)
def k8_embed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """All datasets with the actions of an index run: a vector's digest or the reason of a failure for each that isn't skipped."""
    good, bad = se.embed_changed(changes.index_actions(*index_tables(spark, d), "m#32"), _embed_whole)
    digest = F.md5(F.array_join(F.transform("vector", lambda x: x.cast("long").cast("string")), ","))
    return good.select("id", F.lit("ok").alias("reason"), digest.alias("vector")).unionByName(bad.select("id", "reason", F.lit(None).cast("string").alias("vector")))


@query(
    """SELECT id, title AS title_bg, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'alpha: ' || substr(title, 1, 20) ELSE '' END AS title_en, upper(publisher_id) AS publisher_label, array_to_string(tags, ' ') AS tag_labels,
         coalesce(cols, '') AS column_labels, coalesce(ents, '') AS entity_labels FROM datasets
       LEFT JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS id, string_agg(l_linenumber || l_returnflag, ' ' ORDER BY l_linenumber, l_linenumber || l_returnflag) AS cols FROM lineitem GROUP BY 1) USING (id)
       LEFT JOIN (SELECT id, string_agg(label, ' ' ORDER BY e) AS ents FROM (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id, 'supplier:' || l_suppkey AS e, 'S' || l_suppkey AS label FROM lineitem) GROUP BY 1) USING (id)""",
    "datasets",
)
def e18_search_documents(spark: SparkSession, d: str) -> DataFrame:
    out = search_documents(spark, d)
    return out.select("id", "title_bg", "title_en", "publisher_label", "tag_labels", "column_labels", "entity_labels")


@query(
    """SELECT id, md5(concat_ws(chr(10), CASE WHEN title <> '' THEN title END, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'alpha: ' || substr(title, 1, 20) END, description)) AS fp FROM datasets""",
    "datasets",
)
def e19_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    english = catalog.first_translation(translations(spark, d)).select(F.col("subject").alias("id"), F.col("text").alias("en"))
    at = datasets(spark, d).join(english, "id", "left")
    return at.select("id", F.md5(se.embedding_text(F.col("title"), F.col("en"), F.col("description"), F.lit("  "), F.lit(None).cast("string"))).alias("fp"))


@query(
    f"""WITH {_vec_sql(50)}, x AS (SELECT q.vec_id AS query_id, CASE WHEN q.label % 2 = 0 THEN 'bg' ELSE 'en' END AS lang, CASE WHEN count(e.vec_id) > 0 THEN 1 ELSE 0 END AS hit FROM embeddings q
        LEFT JOIN (SELECT query_id, id FROM vec WHERE rank BETWEEN 2 AND 5) v ON v.query_id = q.vec_id LEFT JOIN embeddings e ON e.vec_id = v.id AND e.label = q.label WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, q.label)
        SELECT lang, count(*) AS queries, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 4) AS recall FROM x GROUP BY 1"""
)
def e20_recall(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the query's label are expected among the first five; the query itself doesn't count."""
    e = t(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    hits = vector(spark, d, 50)
    # of the hits' pairs those with one label; a label's ids are never listed as a whole
    same = hits.select("query_id", "id").join(q, "query_id").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("own")), "id")
    expected = same.where("label = own and id <> query_id").select("query_id", "id")
    asked = q.select("query_id", F.when(F.col("label") % 2 == 0, "bg").otherwise("en").alias("lang"))
    return se.recall(hits, asked, expected).withColumn("recall", F.round("recall", 4))


@query(f"WITH {VEC_SQL} SELECT count(*) AS pairs, count(DISTINCT query_id) AS queries FROM vs WHERE score > 0.2")
def b20_close_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a query and a vector above 0.2, however many a query has: found by the block product, scored by the column expression."""
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    pairs = se.close_vectors(e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), e, 0.2)
    return pairs.agg(F.count("*").alias("pairs"), F.count_distinct("query_id").alias("queries"))


@query("SELECT id FROM datasets WHERE lifecycle <> 'active' AND CAST(id AS BIGINT) % 2 = 0", "datasets")
def d8_purged(spark: SparkSession, d: str) -> DataFrame:
    ds = datasets(spark, d)
    return changes.index_orphans(ds.where("lifecycle = 'active'"), ds.where(F.col("id").cast("long") % 2 == 0).select("id"))
