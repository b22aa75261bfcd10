"""Entities, relations, links and answer checks over the driver's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog, entities, guards
from .base import datasets, geo_links, geo_units, query, t
from .catalogue import organizations, translations

#: (ord, place_id, label, pattern, match_type): words of the invented prose as places.
GAZETTEER = [
    (0, "geo:mit", "MIT", "MIT License", "canonical"), (1, "geo:mit", "MIT", "under the MIT License", "alias"), (2, "geo:apache", "Apache", "Apache License", "canonical"),
    (3, "geo:tionth", "Tionth", "tionth", "canonical"), (4, "geo:keit", "Keit", "keit", "canonical"), (5, "geo:keit", "Keit", "igkeit", "alias"),
    (6, "geo:ment", "Ment", "ement", "canonical"), (7, "geo:cion", "Ción", "CIÓN", "canonical"), (8, "geo:one", "One", "src1", "canonical"), (9, "geo:one", "One", "src11", "alias"),
]
GAZETTEER_SQL = "gaz(ord, place_id, label, pattern, match_type) AS (VALUES " + ", ".join(str(x) for x in GAZETTEER) + ")"
MATCH_SQL = """SELECT {key}, place_id, match_type FROM (SELECT {key}, place_id, match_type, row_number() OVER (PARTITION BY {key}, place_id ORDER BY length(pattern) DESC, ord) AS r
    FROM {table}, gaz WHERE contains(lower({text}), lower(pattern))) WHERE r = 1"""


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GAZETTEER, "ord int, place_id string, label string, pattern string, match_type string")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("dataset_id"), "text")


def dated(spark: SparkSession, d: str) -> DataFrame:
    """Orders as texts that name their date twice, as ISO date and by month."""
    month = F.element_at(F.array(*map(F.lit, tx.MONTHS)), F.month("o_orderdate"))
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat(F.lit("Поръчка "), iso, F.lit("T10:00:00Z ("), iso, F.lit(") от "), F.dayofmonth("o_orderdate").cast("string"), F.lit("  "), F.initcap(month), F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(" №x2024-01-01"))
    return t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("dataset_id"), text.alias("text"))


@query(f"WITH {GAZETTEER_SQL} {MATCH_SQL.format(key='doc_id', table='documents', text='text')}")
def d4_gazetteer(spark: SparkSession, d: str) -> DataFrame:
    return entities.place_matches(t(spark, d, "documents").select("doc_id", "text"), gazetteer(spark), "doc_id").select("doc_id", "place_id", "match_type")


@query("SELECT CAST(doc_id AS VARCHAR) AS dataset_id, 'org:' || source AS entity_id, upper(source) AS label, 1.0 AS confidence FROM documents")
def j1_publishers(spark: SparkSession, d: str) -> DataFrame:
    return entities.publishers(datasets(spark, d), organizations(spark, d)).select("dataset_id", "entity_id", "label", "confidence")


@query("SELECT id AS dataset_id, 'group:' || lifecycle AS entity_id FROM datasets", "datasets")
def j2_groups(spark: SparkSession, d: str) -> DataFrame:
    return entities.listed(datasets(spark, d).withColumn("groups", F.array("lifecycle")), "groups", "group", 0.9).select("dataset_id", "entity_id")


@query("SELECT DISTINCT id AS dataset_id, 'tag:' || tag AS entity_id, 0.6 AS confidence FROM (SELECT id, unnest(tags) AS tag FROM datasets)", "datasets")
def j3_tags(spark: SparkSession, d: str) -> DataFrame:
    return entities.listed(datasets(spark, d), "tags", "tag", 0.6).select("dataset_id", "entity_id", "confidence")


@query(
    f"""WITH {GAZETTEER_SQL} SELECT CAST(doc_id AS VARCHAR) AS dataset_id, place_id AS entity_id, CASE match_type WHEN 'canonical' THEN 0.95 ELSE 0.75 END AS confidence
        FROM ({MATCH_SQL.format(key='doc_id', table='documents', text='text')})"""
)
def j4_places(spark: SparkSession, d: str) -> DataFrame:
    return entities.places_in_texts(texts(spark, d), gazetteer(spark)).select("dataset_id", "entity_id", "confidence")


@query(
    f"""WITH {GAZETTEER_SQL}, org AS (SELECT DISTINCT source FROM documents) SELECT CAST(doc_id AS VARCHAR) AS dataset_id, place_id AS entity_id, CASE match_type WHEN 'canonical' THEN 0.7 ELSE 0.6 END AS confidence
        FROM documents JOIN ({MATCH_SQL.format(key='source', table='org', text='source')}) USING (source)"""
)
def j5_publisher_places(spark: SparkSession, d: str) -> DataFrame:
    return entities.places_of_publishers(datasets(spark, d), organizations(spark, d), gazetteer(spark)).select("dataset_id", "entity_id", "confidence")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS dataset_id, 'time:' || strftime(o_orderdate, '%Y-%m-%d') AS entity_id, 0.95 AS confidence FROM orders")
def j6_iso_dates(spark: SparkSession, d: str) -> DataFrame:
    return entities.iso_dates(dated(spark, d)).select("dataset_id", "entity_id", "confidence")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS dataset_id, 'time:' || strftime(o_orderdate, '%Y-%m-%d') AS entity_id, 0.85 AS confidence FROM orders")
def j7_named_dates(spark: SparkSession, d: str) -> DataFrame:
    return entities.named_dates(dated(spark, d)).select("dataset_id", "entity_id", "confidence")


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, unnest(CASE c_mktsegment WHEN 'HOUSEHOLD' THEN ['subject:budget', 'subject:health'] WHEN 'MACHINERY' THEN ['subject:transport']
         WHEN 'BUILDING' THEN ['subject:environment', 'subject:population'] ELSE [] END) AS entity_id FROM customer"""
)
def j8_subjects(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("c_mktsegment")
    text = F.when(s == "HOUSEHOLD", "Общински БЮДЖЕТ за Health").when(s == "MACHINERY", "Transports").when(s == "BUILDING", "Околна среда, Population").otherwise(s)
    rows = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("dataset_id"), text.alias("text"))
    return entities.subjects(rows).select("dataset_id", "entity_id")


def found(spark: SparkSession, d: str) -> list[DataFrame]:
    ds, org, gaz, tt = datasets(spark, d), organizations(spark, d), gazetteer(spark), texts(spark, d)
    return [entities.publishers(ds, org), entities.listed(ds, "tags", "tag", 0.6), entities.places_in_texts(tt, gaz), entities.places_of_publishers(ds, org, gaz), entities.iso_dates(tt), entities.named_dates(tt), entities.subjects(tt)]


FOUND_SQL = f"""WITH {GAZETTEER_SQL}, org AS (SELECT DISTINCT source FROM documents), found AS (
        SELECT doc_id, 'org:' || source AS entity_id, 'publisher' AS extractor FROM documents
        UNION SELECT doc_id, 'tag:' || unnest([lang, 'size:' || least(n_chars // 1000, 9)]), 'tags' FROM documents
        UNION SELECT doc_id, place_id, 'gazetteer' FROM ({MATCH_SQL.format(key='doc_id', table='documents', text='text')})
        UNION SELECT doc_id, place_id, 'gazetteer_publisher' FROM documents JOIN ({MATCH_SQL.format(key='source', table='org', text='source')}) USING (source))"""


@query(f"{FOUND_SQL} SELECT extractor, count(*) AS edges, count(DISTINCT entity_id) AS n_entities FROM found GROUP BY 1")
def h1_register(spark: SparkSession, d: str) -> DataFrame:
    """All extractors over the documents; the invented prose holds no dates or subjects."""
    edges, _ = entities.register(*found(spark, d))
    return edges.groupBy("extractor").agg(F.count("*").alias("edges"), F.count_distinct("entity_id").alias("n_entities"))


@query(
    f"""{FOUND_SQL}, fan AS (SELECT entity_id, count(DISTINCT doc_id) AS n FROM found GROUP BY 1)
        SELECT 'edges' AS kind, count(*) AS n FROM (SELECT DISTINCT doc_id, entity_id, extractor FROM found) UNION ALL SELECT 'entities', count(*) FROM fan
        UNION ALL SELECT 'links', CAST(coalesce(sum(n * (n - 1) / 2), 0) AS BIGINT) FROM fan WHERE n BETWEEN 2 AND 50 UNION ALL SELECT 'hubs', count(*) FROM fan WHERE n > 50"""
)
def i7_entities_only(spark: SparkSession, d: str) -> DataFrame:
    """Entities, edges and links made anew from metadata alone."""
    edges, known, links, hubs = entities.entities_only(*found(spark, d))
    count = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count("edges", edges).unionByName(count("entities", known)).unionByName(count("links", links)).unionByName(count("hubs", hubs))


def order_edges(spark: SparkSession, d: str) -> DataFrame:
    """Orders share customers (few each) and nations (hubs)."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey").cast("string").alias("dataset_id")
    own = o.select(key, F.concat(F.lit("org:"), "o_custkey").alias("entity_id"), F.lit("organization").alias("kind"))
    return own.unionByName(o.select(key, F.concat(F.lit("nation:"), "c_nationkey").alias("entity_id"), F.lit("geographic_unit").alias("kind")))


EDGES_SQL = """e AS (SELECT CAST(o_orderkey AS VARCHAR) AS dataset_id, 'org:' || o_custkey AS entity_id, 'organization' AS kind FROM orders UNION ALL
    SELECT CAST(o_orderkey AS VARCHAR), 'nation:' || c_nationkey, 'geographic_unit' FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT entity_id, count(*) AS n FROM e GROUP BY 1)"""


@query(
    f"""WITH {EDGES_SQL} SELECT x.dataset_id AS a, y.dataset_id AS b, x.entity_id AS via, CASE x.kind WHEN 'organization' THEN 'shared_publisher' ELSE 'shared_geo' END AS heuristic,
        CASE x.kind WHEN 'organization' THEN 0.95 ELSE 0.9 END AS confidence FROM e x JOIN e y ON x.entity_id = y.entity_id AND x.dataset_id < y.dataset_id JOIN n ON n.entity_id = x.entity_id WHERE n <= 50"""
)
def d14_links(spark: SparkSession, d: str) -> DataFrame:
    return entities.link_datasets(order_edges(spark, d))[0]


@query(f"WITH {EDGES_SQL} SELECT entity_id, n FROM n WHERE n > 50")
def d14_hubs(spark: SparkSession, d: str) -> DataFrame:
    return entities.link_datasets(order_edges(spark, d))[1]


@query("SELECT dataset_id, 1.0 AS score FROM (SELECT DISTINCT dataset_id FROM geo_links WHERE entity_id = 'nation:4') ORDER BY dataset_id LIMIT 50", "geo_links")
def d3_entity_recall(spark: SparkSession, d: str) -> DataFrame:
    return entities.datasets_of_entity(geo_links(spark, d), "nation:4")


def _geo_entities(spark: SparkSession, d: str) -> DataFrame:
    used = geo_links(spark, d).where("extractor = 'supplier'").select("entity_id").distinct()
    return used.join(geo_units(spark, d).select(F.col("id").alias("entity_id"), "label"), "entity_id").select("entity_id", F.lit("geographic_unit").alias("kind"), "label")


@query(
    """SELECT DISTINCT 'nation:' || s_nationkey AS subject, 'part_of' AS predicate, 'region:' || n_regionkey AS object FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey"""
)
def d9_part_of(spark: SparkSession, d: str) -> DataFrame:
    return entities.part_of(_geo_entities(spark, d), geo_units(spark, d))[0].select("subject", "predicate", "object")


@query(
    """, ent AS (SELECT DISTINCT n_nationkey, n_name, n_regionkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey),
       n AS (SELECT entity_id, count(DISTINCT dataset_id) AS n FROM geo_links GROUP BY 1)
       SELECT 'nation:' || n_nationkey AS entity_id, r_name AS out_label, CAST(0 AS INTEGER) AS n_incoming, coalesce(n, 0) AS n_datasets FROM ent JOIN region ON n_regionkey = r_regionkey LEFT JOIN n ON n.entity_id = 'nation:' || n_nationkey
       UNION ALL SELECT 'region:' || r_regionkey, NULL, CAST(count(*) AS INTEGER), coalesce(max(n), 0) FROM ent JOIN region ON n_regionkey = r_regionkey LEFT JOIN n ON n.entity_id = 'region:' || r_regionkey GROUP BY r_regionkey""",
    "geo_links",
)
def d10_entity_graph(spark: SparkSession, d: str) -> DataFrame:
    ent = _geo_entities(spark, d)
    rel, parents = entities.part_of(ent, geo_units(spark, d))
    out = entities.entity_graph(ent.unionByName(parents), rel, geo_links(spark, d))
    n = F.when(F.col("incoming").isNull(), 0).otherwise(F.size("incoming"))
    return out.select("entity_id", F.get(F.col("outgoing"), F.lit(0))["label"].alias("out_label"), n.alias("n_incoming"), "n_datasets")


@query(
    """SELECT a AS answer_id, d AS dataset_id, min(p) AS position FROM (SELECT conv_id AS a, turn AS p, CAST((conv_id * 7 + turn // 2) % 1500 AS VARCHAR) AS d FROM conversations)
       WHERE d IN (SELECT id FROM datasets WHERE lifecycle <> 'withdrawn') GROUP BY 1, 2""",
    "datasets",
)
def d16_citations(spark: SparkSession, d: str) -> DataFrame:
    """Each message cites a dataset; some don't exist or are withdrawn."""
    cited = t(spark, d, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("position"), ((F.col("conv_id") * 7 + F.floor(F.col("turn") / 2)) % 1500).cast("string").alias("dataset_id"))
    in_scope = datasets(spark, d).where("lifecycle <> 'withdrawn'")
    return guards.valid_citations(cited, in_scope)


@query("""SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS ghosts, CASE WHEN doc_id % 2 = 0 THEN '3,7' ELSE '3,7' END AS inflated FROM documents""")
def h2_ghosts(spark: SparkSession, d: str) -> DataFrame:
    def uid(k):
        return F.regexp_replace(F.md5(k.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")

    k = F.col("doc_id")
    answer = F.concat(F.lit("Виж "), F.upper(uid(k)), F.lit(" и "), uid(k + 1), F.lit(". Над 3 набора данни; 7+ datasets. Над 24 часа."))
    ground = F.when(k % 2 == 0, uid(k)).otherwise(F.lit("nothing"))
    rows = t(spark, d, "documents").select("doc_id", answer.alias("answer"), ground.alias("ground"))
    a, g = F.col("answer"), F.col("ground")
    return rows.select("doc_id", F.size(guards.ghost_ids(a, g)).alias("ghosts"), F.array_join(F.transform(guards.inflated_counts(a, g), lambda x: x.cast("string")), ",").alias("inflated"))


@query(
    f"""WITH {GAZETTEER_SQL}, m AS ({MATCH_SQL.format(key='doc_id', table='documents', text='text')}) SELECT round(avg(CASE WHEN TRUE THEN 1 ELSE 0 END), 4) AS with_entity,
        round(avg(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END), 4) AS with_english, round(avg(CASE WHEN doc_id IN (SELECT doc_id FROM m) OR source LIKE 'src1%' THEN 1 ELSE 0 END), 4) AS georeferenced FROM documents"""
)
def e22_coverage(spark: SparkSession, d: str) -> DataFrame:
    edges, _ = entities.register(*found(spark, d))
    out = entities.coverage(datasets(spark, d), edges, translations(spark, d))
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query(
    f"""WITH {EDGES_SQL}, p AS (SELECT x.dataset_id AS a, count(*) AS k FROM e x JOIN e y ON x.entity_id = y.entity_id AND x.dataset_id <> y.dataset_id JOIN n ON n.entity_id = x.entity_id WHERE n <= 50 GROUP BY 1)
        SELECT a AS dataset_id, CAST(least(k, 5) AS BIGINT) AS kept FROM p"""
)
def d15_capped_related(spark: SparkSession, d: str) -> DataFrame:
    links, _ = entities.link_datasets(order_edges(spark, d))
    return catalog.cap(catalog.both_sides(links), "dataset_id", "other_id", 5).groupBy("dataset_id").agg(F.count("*").alias("kept"))
