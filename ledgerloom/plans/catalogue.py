"""Catalogue filters, joins, facets, pages and the geographic roll-up over the driver's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.tables import bucketed
from ..operators import catalog, geo, pages
from .base import NOW, datasets, geo_links, geo_units, query, scratch, t

STALE_SQL = f"date_diff('second', last_synced_at, TIMESTAMP '{NOW}') > 86400"
PLACED_SQL = """placed AS (SELECT dataset_id, CASE WHEN u.kind = 'oblast' THEN u.id ELSE u.parent END AS region, max(confidence) AS confidence
    FROM geo_links JOIN geo_units u ON entity_id = u.id GROUP BY 1, 2)"""


def organizations(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select(F.col("source").alias("id")).distinct().withColumn("title", F.upper("id"))


def translations(spark: SparkSession, d: str) -> DataFrame:
    """Two translators a title for every third dataset."""
    rows = datasets(spark, d).where(F.col("id").cast("long") % 3 == 0)
    return rows.select(F.lit("title").alias("kind"), F.col("id").alias("subject"), F.explode(F.array(F.lit("zeta"), F.lit("alpha"))).alias("translator"), F.col("title").alias("up")).select(
        "kind", "subject", "translator", F.concat_ws(": ", "translator", F.substring("up", 1, 20)).alias("text")
    )


def dataset_places(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue datasets meet order places by id."""
    return geo_links(spark, d)


@query("SELECT id FROM datasets WHERE publisher_id IN ('src1', 'src2') OR list_contains(tags, 'de') OR id = '7'", "datasets")
def c1_scope(spark: SparkSession, d: str) -> DataFrame:
    return datasets(spark, d).where(catalog.scope_predicate(ids=["7"], publishers=["src1", "src2"], tags=["de"])).select("id")


@query(
    f"""SELECT d.id FROM datasets d WHERE lifecycle <> 'withdrawn' AND NOT ({STALE_SQL}) AND list_contains(tags, 'en')
        AND EXISTS (SELECT 1 FROM geo_links g WHERE g.dataset_id = d.id AND g.entity_id IN ('nation:3', 'nation:5', 'region:1'))""",
    "datasets geo_links",
)
def c2_catalogue_filter(spark: SparkSession, d: str) -> DataFrame:
    geo_ids = dataset_places(spark, d).groupBy(F.col("dataset_id").alias("id")).agg(F.collect_set("entity_id").alias("geo_ids"))
    at = datasets(spark, d).join(geo_ids, "id", "left")
    return at.where(catalog.catalogue_filter(F.lit(NOW), fresh=True, tags=["en"], places=["nation:3", "nation:5", "region:1"])).select("id")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_brand), '1')")
def c3_grid_filter(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").where(catalog.grid_filter({"p_name": " RED ", "p_brand": "1", "p_type": "  "})).select("p_partkey")


def customer_units(spark: SparkSession, d: str) -> DataFrame:
    """Customers as units below their nations, so that the hierarchy grows with the tables."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    return t(spark, d, "customer").select(key("customer", "c_custkey").alias("id"), F.col("c_name").alias("code"), key("nation", "c_nationkey").alias("parent"))


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_nationkey IN (2, 7) OR c_custkey = 1 UNION SELECT id FROM geo_units WHERE id IN ('nation:2', 'nation:7', 'region:2') OR parent = 'region:2'", "geo_units")
def c4_expand_places(spark: SparkSession, d: str) -> DataFrame:
    units = geo_units(spark, d).select("id", "parent").unionByName(customer_units(spark, d).select("id", "parent"))
    return geo.expand_places(units.where(F.col("id").isin("region:2", "nation:2", "nation:7", "customer:1")), units)


@query(f"SELECT id FROM datasets WHERE lifecycle <> 'withdrawn' AND {STALE_SQL} AND publisher_id = 'src3' AND id IN ('3', '23', '43', '63')", "datasets")
def c5_retrieval_scope(spark: SparkSession, d: str) -> DataFrame:
    scope = catalog.retrieval_scope(["3", "23", "43", "63"], now=F.lit(NOW), fresh=False, publisher="src3")
    return datasets(spark, d).where(scope).select("id")


@query("SELECT id FROM datasets WHERE id NOT IN (SELECT dataset_id FROM geo_links WHERE entity_id LIKE 'region:%')", "datasets geo_links")
def c6_national(spark: SparkSession, d: str) -> DataFrame:
    return geo.national(datasets(spark, d), dataset_places(spark, d).where("entity_id like 'region:%'")).select("id")


@query("SELECT 'k' AS key, CAST(min(event_id) AS BIGINT) AS first_row FROM events")
def c7_object_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "events").select(F.col("event_id").alias("row_no"), F.col("props").alias("row"))
    return catalog.object_keys(rows)


@query(
    """SELECT d.id, upper(publisher_id) AS publisher, CASE WHEN CAST(d.id AS BIGINT) % 3 = 0 THEN 'alpha: ' || substr(title, 1, 20) END AS title_en,
         g.geo FROM datasets d LEFT JOIN (SELECT dataset_id, string_agg(entity_id || '=' || CAST(CAST(round(c * 100) AS INTEGER) AS VARCHAR), ',' ORDER BY entity_id) AS geo
           FROM (SELECT dataset_id, entity_id, max(confidence) AS c FROM geo_links GROUP BY 1, 2) GROUP BY 1) g ON g.dataset_id = d.id""",
    "datasets geo_links",
)
def d1_lite(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.lite(datasets(spark, d), translations(spark, d), organizations(spark, d), dataset_places(spark, d))
    shown = F.transform("geo", lambda g: F.concat_ws("=", g["entity_id"], F.round(g["confidence"] * 100).cast("int").cast("string")))
    return out.select("id", "publisher", "title_en", F.when(F.col("geo").isNotNull(), F.array_join(shown, ",")).alias("geo"))


def order_links(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer, each linked to the customer's first."""
    o = t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("b"))
    first = o.groupBy("o_custkey").agg(F.min("b").alias("a"))
    return o.join(first, "o_custkey").where("a <> b").select("a", "b", F.concat(F.lit("org:"), "o_custkey").alias("via"), F.lit(0.95).alias("confidence"))


ORDER_LINKS_SQL = """o AS (SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS b FROM orders), links AS (SELECT a, b, 'org:' || o.o_custkey AS via, 0.95 AS confidence
    FROM o JOIN (SELECT o_custkey, min(b) AS a FROM o GROUP BY 1) f ON o.o_custkey = f.o_custkey WHERE a <> b),
    sides AS (SELECT a AS dataset_id, b AS other_id FROM links UNION ALL SELECT b, a FROM links)"""


RECORD_SQL = f"""WITH {ORDER_LINKS_SQL}, ent AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, 'nation:' || s_nationkey AS e, max(round(1 - l_discount, 2)) AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
        SELECT x.b AS id, coalesce(r.n, 0) AS n_resources, r.first AS first_resource, coalesce(e.n, 0) AS n_entities, coalesce(l.n, 0) AS n_links, l.others
        FROM o x LEFT JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(count(*) AS INTEGER) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY 1) r ON r.id = x.b
        LEFT JOIN (SELECT id, CAST(least(count(*), 40) AS INTEGER) AS n FROM ent GROUP BY 1) e ON e.id = x.b
        LEFT JOIN (SELECT dataset_id, CAST(count(*) AS INTEGER) AS n, string_agg(other_id, ',' ORDER BY other_id) AS others FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY other_id) AS r FROM sides) WHERE r <= 25 GROUP BY 1) l ON l.dataset_id = x.b"""


def _shown(full: DataFrame) -> DataFrame:
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return full.select(
        "id", n("resources").alias("n_resources"), F.array_min(F.transform("resources", lambda r: r["position"])).alias("first_resource"),
        n("entities").alias("n_entities"), n("links").alias("n_links"), F.array_join(F.transform("links", lambda x: x["other_id"]), ",").alias("others"),
    )


def _record_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Datasets, resources, entities and both sides of links."""
    sets = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    res = t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("dataset_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("resource_id"), F.col("l_returnflag").alias("format"))
    ent = catalog.strongest_places(geo_links(spark, d).where("extractor = 'supplier'"))
    return sets, res, ent, catalog.both_sides(order_links(spark, d))


@query(RECORD_SQL)
def d2_full_record(spark: SparkSession, d: str) -> DataFrame:
    return _shown(catalog.with_children(*_record_tables(spark, d)))


def bucketed_record(spark: SparkSession, d: str) -> DataFrame:
    keys = ("id", "dataset_id", "dataset_id", "dataset_id")
    return catalog.with_children(*[bucketed(x, f"record_{i}", k) for i, (x, k) in enumerate(zip(_record_tables(spark, d), keys, strict=True))])


@query(RECORD_SQL)
def d2_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """The same records of tables that are stored in like buckets, so that nothing is shuffled when they are read."""
    return _shown(bucketed_record(spark, d))


@query(f"WITH {ORDER_LINKS_SQL} SELECT dataset_id, other_id FROM sides WHERE dataset_id IN (SELECT min(b) FROM o)")
def d15_related(spark: SparkSession, d: str) -> DataFrame:
    sides = catalog.both_sides(order_links(spark, d))
    one = t(spark, d, "orders").agg(F.min(F.col("o_orderkey").cast("string")).alias("dataset_id"))
    return sides.join(F.broadcast(one), "dataset_id", "left_semi").select("dataset_id", "other_id")


@query(
    f"""SELECT 'tag' AS facet, tag AS key, tag AS label, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM datasets) GROUP BY 2
        UNION ALL SELECT 'publisher', publisher_id, upper(publisher_id), count(*) FROM datasets GROUP BY publisher_id
        UNION ALL SELECT 'freshness', k, k, CAST(sum(n) AS BIGINT) FROM (SELECT CASE WHEN {STALE_SQL} THEN 'stale' ELSE 'fresh' END AS k, 1 AS n FROM datasets UNION ALL SELECT 'stale', 0 UNION ALL SELECT 'fresh', 0) GROUP BY k""",
    "datasets",
)
def e6_facets(spark: SparkSession, d: str) -> DataFrame:
    ds = datasets(spark, d)
    tags = catalog.tag_facet(ds).select(F.lit("tag").alias("facet"), F.col("tag").alias("key"), F.col("tag").alias("label"), "n")
    pubs = catalog.publisher_facet(ds, organizations(spark, d)).select(F.lit("publisher"), "publisher_id", "label", "n")
    fresh = catalog.freshness_facet(ds, F.lit(NOW)).select(F.lit("freshness"), "bucket", "bucket", "n")
    return tags.union(pubs).union(fresh)


@query("SELECT dataset_id, entity_id, round(max(confidence), 2) AS confidence FROM geo_links GROUP BY 1, 2", "geo_links")
def e3_strongest_places(spark: SparkSession, d: str) -> DataFrame:
    return catalog.strongest_places(geo_links(spark, d)).withColumn("confidence", F.round("confidence", 2))


@query(
    f"""SELECT u.id AS region, label, coalesce(n, 0) AS n_datasets, round(coalesce(c, 0), 2) AS max_confidence, n IS NOT NULL AS has_data FROM geo_units u
        LEFT JOIN (SELECT region, count(*) AS n, max(confidence) AS c FROM (SELECT dataset_id, CASE WHEN v.kind = 'oblast' THEN v.id ELSE v.parent END AS region, max(confidence) AS confidence
          FROM geo_links JOIN geo_units v ON entity_id = v.id GROUP BY 1, 2) GROUP BY 1) r ON r.region = u.id WHERE u.kind = 'oblast'""",
    "geo_units geo_links",
)
def e4_region_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = geo.region_rollup(geo_links(spark, d), geo_units(spark, d))
    return out.select("region", "label", "n_datasets", F.round("max_confidence", 2).alias("max_confidence"), "has_data")


@query(
    """SELECT u.id AS region, parent, coalesce(n, 0) AS n_datasets, n IS NOT NULL AS has_data FROM geo_units u
       LEFT JOIN (SELECT entity_id, count(DISTINCT dataset_id) AS n FROM geo_links GROUP BY 1) r ON r.entity_id = u.id WHERE u.kind = 'municipality'""",
    "geo_units geo_links",
)
def e4_municipality_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = geo.region_rollup(geo_links(spark, d), geo_units(spark, d), "municipality")
    return out.select("region", "parent", "n_datasets", "has_data")


@query(
    """SELECT dataset_id, round(max(confidence), 2) AS confidence FROM geo_links JOIN geo_units u ON entity_id = u.id WHERE coalesce(parent, u.id) = 'region:1'
       GROUP BY 1 ORDER BY 1 LIMIT 50 OFFSET 10""",
    "geo_units geo_links",
)
def e5_region_members(spark: SparkSession, d: str) -> DataFrame:
    return geo.region_members(geo_links(spark, d), geo_units(spark, d), "region:1", limit=50, offset=10).withColumn("confidence", F.round("confidence", 2))


@query(
    """SELECT 'f' || r_regionkey AS feature_id, coalesce(n, 0) AS n_datasets, coalesce(n, 0) > 0 AS has_data FROM region LEFT JOIN
       (SELECT coalesce(parent, u.id) AS region, count(DISTINCT dataset_id) AS n FROM geo_links JOIN geo_units u ON entity_id = u.id GROUP BY 1) ON region = 'region:' || r_regionkey AND r_regionkey > 0""",
    "geo_units geo_links",
)
def d11_boundaries(spark: SparkSession, d: str) -> DataFrame:
    regions = t(spark, d, "region")
    feature = F.concat(F.lit("f"), F.col("r_regionkey").cast("string")).alias("feature_id")
    cross = regions.where("r_regionkey > 0").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("entity_id"), feature)
    return geo.boundary_counts(regions.select(feature), cross, geo.region_rollup(geo_links(spark, d), geo_units(spark, d)))


@query(
    """SELECT c_custkey AS child_id, 'region:' || CASE WHEN c_custkey % 56 BETWEEN 2 AND 3 THEN 4 ELSE least(c_custkey % 56 // 10, 4) END AS parent_id FROM customer"""
)
def d12_polygon_parents(spark: SparkSession, d: str) -> DataFrame:
    """Regions are bands of ten degrees; region 0 has a hole, and an island of region 4 lies in it. Customers' areas have most points on their left side, which the centre doesn't mind, and some lie beyond all bands."""
    k = F.col("r_regionkey") * 10.0
    ring = lambda *ps: F.array(*[F.array(x if hasattr(x, "cast") else F.lit(float(x)), F.lit(float(y))) for x, y in ps])
    band = ring((k, 0), (k + 10, 0), (k + 10, 20), (k, 20), (k, 0))
    square = ring((2, 8), (4, 8), (4, 12), (2, 12))
    outline = F.when(F.col("r_regionkey") == 0, F.array(F.array(band, square))).when(F.col("r_regionkey") == 4, F.array(F.array(band), F.array(square))).otherwise(F.array(F.array(band)))
    parents = t(spark, d, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("parent_id"), outline.alias("geometry"))
    x = (F.col("c_custkey") % 56).cast("double") - 0.3
    side = [(x, 10.5 - i / 20) for i in range(20)]
    area = F.array(F.array(ring(*side, (x, 9.5), (x + 1.2, 9.5), (x + 1.2, 10.5))))
    return geo.assign_parents(t(spark, d, "customer").select(F.col("c_custkey").alias("child_id"), area.alias("geometry")), parents)


@query("""SELECT 'customer:' || c_custkey AS entity_id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'lau' || c_custkey END AS feature_id FROM customer""")
def d13_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """Features are the customers that ordered; the others are gaps."""
    units = customer_units(spark, d).select("id", "code")
    ordered = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    features = t(spark, d, "customer").join(ordered, "c_custkey", "left_semi").select(F.concat(F.lit("lau"), F.col("c_custkey").cast("string")).alias("feature_id"), F.col("c_name").alias("code"))
    found, gaps = geo.crosswalk(units, features)
    return found.select("entity_id", "feature_id").unionByName(gaps.select(F.col("id").alias("entity_id"), F.lit(None).cast("string").alias("feature_id")))


@query(
    """SELECT DISTINCT region FROM (SELECT dataset_id, min(region) AS region FROM (SELECT DISTINCT dataset_id, coalesce(parent, u.id) AS region FROM geo_links JOIN geo_units u ON entity_id = u.id)
       GROUP BY 1 HAVING count(*) = 1)""",
    "geo_units geo_links",
)
def e21_map_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Every order is cited."""
    cited = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("dataset_id"))
    return geo.map_anchor(cited, geo_links(spark, d), geo_units(spark, d))


@query("SELECT id AS subject, 'alpha: ' || substr(title, 1, 20) AS text FROM datasets WHERE CAST(id AS BIGINT) % 3 = 0", "datasets")
def f1_first_translation(spark: SparkSession, d: str) -> DataFrame:
    return catalog.first_translation(translations(spark, d)).select("subject", "text")


@query(
    """SELECT o_custkey, CAST(o_orderkey AS BIGINT) AS o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5"""
)
def f3_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("confidence"))
    return catalog.cap(rows, "o_custkey", "o_orderkey", 5).select("o_custkey", "o_orderkey")


@query(
    """SELECT conv_id, turn, used FROM (SELECT conv_id, turn, CAST(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r
       FROM conversations) WHERE used <= 600 OR r = 1"""
)
def f4_budget(spark: SparkSession, d: str) -> DataFrame:
    return catalog.running_budget(t(spark, d, "conversations"), ["conv_id"], "turn", F.length("text") + 1, 600).select("conv_id", "turn", "used")


@query("""SELECT p_partkey, place FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 50""")
def g1_top(spark: SparkSession, d: str) -> DataFrame:
    top = t(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50)
    return catalog.with_place(top, [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_partkey", "place")


@query("""SELECT c_custkey, row_number() OVER (ORDER BY num DESC, c_custkey) AS place FROM (SELECT c_custkey, round(c_acctbal) AS num FROM customer)""")
def g2_sorted_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "customer").select("c_custkey", F.format_string("%.0f", F.round("c_acctbal")).alias("cell"))
    return catalog.with_place(rows, [*tx.sort_keys(F.col("cell"), True), F.asc("c_custkey")]).select("c_custkey", "place")


@query("""SELECT id, (SELECT count(*) FROM datasets) AS total FROM datasets ORDER BY id LIMIT 100 OFFSET 20""", "datasets")
def g3_page(spark: SparkSession, d: str) -> DataFrame:
    rows, total, _ = catalog.page(datasets(spark, d), "id", 100, 20)
    return rows.select("id", F.lit(total).cast("long").alias("total"))


@query("""SELECT id, title, (SELECT count(*) FROM datasets) AS total FROM datasets ORDER BY id LIMIT 1000 OFFSET 70""", "datasets")
def g3_sorted_pages(spark: SparkSession, d: str) -> DataFrame:
    """The largest page of a table that is stored in ranges of its order."""
    rows, path = datasets(spark, d).select("id", "title"), scratch(spark, "sorted-pages")
    pages.write(rows, [F.asc("id")], "id", path)
    out, total, _ = pages.page(spark, path, rows.schema, 1000, 70)
    return out.select("id", "title", F.lit(total).cast("long").alias("total"))
