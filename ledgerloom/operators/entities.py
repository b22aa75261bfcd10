"""Entity extraction, registration, relations and links between datasets.

An extractor is a function from dataset texts to (dataset_id, entity_id, kind, label, extractor, confidence).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as tx
from ..functions.tables import stored

COLUMNS = ["dataset_id", "entity_id", "kind", "label", "extractor", "confidence"]
#: Subjects, the words that show them, and how sure they make it.
SUBJECTS = [
    ("subject:budget", ["бюджет", "budget"], 0.7),
    ("subject:population", ["население", "population"], 0.7),
    ("subject:education", ["образование", "education"], 0.65),
    ("subject:health", ["здраве", "медицина", "health"], 0.65),
    ("subject:transport", ["транспорт", "transport"], 0.6),
    ("subject:environment", ["околна среда", "environment", "екология"], 0.6),
]
#: How sure a shared entity of each kind makes a link, and its name.
LINK_KINDS = {"organization": ("shared_publisher", 0.95), "geographic_unit": ("shared_geo", 0.9), "time_period": ("shared_time", 0.7), "named_subject": ("shared_subject", 0.6), "tag": ("shared_tag", 0.5), "group": ("shared_group", 0.7)}
MAX_FANOUT = 50
PATTERN_BLOCK = 200_000


def _found(rows: DataFrame, entity: Column, kind: str, label: Column, extractor: str, confidence: Column | float) -> DataFrame:
    sure = F.lit(confidence) if isinstance(confidence, float) else confidence
    return rows.select("dataset_id", entity.alias("entity_id"), F.lit(kind).alias("kind"), label.alias("label"), F.lit(extractor).alias("extractor"), sure.alias("confidence"))


def publishers(datasets: DataFrame, organizations: DataFrame) -> DataFrame:
    names = organizations.select(F.col("id").alias("publisher_id"), "title")
    at = datasets.select(F.col("id").alias("dataset_id"), "publisher_id").join(names, "publisher_id")
    return _found(at, F.concat(F.lit("org:"), "publisher_id"), "organization", F.col("title"), "publisher", 1.0)


def listed(datasets: DataFrame, column: str, prefix: str, confidence: float) -> DataFrame:
    """Groups or tags, once a dataset."""
    at = datasets.select(F.col("id").alias("dataset_id"), F.explode(F.array_distinct(column)).alias("x"))
    return _found(at, F.concat(F.lit(f"{prefix}:"), "x"), prefix, F.col("x"), f"{prefix}s", confidence)


def place_matches(texts: DataFrame, gazetteer: DataFrame, key: str = "dataset_id") -> DataFrame:
    """(key, place_id, label, match_type): places whose name or alias a text holds, lower-cased, no word ends asked.

    Of a place's patterns in a text the longest decides the match type. gazetteer: (ord, place_id, label,
    pattern, match_type), a published list. Its patterns become one automaton that runs over each text once,
    whatever their number; a list beyond PATTERN_BLOCK patterns is taken in blocks of about that many.
    """
    low = texts.select(key, F.lower("text").alias("low")).where("low is not null")
    patterns = gazetteer.where("pattern is not null").select("ord", "place_id", "label", F.lower("pattern").alias("pattern"), "match_type")
    n_blocks = -(-patterns.count() // PATTERN_BLOCK) or 1
    blocks = patterns.withColumn("__b", F.pmod(F.xxhash64("pattern"), F.lit(n_blocks)))
    hits = reduce(DataFrame.unionByName, [_scanned(low, blocks.where(F.col("__b") == b).drop("__b"), key) for b in range(n_blocks)])
    best = F.min_by(F.struct("label", "match_type"), F.struct(-F.col("size"), F.col("ord")))
    return hits.groupBy(key, "place_id").agg(best.alias("m")).select(key, "place_id", "m.label", "m.match_type")


def _scanned(low: DataFrame, patterns: DataFrame, key: str) -> DataFrame:
    """(key, place_id, label, match_type, size, ord): of each place that ``low`` (key, low) holds, its longest pattern there."""
    spark = low.sparkSession
    shared = spark.sparkContext.broadcast([tuple(r) for r in patterns.select("ord", "place_id", "label", "pattern", "match_type").collect()])  # PATTERN_BLOCK rows
    kinds = {f.name: f.dataType for f in patterns.schema.fields} | {key: low.schema[key].dataType}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        rows, by_pattern, always = shared.value, {}, []
        for i, row in enumerate(rows):
            by_pattern.setdefault(row[3], []).append(i)
        always = by_pattern.pop("", [])
        finder = ahocorasick.Automaton()
        for pattern, which in by_pattern.items():
            finder.add_word(pattern, which)
        finder.make_automaton()
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                met = {i for _, which in finder.iter(text) for i in which} if by_pattern else set()
                best: dict = {}
                for i in met.union(always):
                    number, place, _, pattern, _ = rows[i]
                    rank = (-len(pattern), number)
                    if place not in best or rank < best[place][0]:
                        best[place] = (rank, i)
                at += [k] * len(best)
                found += [i for _, i in best.values()]
            cols = [pa.array([rows[i][c] for i in found], to_arrow_type(kinds[name])) for name, c in (("place_id", 1), ("label", 2), ("match_type", 4), ("ord", 0))]
            size = pa.array([len(rows[i][3]) for i in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols[:3], size, cols[3]], [key, "place_id", "label", "match_type", "size", "ord"])

    sql = lambda name: kinds[name].simpleString()
    return low.mapInArrow(run, f"{key} {sql(key)}, place_id {sql('place_id')}, label {sql('label')}, match_type {sql('match_type')}, size int, ord {sql('ord')}")


def places_in_texts(texts: DataFrame, gazetteer: DataFrame, canonical: float = 0.95, alias: float = 0.75) -> DataFrame:
    """texts: (dataset_id, text) of title, description, and resources' names and descriptions."""
    at = place_matches(texts, gazetteer)
    return _found(at, F.col("place_id"), "geographic_unit", F.col("label"), "gazetteer", F.when(F.col("match_type") == "canonical", canonical).otherwise(alias))


def places_of_publishers(datasets: DataFrame, organizations: DataFrame, gazetteer: DataFrame, canonical: float = 0.7, alias: float = 0.6) -> DataFrame:
    """Places named in the publisher's title: matched once per publisher, then joined to its datasets."""
    at = place_matches(organizations.select("id", F.col("title").alias("text")), gazetteer, "id").withColumnRenamed("id", "publisher_id")
    at = datasets.select(F.col("id").alias("dataset_id"), "publisher_id").join(at, "publisher_id")
    return _found(at, F.col("place_id"), "geographic_unit", F.col("label"), "gazetteer_publisher", F.when(F.col("match_type") == "canonical", canonical).otherwise(alias))


ISO_DATE = r"(?<![A-Za-z0-9_])(\d{4}-\d{2}-\d{2})(?:T\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?(?![A-Za-z0-9_])"
NAMED_DATE = r"(?iu)(\d{1,2}\s+(?:" + "|".join(tx.MONTHS) + r")\s+\d{4})"


def iso_dates(texts: DataFrame) -> DataFrame:
    at = texts.select("dataset_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ISO_DATE), F.lit(1)))).alias("x"))
    return _found(at, F.concat(F.lit("time:"), "x"), "time_period", F.col("x"), "iso_dates", 0.95)


def named_dates(texts: DataFrame) -> DataFrame:
    at = texts.select("dataset_id", F.explode(F.regexp_extract_all("text", F.lit(NAMED_DATE), F.lit(1))).alias("raw"))
    at = at.select("dataset_id", tx.parse_date(F.col("raw")).alias("x")).where("x is not null").distinct()
    return _found(at, F.concat(F.lit("time:"), "x"), "time_period", F.col("x"), "month_dates", 0.85)


def subjects(texts: DataFrame, keywords: list[tuple[str, list[str], float]] = SUBJECTS) -> DataFrame:
    """Subject keywords in lower-cased metadata; a few rules, tested per row without a join."""
    low = F.lower("text")
    rules = [
        F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), F.struct(F.lit(subject).alias("s"), F.lit(sure).alias("c")))
        for subject, words, sure in keywords
    ]
    at = texts.select("dataset_id", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("x"))
    return _found(at, F.col("x.s"), "named_subject", F.substring_index(F.col("x.s"), ":", -1), "subjects", F.col("x.c"))


def register(*found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All extractors' rows as dataset-entity edges, one per dataset, entity and extractor, and the entities they name."""
    every = stored(reduce(DataFrame.unionByName, found), "found")  # extractors run once for both results
    edges = every.groupBy("dataset_id", "entity_id", "extractor").agg(F.max("confidence").alias("confidence"), F.min("kind").alias("kind"))
    entities = every.groupBy("entity_id").agg(F.min("kind").alias("kind"), F.min("label").alias("label"))
    return edges, entities


def entities_only(*found: DataFrame, max_fanout: int = MAX_FANOUT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, entities, links, hubs) from extractors' rows: the re-run that reads metadata tables and neither parses nor translates.

    Use it after a change of extractors or gazetteer; relations of places follow by part_of() on the entities.
    """
    edges, entities = register(*found)
    return edges, entities, *link_datasets(edges, max_fanout)


def link_datasets(edges: DataFrame, max_fanout: int = MAX_FANOUT) -> tuple[DataFrame, DataFrame]:
    """Pairs of datasets that share an entity, and the hubs that were left out.

    Fan-out is counted first, with distinct pairs of ids combined before the shuffle. Entities over the cap
    go before anything is paired, so an entity makes at most max_fanout * (max_fanout - 1) / 2 links.
    edges: (dataset_id, entity_id, kind). Links: (a, b, via, heuristic, confidence), a < b.
    """
    one = edges.select("dataset_id", "entity_id", "kind").distinct()
    counts = one.groupBy("entity_id").agg(F.count("*").alias("n"))
    hubs = counts.where(F.col("n") > max_fanout)
    kept = one.join(counts.where(F.col("n").between(2, max_fanout)), "entity_id")
    # an entity's few datasets as an array, so that pairs need no second shuffle
    groups = kept.groupBy("entity_id", "kind").agg(F.array_sort(F.collect_list("dataset_id")).alias("ids"))
    rows = groups.select("entity_id", "kind", "ids", F.posexplode("ids").alias("i", "a"))
    rows = rows.select("entity_id", "kind", "a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b"))
    heuristic, sure = (F.create_map(*[F.lit(x) for k, v in LINK_KINDS.items() for x in (k, v[i])]) for i in (0, 1))
    links = rows.select("a", "b", F.col("entity_id").alias("via"), F.try_element_at(heuristic, F.col("kind")).alias("heuristic"), F.try_element_at(sure, F.col("kind")).alias("confidence"))
    return links, hubs


def part_of(entities: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """part_of relations of the municipalities that occur as entities, and the parents to add as entities.

    units: (id, label, kind, parent), the published hierarchy.
    """
    towns = units.where("kind = 'municipality' and parent is not null").join(entities.select(F.col("entity_id").alias("id")), "id", "left_semi")
    edges = towns.select(F.col("id").alias("subject"), F.lit("part_of").alias("predicate"), F.col("parent").alias("object"), F.lit(1.0).alias("confidence"))
    parents = units.join(edges.select(F.col("object").alias("id")).distinct(), "id", "left_semi").join(entities.select(F.col("entity_id").alias("id")), "id", "left_anti")
    return edges, parents.select(F.col("id").alias("entity_id"), F.lit("geographic_unit").alias("kind"), "label")


def entity_graph(entities: DataFrame, relations: DataFrame, edges: DataFrame) -> DataFrame:
    """Each entity with its outgoing and incoming relations, labelled, and its number of datasets. Unknown ends keep their id."""
    label = entities.select(F.col("entity_id").alias("end"), "label")

    def side(own: str, other: str, name: str) -> DataFrame:
        at = relations.select(F.col(own).alias("entity_id"), F.col(other).alias("end"), "predicate").join(label, "end", "left")
        return at.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("predicate", "end", F.coalesce("label", "end").alias("label")))).alias(name))

    n = edges.groupBy("entity_id").agg(F.count_distinct("dataset_id").alias("n_datasets"))
    out = entities.join(side("subject", "object", "outgoing"), "entity_id", "left").join(side("object", "subject", "incoming"), "entity_id", "left")
    return out.join(n, "entity_id", "left").withColumn("n_datasets", F.coalesce("n_datasets", F.lit(0)))


def coverage(datasets: DataFrame, edges: DataFrame, translations: DataFrame) -> DataFrame:
    """Shares of datasets with an entity, with an English title, and with a place."""
    own = edges.groupBy("dataset_id").agg(F.max((F.col("kind") == "geographic_unit").cast("int")).alias("geo"))
    titled = translations.where("kind = 'title' and text <> ''").select(F.col("subject").alias("s")).distinct()
    at = datasets.select("id").join(own, F.col("id") == F.col("dataset_id"), "left").join(titled, F.col("id") == F.col("s"), "left")
    share = lambda c: F.avg(c.cast("int"))
    return at.agg(share(F.col("geo").isNotNull()).alias("with_entity"), share(F.col("s").isNotNull()).alias("with_english"), share(F.coalesce("geo", F.lit(0)) == 1).alias("georeferenced"))


def datasets_of_entity(edges: DataFrame, entity_id: str, limit: int = 50) -> DataFrame:
    """Recall anchored on an entity: its datasets in order of id, each with score 1. Lifecycle isn't asked."""
    at = edges.where(F.col("entity_id") == entity_id).select("dataset_id").distinct()
    return at.orderBy("dataset_id").limit(limit).withColumn("score", F.lit(1.0))
