"""Checks of answers against their grounding: citations, ghost ids, inflated counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shape of an id, words that make a number a least claim, and starts of the nouns that make it a claim about datasets.
ID = r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
LEADS = ["над", "повече от", "over", "more than"]
NOUNS = ["набор", "данни", "dataset"]
#: Characters between a number and its noun, at most, within one clause.
REACH = 25


def ids_in(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ID), F.lit(1)), F.lower)))


def ghost_ids(answer: Column, grounding: Column) -> Column:
    """Ids in an answer that its grounding doesn't hold."""
    return F.array_except(ids_in(answer), ids_in(grounding))


def claimed_numbers(text: Column) -> Column:
    """Numbers that a text claims to be exceeded in datasets: one behind a lead or before a plus, with a noun within REACH of it in its clause."""
    lead = "|".join(word.replace(" ", r"\s+") for word in LEADS)
    pattern = F.lit(rf"(?iu)(?:({lead})\s+)?(?<![A-Za-z0-9_])(\d+)(\s*\+)?(?=([^\n.]{{0,{REACH + max(map(len, NOUNS))}}}))")
    parts = [F.regexp_extract_all(F.coalesce(text, F.lit("")), pattern, F.lit(i)) for i in (1, 2, 3, 4)]
    found = F.arrays_zip(*[p.alias(name) for p, name in zip(parts, ("lead", "number", "plus", "tail"), strict=True)])

    def is_claim(x: Column) -> Column:
        at = [F.instr(F.lower(x["tail"]), noun) for noun in NOUNS]
        near = F.lit(False)
        for place in at:
            near = near | place.between(1, REACH + 1)
        return near & ((x["lead"] != "") | (x["plus"] != ""))

    return F.transform(F.filter(found, is_claim), lambda x: x["number"].cast("decimal(38,0)"))


def inflated_counts(answer: Column, grounding: Column) -> Column:
    """Claimed numbers of datasets above the number grounded, in order of the text."""
    return F.filter(claimed_numbers(answer), lambda n: n > F.size(ids_in(grounding)))


def valid_citations(cited: DataFrame, datasets: DataFrame) -> DataFrame:
    """First occurrence of each id that exists and is in scope. cited: (answer_id, position, dataset_id); datasets: those in scope, (id)."""
    real = cited.join(datasets.select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi")
    return real.groupBy("answer_id", "dataset_id").agg(F.min("position").alias("position"))
