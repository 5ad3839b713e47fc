"""Knowledge-base candidates: offline search tables, claims, homonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as t

#: Fixed value: the id of the home country.
HOME = "Q155"
CLAIMS = "map<string,array<struct<mainsnak:struct<datavalue:struct<value:struct<id:string>>>>>>"


def first_claim(claims: Column, prop: str) -> Column:
    """The first entity id among a property's claims."""
    return F.get(all_claims(claims, prop), F.lit(0))


def all_claims(claims: Column, prop: str) -> Column:
    found = F.coalesce(
        F.try_element_at(claims, F.lit(prop)), F.expr("cast(array() as array<struct<mainsnak:struct<datavalue:struct<value:struct<id:string>>>>>)"),
    )
    return F.filter(F.transform(found, lambda c: c["mainsnak"]["datavalue"]["value"]["id"]), lambda i: i.isNotNull())


def preferred_label(labels: Column) -> Column:
    """Of a map by language: Portuguese, then English, then any."""
    return F.coalesce(F.try_element_at(labels, F.lit("pt")), F.try_element_at(labels, F.lit("en")), F.get(F.map_values(labels), F.lit(0)))


def with_claims(entities: DataFrame) -> DataFrame:
    """entities: qid, labels (map), claims (JSON text) to qid, label, country, country_is_br, instance_of."""
    claims = F.from_json("claims", CLAIMS)
    rows = entities.withColumn("c", claims)
    country = first_claim(F.col("c"), "P17")
    return rows.select(
        "qid", preferred_label(F.col("labels")).alias("label"), country.alias("country"),
        F.coalesce(country == HOME, F.lit(False)).alias("country_is_br"), all_claims(F.col("c"), "P31").alias("instance_of"),
    )


def candidates(forms: DataFrame, base: DataFrame, *, limit: int = 7) -> DataFrame:
    """Up to `limit` candidates of each form (surface_norm, type): base entries (qid, name, place) of equal normal name.

    Each distinct name is looked up once, as one equi-join; the limit applies before the shuffle.
    """
    names = base.select(t.normalize("name").alias("surface_norm"), "qid", "place")
    found = forms.select("surface_norm", "type").distinct().join(names, "surface_norm")
    order = Window.partitionBy("surface_norm", "type").orderBy("place", "qid")
    found = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit)
    lists = found.groupBy("surface_norm", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "qid"))), lambda x: x["qid"]).alias("candidates"))
    return forms.join(lists, ["surface_norm", "type"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


def homonym_choice(chosen: Column, confidence: Column, offered: Column) -> Column:
    """A chosen id counts only if it was offered."""
    return F.when(F.array_contains(offered, chosen), F.struct(chosen.alias("qid"), confidence.alias("confidence")))


def single_home_candidate(candidates: Column) -> Column:
    """The id of the only candidate of the home country (array of structs qid, is_br), if there is one."""
    home = F.filter(candidates, lambda c: c["is_br"])
    return F.when(F.size(home) == 1, home[0]["qid"])
