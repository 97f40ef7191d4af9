"""What semi-structured answers state, whatever their shape: variants looked into by kind, so that no schema is asked of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from . import verification as V


def kind(v: Column) -> Column:
    """object, array, scalar or null of a variant; null for no variant (broken text)."""
    t = F.schema_of_variant(v)
    return F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "VOID", "null").when(t.isNotNull(), "scalar")


def _text(v: Column) -> Column:
    """A scalar as text, anything nested as JSON; null, false, zero and empty ones count as nothing."""
    k = kind(v)
    told = F.when(k == "scalar", F.try_variant_get(v, "$", "string")).when(k.isin("object", "array"), F.to_json(v))
    nothing = told.isin("", "[]", "{}") | (told == "false") & (F.schema_of_variant(v) == "BOOLEAN") | (F.schema_of_variant(v) != "STRING") & (told.try_cast("double") == 0)
    return F.when(~F.coalesce(nothing, F.lit(False)), told)


def stated(answers: DataFrame, answer: str, listed: str, fields: list[str]) -> DataFrame:
    """answers without answer, and pos (from 1, in the list), field, value, quotes, shape: what a JSON text says of each of fields, for each object of its list.

    A field that is an object gives its value and its evidence (one quote or a list, of which only texts count); a scalar or a list gives a value without quotes, so that
    grounding rejects it; a field that is absent or empty gives neither.  Texts that are no JSON, lists that are none and items
    that are no objects give no rows.
    """
    keep = [c for c in answers.columns if c != answer]
    items = answers.select(*keep, F.posexplode(F.try_variant_get(F.try_parse_json(answer), f"$.{listed}", "array<variant>")).alias("pos", "item"))
    items = items.filter(kind(F.col("item")) == "object")
    looked = F.array(*[F.struct(F.lit(f).alias("field"), F.try_variant_get("item", f"$.{f}", "variant").alias("v")) for f in fields])
    x = items.withColumn("f", F.explode(looked)).select(*keep, (F.col("pos") + 1).cast("long").alias("pos"), "f.field", "f.v")
    k, inner, said = kind(F.col("v")), F.try_variant_get("v", "$.value", "variant"), F.try_variant_get("v", "$.evidence", "variant")
    many = F.transform(F.try_variant_get("v", "$.evidence", "array<variant>"), lambda e: F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string")))
    one = F.when(F.schema_of_variant(said) == "STRING", F.array(F.try_variant_get(said, "$", "string")))
    quotes = F.filter(F.coalesce(many, one), lambda q: F.coalesce(q != "", F.lit(False)))
    value = F.when(k == "object", _text(inner)).otherwise(_text(F.col("v")))
    return x.select(*keep, "pos", "field", value.alias("value"), F.when(k == "object", quotes).alias("quotes"), F.coalesce(k, F.lit("absent")).alias("shape"))


def accepted(claims: DataFrame, key: list[str]) -> DataFrame:
    """key, name and fields (grounded ones, a map) of the schemes that become records: their name is grounded and is that of an offer of money.

    claims: key, field, value, quotes, page (the title in front of the text), links.  A scheme may repeat a field; its smallest grounded value stays.
    """
    told = claims.withColumn("g", V.ground_field(F.col("field"), F.col("value"), F.col("quotes"), F.col("page"), F.col("links")))
    once = told.filter("g.grounded").groupBy(*key, "field").agg(F.min("g.value").alias("value"))
    rows = once.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    name = F.col("fields")["name"]
    return rows.filter(name.isNotNull() & R.is_funding(name, F.col("fields")["amount"].isNotNull())).select(*key, name.alias("name"), "fields")


# Answers of the query, in SQL that both engines read: the kind of an event decides the shape of what it says.
_ANSWERS = """SELECT event_id, CASE event_type WHEN 'error' THEN concat('{"found": [', props) WHEN 'signup' THEN concat('{"found": ', props, '}') ELSE concat('{"found": [', CASE event_type
      WHEN 'click' THEN concat('{"name": {"value": "user ', CAST(user_id AS VARCHAR(20)), '", "evidence": ["seen ', CAST(user_id AS VARCHAR(20)), '", 7, ""]}, "k": ', CAST(user_id % 3 AS VARCHAR(20)), '}')
      WHEN 'view' THEN concat('{"name": "user ', CAST(user_id AS VARCHAR(20)), '", "k": {"value": ', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20)), ', "evidence": "as stated"}}, "text"')
      ELSE concat('[', props, '], {"k": [', CAST(user_id AS VARCHAR(20)), '], "name": {}}') END, ', ', props, ']}') END AS answer FROM events"""


def answer_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and k of every event's answer, with the shape in which it says them."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    told = stated(spark.sql(_ANSWERS), "answer", "found", ["name", "k"])
    return told.withColumn("quotes", F.array_join("quotes", "|"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"answer_shapes": answer_shapes}


def oracle_sql() -> dict[str, str]:
    return {
        "answer_shapes": f"""WITH a AS (SELECT event_id, CAST(answer AS JSON) AS j FROM ({_ANSWERS}) t WHERE json_valid(answer)),
  l AS (SELECT event_id, CAST(j->'$.found' AS JSON[]) AS items FROM a WHERE json_type(j, '$.found') = 'ARRAY'),
  i AS (SELECT event_id, generate_subscripts(items, 1) AS pos, unnest(items) AS item FROM l),
  f AS (SELECT event_id, pos, field, json_extract(item, '$.' || field) AS v FROM i CROSS JOIN (VALUES ('name'), ('k')) n(field) WHERE json_type(item) = 'OBJECT'),
  s AS (SELECT *, CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE CASE WHEN v IS NULL THEN 'absent' ELSE 'scalar' END END AS shape FROM f)
SELECT event_id, pos, field, shape, CASE WHEN nullif(x, '') IN ('0', '[]', '{{}}', 'false') THEN NULL ELSE nullif(x, '') END AS value, quotes FROM (
  SELECT *, CASE WHEN shape = 'object' THEN v->>'$.value' ELSE v->>'$' END AS x,
    CASE WHEN shape = 'object' AND json_type(v, '$.evidence') = 'ARRAY' THEN array_to_string(list_transform(list_filter(CAST(v->'$.evidence' AS JSON[]), lambda e: json_type(e) = 'VARCHAR' AND (e->>'$') <> ''), lambda e: e->>'$'), '|')
         WHEN shape = 'object' AND json_type(v, '$.evidence') = 'VARCHAR' THEN v->>'$.evidence' END AS quotes FROM s) t""",
    }
