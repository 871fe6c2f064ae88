"""Fields of application forms, and the options that answers choose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.functions.forms import TO_FILL, folded, option_names, repeat_cell
from tallysieve.functions.text import or_null, text
from tallysieve.operators.graph import saved


def logical_fields(elements: DataFrame, optional: str | None = None) -> DataFrame:
    """(form, key, kind, members) from form elements (form, pos, id, name, type).

    Radio buttons of one name are one field; every other element is its own, under
    its id or, without one, its name.  Cells of repeated groups are left out, and so
    are keys that match the pattern ``optional``.  ``pos`` is unique in a form;
    ``members`` are positions in order.
    """
    radio = F.coalesce(F.col("type") == "radio", F.lit(False))
    key = F.when(radio, text(F.col("name"))).otherwise(F.coalesce(or_null(F.col("id")), text(F.col("name"))))
    keyed = elements.select("form", "pos", key.alias("key"), F.when(radio, "radio").alias("kind"), F.when(~radio, F.col("pos")).alias("single"))
    kept = keyed.where(repeat_cell(F.col("key")).isNull())
    if optional is not None:
        kept = kept.where(~F.rlike("key", F.lit(optional)))
    return kept.groupBy("form", "key", "kind", "single").agg(F.sort_array(F.collect_list("pos")).alias("members")).drop("single")


def chosen_options(wanted: DataFrame, options: DataFrame) -> DataFrame:
    """(form, key, value, option) of wanted (form, key, value) among options (form, key, option).

    An option is chosen by one of its whole names; ``option`` is null if none has the
    value's name or more than one has.
    """
    left = wanted.select("form", "key", "value", folded(F.col("value")).alias("__name__"))
    right = options.select(F.col("form").alias("__form__"), F.col("key").alias("__key__"), "option")
    # Sizes are estimated before lists are exploded, so without the hint the options could be sent whole through the driver.
    at = (F.col("form") == F.col("__form__")) & (F.col("key") == F.col("__key__")) & F.array_contains(option_names(F.col("option")), F.col("__name__"))
    met = left.join(right.hint("merge"), at, "left")
    return met.groupBy("form", "key", "value").agg(F.when(F.min("option") == F.max("option"), F.min("option")).alias("option"))


def unfilled(profiles: DataFrame, key: str, profile: str) -> DataFrame:
    """(key, gaps): the paths of the leaves of JSON profiles that are still to be filled in; none for an unreadable profile, null for a null one.

    Profiles become variants; a round opens all objects and lists of one depth, so there
    are as many rounds as the deepest profile has levels.  A variant keeps an object's
    fields by name, so paths come by name, and those of a list by place.
    """
    spark = profiles.sparkSession
    level = profiles.select(F.col(key).alias("key"), F.try_parse_json(F.col(profile)).alias("value"), F.lit("").alias("path"), F.array().cast("array<string>").alias("place"))
    found = None
    while True:
        level = saved(level.where("value IS NOT NULL"))
        leaves = level.where(F.try_variant_get("value", "$", "string") == TO_FILL).select("key", "path", "place")
        found = leaves if found is None else found.union(leaves)
        inner = level.where(F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)"))
        if inner.isEmpty():
            break
        level = spark.sql(
            """SELECT p.key, e.value, CASE WHEN e.key IS NULL THEN concat(path, '[', e.pos, ']') WHEN path = '' THEN e.key ELSE concat(path, '.', e.key) END AS path,
            array_append(place, coalesce(e.key, lpad(e.pos, 10, '0'))) AS place FROM {inner} AS p, LATERAL variant_explode(p.value) AS e""",
            inner=inner,
        )
    gaps = found.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("gaps"))
    keys = profiles.select(F.col(key).alias("key"), F.col(profile).isNotNull().alias("there"))
    return keys.join(gaps, "key", "left").select(F.col("key").alias(key), F.when(F.col("there"), F.coalesce("gaps", F.array().cast("array<string>"))).alias("gaps"))
