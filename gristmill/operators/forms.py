"""Typed input by a schema whose fields say, in their metadata, what they take: casts, choices, and a row's errors instead of a failed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

KINDS = {"text": StringType(), "textarea": StringType(), "select": StringType(), "number": LongType(), "bool": BooleanType()}
TRUE = ["1", "true", "yes", "on"]


def field(name: str, kind: str = "text", label: str = "", required: bool = False, editable: bool = True, default: str = "", options: tuple[str, ...] = ()) -> StructField:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    return StructField(name, KINDS[kind], True, {"kind": kind, "label": label or name, "required": required, "editable": editable, "default": default, "options": list(options)})


def described(spark: SparkSession, schema: StructType) -> DataFrame:
    """What a form shows of a schema: a row for each field, in order; fields without metadata are plain texts, numbers or truths by their type."""
    rows = []
    for i, f in enumerate(schema.fields):
        m = f.metadata
        kind = m.get("kind") or ("bool" if isinstance(f.dataType, BooleanType) else "text" if isinstance(f.dataType, StringType) else "number")
        rows.append((i, f.name, m.get("label", f.name), kind, m.get("required", False), m.get("editable", True), str(m.get("default", "")), list(m.get("options", []))))
    return spark.createDataFrame(rows, "ord int, name string, label string, kind string, required boolean, editable boolean, default string, options array<string>")


def _taken(f: StructField, x: Column) -> tuple[Column, Column]:
    """A field's value, and why it can't be taken (null if it can)."""
    kind, options = f.metadata["kind"], f.metadata["options"]
    given = F.coalesce(x, F.lit(""))
    if kind == "bool":
        value, bad = F.lower(F.trim(given)).isin(TRUE), F.lit(None)
    elif kind == "number":
        value = F.when(given == "", F.lit(0)).otherwise(F.regexp_replace(F.trim(given), "(?<=[0-9])_(?=[0-9])", "").try_cast("long"))
        # whole numbers alone: a cast would cut fractions off
        value = F.when((given == "") | F.trim(given).rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), value).cast("long")
        bad = F.when(value.isNull(), F.lit("not a whole number"))
    elif kind == "select":
        value = given
        bad = F.when(~given.isin(options), F.concat(F.lit("not one of "), F.lit(", ".join(options)))) if options else F.lit(None)
    else:
        value, bad = given, F.lit(None)
    if f.metadata["required"]:
        bad = F.coalesce(F.when(F.trim(given) == "", F.lit("required")), bad)
    return value, bad.cast("string")


def coerced(rows: DataFrame, schema: StructType) -> DataFrame:
    """rows with the schema's columns, texts before, as their types, and `errors`: field, value, reason of each value that can't be taken, which is null.

    A column that isn't there counts as its default; fields that aren't editable keep what stands there, as text is cast.
    """
    values, errors = [], []
    for f in schema.fields:
        x = F.col(f.name).cast("string") if f.name in rows.columns else F.lit(f.metadata["default"])
        value, bad = _taken(f, x)
        if not f.metadata["editable"]:
            bad = F.lit(None).cast("string")
        values.append(F.when(bad.isNull(), value).cast(f.dataType).alias(f.name, metadata=f.metadata))
        errors.append(F.when(bad.isNotNull(), F.struct(F.lit(f.name).alias("field"), x.alias("value"), bad.alias("reason"))))
    own = {f.name for f in schema.fields}
    return rows.select(*[c for c in rows.columns if c not in own], *values, F.array_compact(F.array(*errors)).alias("errors"))


def unknown_fields(changes: DataFrame, schema: StructType, name: str = "field") -> DataFrame:
    """Single changes (a row for each field) with the reason why one can't be made: no such field, or one that isn't editable; null if it can."""
    editable = [f.name for f in schema.fields if f.metadata.get("editable", True)]
    reason = F.when(~F.col(name).isin([f.name for f in schema.fields]), F.concat(F.lit("unknown field "), F.col(name))).when(~F.col(name).isin(editable), F.concat(F.col(name), F.lit(" can't be changed")))
    return changes.withColumn("reason", reason)
