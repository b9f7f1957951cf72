"""JSON payloads whose fields are not known beforehand, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import quoted

#: Columns that a payload may turn into.
MOST_FIELDS = 1_000


def _object(column: str) -> Column:
    """A payload as a variant, null unless it is a JSON object."""
    value = F.try_parse_json(quoted(column))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def merged_schema(payloads: DataFrame, column: str) -> T.StructType:
    """The type that holds every payload: fields of all, numbers widened; text where payloads disagree, and for lists of objects.

    Fields are found level by level, an aggregate a level: a row a field comes to the driver, MOST_FIELDS at most."""
    spark = payloads.sparkSession
    level = payloads.select(F.array().cast("array<string>").alias("path"), _object(column).alias("v"))
    found: dict[tuple, tuple] = {}
    while True:
        kids = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.concat("path", F.array("key")).alias("path"), F.col("value").alias("v"))
        kids = kids.withColumn("object", F.schema_of_variant("v").startswith("OBJECT"))
        others = F.schema_of_variant_agg(F.when(~F.col("object"), F.col("v"))).alias("type")
        rows = kids.groupBy("path").agg(F.count_if("object").alias("objects"), others).limit(MOST_FIELDS + 1).collect()
        found |= {tuple(r["path"]): (r["objects"], r["type"]) for r in rows}
        if len(found) > MOST_FIELDS:
            raise ValueError(f"the payloads have more than {MOST_FIELDS} fields")
        if not any(r["objects"] for r in rows):
            return _struct(found, ())
        level = kids.filter("object").drop("object")


def _struct(found: dict[tuple, tuple], path: tuple) -> T.StructType:
    fields = []
    for at, (objects, said) in sorted(found.items()):
        if at[:-1] != path:
            continue
        if objects and said == "VOID":
            kind: T.DataType = _struct(found, at)
        elif objects or said in ("VOID", "VARIANT") or "OBJECT" in said or "VARIANT" in said or "VOID" in said:
            kind = T.StringType()
        else:
            kind = T._parse_datatype_string(said)
        fields.append(T.StructField(at[-1], kind))
    return T.StructType(fields)


def _ddl(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return "struct<" + ", ".join("`" + f.name.replace("`", "``") + "`: " + _ddl(f.dataType) for f in kind.fields) + ">"
    return kind.simpleString()


def _leaves(value: Column, kind: T.DataType, name: str) -> list[tuple[str, Column]]:
    if isinstance(kind, T.StructType) and kind.fields:
        return [leaf for f in kind.fields for leaf in _leaves(value.getField(f.name), f.dataType, f"{name}.{f.name}" if name else f.name)]
    return [(name, F.to_json(value) if isinstance(kind, T.StructType) else value)]


def normalised(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """df with a payload column replaced by a column a field, nested ones under dotted names; lists stay lists.

    A payload that is no JSON object gives nulls; fields where payloads disagree in type are text, objects among them as
    JSON. A name that df already has is an error, as are more than MOST_FIELDS fields."""
    kind = merged_schema(df, column)
    rest = [c for c in df.columns if c != column]
    if not kind.fields:
        return df.select([quoted(c) for c in rest])
    whole = df.withColumn("_payload", F.try_variant_get(_object(column), "$", _ddl(kind)))
    leaves = _leaves(F.col("_payload"), kind, prefix)
    names = [n for n, _ in leaves]
    if twice := sorted({n for n in [*names, *rest] if [*names, *rest].count(n) > 1}):
        raise ValueError(f"columns of the same name: {', '.join(twice)}")
    return whole.select(*[quoted(c) for c in rest], *[c.alias(n) for n, c in leaves])
