"""Record projection and filtering, field catalogues and schema drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxalake.functions.once import select_once

# Fixed values that must equal the reference's for equal results:
# fields left out of the record, media and mini loads because they do not read.
BAD_RECORD_FIELDS = ("associatedsequences", "commonnames", "flags", "mediarecords", "recordids")
BAD_MEDIA_FIELDS = ("flags", "recordids", "records")
BAD_MINI_FIELDS = ("commonnames", "flags", "recordids", "mediarecords")
BAD_FIELDS = {"records": BAD_RECORD_FIELDS, "media": BAD_MEDIA_FIELDS, "mini": BAD_MINI_FIELDS}
COMPLEX = "COMPLEX"


def _ref(name: str) -> Column:
    """Column for a dotted field name (one struct level: ``data.dwc:eventDate``)."""
    parts = name.split(".", 1)
    c = F.col(f"`{parts[0]}`")
    return c.getField(parts[1]) if len(parts) == 2 else c


def exclude_fields(fields, bad=BAD_RECORD_FIELDS) -> list[str]:
    bad = set(bad)
    return [f for f in fields if f not in bad]


def select_fields(df: DataFrame, fields) -> DataFrame:
    """Project an include list; dotted names reach one struct level and are
    named as written. Catalyst prunes the scan to these (nested) columns."""
    return df.select(*[_ref(f).alias(f) for f in fields])


def _field_type(df: DataFrame, name: str):
    parts = name.split(".", 1)
    dt = df.schema[parts[0]].dataType
    if len(parts) == 2 and isinstance(dt, T.StructType):
        dt = dt[parts[1]].dataType
    return dt


def _term(c: Column, dt, value) -> Column:
    """Exact-term test of one field. Text is compared lower-cased (the index
    stores analysed terms); numbers and booleans are compared as typed values,
    which Parquet can push into its scan."""
    v = str(value).lower()
    if isinstance(dt, T.NumericType):
        try:
            num = int(v) if v.lstrip("+-").isdigit() else float(v)
        except ValueError:
            return F.lit(False)
        return c == F.lit(num)
    if isinstance(dt, T.BooleanType):
        return c == F.lit(v == "true") if v in ("true", "false") else F.lit(False)
    return F.lower(c.cast("string")) == v


def _element_term(dt, value):
    return lambda x: _term(x, dt, value)


def term_filter(df: DataFrame, terms: dict, exact_case: bool = False) -> DataFrame:
    """Conjunction of exact-term filters. Array fields match when any element does.

    ``exact_case``: text terms are compared as they are, which Parquet can push
    into its scan; else lower-cased, which it cannot."""
    cond = F.lit(True)
    for field, value in terms.items():
        c = _ref(field)
        dt = _field_type(df, field)
        if isinstance(dt, T.ArrayType):
            cond = cond & F.exists(c, _element_term(dt.elementType, value))
        elif exact_case and isinstance(dt, T.StringType):
            cond = cond & (c == F.lit(str(value)))
        else:
            cond = cond & _term(c, dt, value)
    return df.where(cond)


def as_array(df: DataFrame, fields) -> DataFrame:
    """Read the named fields as arrays: scalars become one-element arrays,
    nulls stay null, arrays pass."""
    out = df
    for f in fields:
        dt = df.schema[f].dataType
        if not isinstance(dt, T.ArrayType):
            out = out.withColumn(f, F.when(F.col(f).isNotNull(), F.array(F.col(f))))
    return out


def read_records(
    spark: SparkSession,
    path: str,
    fields=None,
    where: dict | None = None,
    array_fields=(),
    exclude=BAD_RECORD_FIELDS,
    fmt: str = "parquet",
    schema=None,
) -> DataFrame:
    """Records from any Spark source, filtered and projected.

    Filters are applied before the projection so Catalyst pushes them into
    the scan (``PushedFilters``) and reads only the projected columns. Give
    ``schema`` for JSON or CSV sources: inference would read all the data.
    """
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    df = r.load(path)
    if where:  # before scalars are wrapped, so the scan gets a plain filter
        df = term_filter(df, where)
    df = as_array(df, [f for f in array_fields if f in df.columns])
    if fields is None:  # no include list: every column but the known-bad ones
        return df.drop(*[c for c in exclude if c in df.columns])
    return select_fields(df, exclude_fields(fields, exclude))


# ---------------------------------------------------------------- catalogues


def _type_name(dt: T.DataType) -> str:
    return dt.typeName()


def schema_fields(df: DataFrame) -> list[tuple[str, str]]:
    """(field, type) from a DataFrame schema; one struct level is opened,
    nested fields are named ``parent.child``. Schema metadata, no data read."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += [(f"{f.name}.{c.name}", _type_name(c.dataType)) for c in f.dataType.fields]
        else:
            out.append((f.name, _type_name(f.dataType)))
    return out


def schema_fields_df(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame(schema_fields(df), "field string, type string")


_FIELD = "struct<fieldName: string, type: string>"
_PAIRS = "array<struct<field: string, type: string>>"


def catalog_fields(meta_docs: DataFrame, col: str = "value", types: bool = False) -> DataFrame:
    """Field list from field-metadata documents (one JSON object per row).

    A top-level key whose object has ``fieldName`` is a field; under ``data``
    every child with ``fieldName`` is ``data.<child>``. With ``types=True``:
    (field, type), where other nested keys are ``COMPLEX``. Each document
    and each value is parsed once.
    """
    top = meta_docs.select(F.explode(F.from_json(F.col(col), "map<string, string>")).alias("k", "v"))
    is_data = F.col("k") == "data"
    parsed = select_once(
        top,
        F.col("k"),
        F.when(~is_data, F.from_json("v", _FIELD)).alias("f"),
        F.when(is_data, F.from_json("v", f"map<string, {_FIELD}>")).alias("d"),
    )
    # one array of (field, type) per key, so the documents are read once
    own = F.col("f.fieldName")
    pair = lambda field, kind: F.struct(field.alias("field"), kind.alias("type"))
    if types:
        plain = F.array(pair(F.coalesce(own, F.col("k")), F.when(own.isNotNull(), F.col("f.type")).otherwise(F.lit(COMPLEX))))
    else:
        plain = F.when(own.isNotNull(), F.array(pair(F.col("k"), F.lit("")))).otherwise(F.array().cast(_PAIRS))
    named = F.filter(F.map_entries("d"), lambda e: e["value"]["fieldName"].isNotNull())
    if types:
        inner = F.transform(named, lambda e: pair(e["value"]["fieldName"], e["value"]["type"]))
    else:
        inner = F.transform(named, lambda e: pair(F.concat(F.lit("data."), e["key"]), F.lit("")))
    rows = parsed.select(F.explode(F.when(F.col("d").isNull(), plain).otherwise(inner)).alias("p"))
    return rows.select("p.field", "p.type").distinct() if types else rows.select("p.field").distinct()


def json_field_inventory(df: DataFrame, col: str) -> DataFrame:
    """Keys found in a JSON text column, with how many records carry each.
    For field discovery over data too big for schema inference."""
    return (
        df.select(F.explode(F.json_object_keys(F.col(col))).alias("field"))
        .groupBy("field")
        .agg(F.count(F.lit(1)).cast("bigint").alias("n_records"))
    )


def field_drift(left: DataFrame, right: DataFrame, left_name: str = "meta", right_name: str = "table") -> DataFrame:
    """``field::type`` entries found on one side only, tagged with that side."""

    def entries(df, right):
        entry = F.concat_ws("::", "field", "type").alias("entry")
        return df.select(entry, F.lit(right).alias("right"))

    sides = entries(left, False).unionByName(entries(right, True)).groupBy("entry").agg(
        F.max(~F.col("right")).alias("in_left"), F.max("right").alias("in_right")
    )
    only = F.when(F.col("in_left"), F.lit(left_name)).otherwise(F.lit(right_name))
    return sides.where(F.col("in_left") != F.col("in_right")).select("entry", only.alias("only_in"))


def probe_fields(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """One pass over the data: per field, values present that do not read as
    the expected type. Output: field, expected, n_present, n_bad, ok."""
    aggs = []
    for i, (name, typ) in enumerate(expected.items()):
        c = F.col(f"`{name}`")
        present = c.isNotNull() & (F.trim(c.cast("string")) != "")
        bad = present & F.trim(c.cast("string")).try_cast(typ).isNull()
        aggs += [F.count_if(present).alias(f"p_{i}"), F.count_if(bad).alias(f"b_{i}")]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{n}', '{t}', p_{i}, b_{i}" for i, (n, t) in enumerate(expected.items()))
    long = wide.selectExpr(f"stack({len(expected)}, {pairs}) as (field, expected, n_present, n_bad)")
    return long.select(
        "field",
        "expected",
        F.col("n_present").cast("bigint").alias("n_present"),
        F.col("n_bad").cast("bigint").alias("n_bad"),
        (F.col("n_bad") == 0).alias("ok"),
    )
