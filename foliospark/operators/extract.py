"""Typed extraction: fields, coercion, reconciliation of what several chunks say, the wide table."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that stand for a missing value, and words that answer yes or no.
PLACEHOLDERS = ["null", "na", "n/a", "none"]
YES, NO = ["true", "yes", "y", "1"], ["false", "no", "n", "0", "none"]
#: Words that scale the number before them.
SCALES = "hundreds?|thousands?|millions?|billions?|trillions?|lakhs?|crores?"
TYPES = {"string": T.StringType(), "enum": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}
RESERVED = {"document", "document_id", "n_filled", "n_unverified", "conflicts", "status", "duplicate_of", "error"}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    description: str = ""
    values: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_.]*", self.name) or self.name.endswith("__quote") or self.name in RESERVED:
            raise ValueError(f"{self.name!r} cannot name a field")
        if self.type not in TYPES:
            raise ValueError(f"no field type {self.type!r}")
        if (self.type == "enum") != bool(self.values):
            raise ValueError("an enum needs values, and only an enum has them")


def check_fields(fields: list[Field]) -> list[Field]:
    names = [f.name.lower() for f in fields]
    if not fields or len(set(names)) != len(names):
        raise ValueError("fields need different names, and at least one")
    return fields


def reply_schema(fields: list[Field]) -> T.StructType:
    """Struct that a JSON reply is read with: every field as text, and its quotation."""
    return T.StructType([T.StructField(n, T.StringType()) for f in fields for n in (f.name, f"{f.name}__quote")])


def json_schema(fields: list[Field]) -> dict:
    """JSON Schema of a reply; every field may be null."""
    kinds = {"enum": "string"}
    out = {}
    for f in fields:
        out[f.name] = {"type": [kinds.get(f.type, f.type), "null"], "description": f.description}
        if f.values:
            out[f.name]["enum"] = [*f.values, None]
        out[f"{f.name}__quote"] = {"type": ["string", "null"]}
    return {"type": "object", "properties": out, "required": list(out), "additionalProperties": False}


def _is_word(value: Column, words: list[str]) -> Column:
    return F.lower(F.trim(value)).isin(*words)


def _bind(value: Column, run) -> Column:
    """``run`` over a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), run)[0]


def numeric_token(value: Column, exponent: bool) -> Column:
    """The one number in a text: thousands commas checked, "0,85" a fraction, none if a scale word follows."""
    e = r"(?:[eE][-+]?[0-9]+)?" if exponent else ""
    run = rf"[-+]?(?:[0-9]|\.[0-9])[0-9.,]*{e}"
    scale = rf"(?i)^\s*(?:{SCALES})(?![a-z])|^[km](?![a-z])|^\s?(?:bn|mn)(?![a-z])"

    def number(body: Column) -> Column:
        mantissa = F.regexp_replace(F.regexp_extract(body, r"^[-+]?([0-9.,]+)", 1), r"[.,]+$", "")
        plain, thousands, fraction = r"^(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)$", r"^[1-9][0-9]{0,2}(?:,[0-9]{3})+(?:\.[0-9]+)?$", r"^0,[0-9]+$"
        text = lambda m: F.when(m.rlike(plain), body).when(m.rlike(thousands), F.replace(body, F.lit(","), F.lit(""))).when(m.rlike(fraction), F.replace(body, F.lit(","), F.lit(".")))
        return _bind(mantissa, text).try_cast("double")

    def one(folded: Column) -> Column:
        found = F.regexp_extract_all(folded, F.lit(f"({run})"), F.lit(1))
        single = lambda f: F.when((F.size(f) == 1) & ~F.regexp_extract(folded, rf"{run}(.*)$", 1).rlike(scale), _bind(F.regexp_replace(f[0], r"[.,]+$", ""), number))
        return _bind(found, single)

    return F.when(value.isNotNull(), _bind(F.regexp_replace(value, "[\\u2010-\\u2013\\u2212\\ufe63\\uff0d]", "-"), one))


def coerce(value: Column, field: Field) -> Column:
    """A reply's text as the field's type; null where it is not one."""
    text = F.when(F.trim(value) != "", value)
    if field.type == "enum":
        return F.when(text.isin(*field.values), text)
    text = F.when(~_is_word(text, ["not reported"]), text)
    if field.type == "string":
        return text
    text = F.when(~_is_word(text, PLACEHOLDERS), text)
    if field.type == "boolean":
        bare = F.regexp_replace(text, r"[.!]+\s*$", "")
        return F.when(_is_word(bare, YES), True).when(_is_word(bare, NO), False)
    number = numeric_token(text, field.type == "number")
    number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    if field.type == "number":
        return number
    return F.when((number == F.floor(number)) & (F.abs(number) < 9e18), number.cast("bigint"))


def value_key(value: Column) -> Column:
    """What makes two values of a field the same: case and white space do not."""
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))


def reconcile(hits: DataFrame) -> DataFrame:
    """One row a document and field from hits(document, chunk_id, field, value[, supported]).

    The value first stated in chunk order stands; a chunk whose quotation supports the value represents it.
    conflicts lists the different values in the order they were first stated, if there is more than one.
    """
    supported = F.col("supported") if "supported" in hits.columns else F.lit(False)
    stated = hits.filter(F.col("value").isNotNull()).withColumn("key", value_key(F.col("value"))).withColumn("ok", F.coalesce(supported, F.lit(False)))
    each = stated.groupBy("document", "field", "key").agg(
        F.min("chunk_id").alias("first"), F.min_by("value", "chunk_id").alias("value"), F.min_by("chunk_id", F.struct(~F.col("ok"), F.col("chunk_id"))).alias("shown_by"), F.max("ok").alias("supported"),
    )
    rows = each.groupBy("document", "field").agg(F.array_sort(F.collect_list(F.struct("first", "key", "value", "shown_by", "supported"))).alias("v"))
    return rows.select(
        "document", "field", F.col("v")[0]["value"].alias("value"), F.col("v")[0]["shown_by"].alias("chunk_id"), F.size("v").alias("n_values"),
        F.when(F.size("v") > 1, F.array_join(F.transform("v", lambda x: x["value"]), " | ")).alias("conflicts"), F.col("v")[0]["supported"].alias("supported"),
    )


def extraction_table(reconciled: DataFrame, fields: list[Field]) -> DataFrame:
    """document, a typed column a field, n_filled, n_unverified, conflicts (names of fields in conflict)."""
    check_fields(fields)
    at = lambda f: F.max(F.when(F.col("field") == f.name, F.col("value"))).alias(f"_{f.name}")  # noqa: E731  one row a document and field
    wide = reconciled.groupBy("document").agg(
        *[at(f) for f in fields],
        F.sum(F.when(~F.coalesce(F.col("supported"), F.lit(False)), 1).otherwise(0)).alias("n_unverified"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("n_values") > 1, F.col("field")))), ", ").alias("conflicts"),
    )
    typed = wide.select("document", *[coerce(F.col(f"`_{f.name}`"), f).alias(f.name) for f in fields], "n_unverified", "conflicts")
    filled = sum((F.col(f"`{f.name}`").isNotNull().cast("int") for f in fields), F.lit(0))
    return typed.select("document", *[F.col(f"`{f.name}`") for f in fields], filled.alias("n_filled"), "n_unverified", "conflicts")


def parse_replies(replies: DataFrame, fields: list[Field]) -> DataFrame:
    """hits(document, chunk_id, field, value, quote) from replies(document, chunk_id, reply JSON), unreadable ones left out."""
    parsed = replies.withColumn("r", F.from_json("reply", reply_schema(fields), {"mode": "PERMISSIVE"}))
    rows = F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f"r.`{f.name}`").alias("value"), F.col(f"r.`{f.name}__quote`").alias("quote")) for f in fields])
    long = parsed.select("document", "chunk_id", F.explode(rows).alias("h")).select("document", "chunk_id", "h.*")
    return long.filter(F.col("value").isNotNull())
