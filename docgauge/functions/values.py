"""Values of any JSON type in one shape, so that they can be compared.

A value is a struct (kind, text, items): kind is empty for a missing key and for null; text is what Python's str() gives;
items are the texts of a list, which nulls and nested values keep their places in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge.functions.parse import is_empty_text
from docgauge.functions.text import let

TYPE = "struct<kind:string,text:string,items:array<string>>"


def _scalar(v: Column, kind: Column) -> Column:
    as_text = F.try_variant_get(v, "$", "string")
    return F.when(kind == "BOOLEAN", F.initcap(as_text)).otherwise(as_text)


def value_of(document: Column, field: str | None = None) -> Column:
    """The value of a field of a variant object (or of the variant itself)."""
    v = document if field is None else F.try_variant_get(document, "$['" + field.replace("'", "\\'") + "']", "variant")
    return let(F.struct(v.alias("v"), F.schema_of_variant(v).alias("name")), lambda x: _typed(x["v"], x["name"]))


def _typed(v: Column, name: Column) -> Column:
    kind = (
        F.when(v.isNull() | (name == "VOID"), F.lit(None))
        .when(name == "STRING", F.lit("text"))
        .when(name == "BOOLEAN", F.lit("bool"))
        .when(name.startswith("ARRAY"), F.lit("list"))
        .when(name.startswith("OBJECT"), F.lit("object"))
        .otherwise(F.lit("number"))
    )
    elements = F.when(name.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    items = F.transform(elements, lambda e: F.when(F.schema_of_variant(e) == "VOID", F.lit(None)).otherwise(_scalar(e, F.schema_of_variant(e))))
    listed = lambda x: F.when(F.size(x) == 0, F.lit("[]")).otherwise(F.concat(F.lit("['"), F.array_join(x, "', '", "None"), F.lit("']")))
    return let(items, lambda x: F.struct(kind.alias("kind"), F.when(x.isNotNull(), listed(x)).otherwise(_scalar(v, name)).alias("text"), x.alias("items")))


def has_key(document: Column, field: str) -> Column:
    """Whether an object has the key, if only with null."""
    return F.try_variant_get(document, "$['" + field.replace("'", "\\'") + "']", "variant").isNotNull()


def is_empty(value: Column) -> Column:
    """Null, a blank or stand-in text, or a list or object without elements; numbers and booleans never are."""
    empty_list = (value["kind"] == "list") & (F.size(value["items"]) == 0)
    empty_object = (value["kind"] == "object") & (value["text"] == "{}")
    return F.coalesce(value["kind"].isNull() | ((value["kind"] == "text") & is_empty_text(value["text"])) | empty_list | empty_object, F.lit(True))
