"""Fields of semi-structured attributes as the text that rules compare."""

from pyspark.sql import Column, DataFrame, functions as F


def _path(field: str) -> str:
    return '$["' + field.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def field_text(variant: Column, field: str) -> Column:
    """A field of a VARIANT object as text: texts as they are, numbers and booleans as JSON writes
    them, arrays as their texts joined by spaces (null if they hold none); else null."""
    value = F.try_variant_get(variant, _path(field), "variant")
    kind = F.schema_of_variant(value)
    texts = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    joined = F.array_join(F.transform(texts, lambda x: F.try_variant_get(x, "$", "string")), " ")
    return (
        F.when(kind.isin("STRING", "BOOLEAN", "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$"), F.try_variant_get(value, "$", "string"))
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.try_variant_get(value, "$", "double").cast("string"))
        .when(kind.startswith("ARRAY") & (F.size(texts) > 0), joined)
    )


def with_fields(artifacts: DataFrame, fields: dict[str, str], attrs: str = "attrs") -> DataFrame:
    """Artifacts with columns from fields of their JSON attributes, which are parsed once a row.
    ``fields`` maps new columns to field names; attributes that are no JSON give nulls."""
    parsed = F.transform(F.array(F.try_parse_json(attrs)), lambda v: F.struct(*(field_text(v, f).alias(c) for c, f in fields.items())))
    return artifacts.withColumn("_fields", parsed[0]).select(*artifacts.columns, "_fields.*")
