"""Strict JSON payloads as variants, and the coercion of one field to a declared type.

Every function takes and returns columns; a NULL result of a coercion means "rejected".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The accepted shapes of whole numbers and, in upper case, of RFC 3339 times with an offset.
WHOLE_NUMBER = r"^[+-]?[0-9]+\z"
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"


def parse_document(payload: Column) -> Column:
    """The payload as a variant, or NULL unless it is exactly one JSON document in valid UTF-8.

    The JSON reader stops after the first document, so junk behind it would pass. The document is
    therefore read as the first item of an array whose second and last item is a hash of the payload;
    :func:`is_document` checks both.
    """
    text = F.try_validate_utf8(payload.cast("string"))
    wrapped = F.concat(F.lit("["), text, F.lit(',"'), F.xxhash64(text).cast("string"), F.lit('"]'))
    return F.when(text.isNotNull(), F.try_parse_json(wrapped))


def is_document(doc: Column, payload: Column) -> Column:
    """Whether :func:`parse_document` read the whole payload and nothing more."""
    mark = F.try_variant_get(doc, "$[1]", "string")
    return F.coalesce(
        (mark == F.xxhash64(payload.cast("string")).cast("string"))
        & F.try_variant_get(doc, "$[2]", "variant").isNull(),
        F.lit(False),
    )


def field_path(path: str) -> str:
    """A dotted path (``$.a.b`` or ``a.b``, objects only) as a variant path into the parsed document."""
    steps = path.removeprefix("$.").split(".")
    quoted = []
    for step in steps:
        if not step or ("'" in step and '"' in step):
            raise ValueError(f"path {path!r} has a step that cannot be addressed")
        quote = '"' if "'" in step else "'"
        quoted.append(f"[{quote}{step}{quote}]")
    return "$[0]" + "".join(quoted)


def field_at(doc: Column, path: str) -> Column:
    """The value at a dotted path as a variant; NULL if the path is missing (a JSON null is not missing)."""
    return F.try_variant_get(doc, field_path(path), "variant")


def kind_of(field: Column) -> Column:
    """The JSON kind of a field: BIGINT, DECIMAL(p,s), DOUBLE, STRING, BOOLEAN, VOID, OBJECT<…> or ARRAY<…>."""
    return F.schema_of_variant(field)


def _fractional(kind: Column) -> Column:
    return (kind == "DOUBLE") | kind.startswith("DECIMAL")


def double_text(number: Column) -> Column:
    """Shortest decimal text of a double: plain digits from 1e-5 up to 1e16, a small ``e`` beyond.

    Older JVMs sometimes write digits too many. Longer texts are therefore rounded to 15, 16 and 17
    digits, and the first that reads back as the same number is taken.
    """
    text, size = number.cast("string"), F.abs(number)
    shorter = [F.format_string(f"%.{digits - 1}e", number) for digits in (15, 16, 17)]
    shortest = F.when(F.length(text) <= 16, text)
    for candidate in shorter[:2]:
        shortest = shortest.when(candidate.cast("double") == number, candidate)
    shortest = shortest.otherwise(shorter[2])
    plain = F.regexp_replace(shortest.try_cast("decimal(38,21)").cast("string"), r"(\.[0-9]+?)0*$", "$1")
    return (
        F.when(number == 0, F.lit("0.0"))
        .when((size >= 1e-5) & (size < 1e16), plain)
        .otherwise(F.regexp_replace(shortest, r"\.?0*[eE]\+?(-?)0*", "e$1"))
    )


def to_text(field: Column, kind: Column) -> Column:
    """Strings as they are, JSON null as the text ``null``, anything else as JSON text."""
    text, number = F.try_variant_get(field, "$", "string"), F.try_variant_get(field, "$", "double")
    # Whole numbers above 63 but within 64 bits keep their digits.
    unsigned = kind.isin("DECIMAL(19,0)", "DECIMAL(20,0)") & number.between(0, 2.0**64)
    return (
        F.when(_fractional(kind), F.when(unsigned, text).otherwise(double_text(number)))
        .when(kind == "VOID", F.lit("null"))
        .otherwise(text)
    )


def to_bigint(field: Column, kind: Column) -> Column:
    """A JSON integer in 64 bits, or a string of digits with an optional sign."""
    text = F.try_variant_get(field, "$", "string")
    return F.when(kind == "BIGINT", F.try_variant_get(field, "$", "bigint")).when(
        kind == "STRING", F.when(text.rlike(WHOLE_NUMBER), text.try_cast("bigint"))
    )


def to_double(field: Column, kind: Column) -> Column:
    """A JSON number that fits a double; never a string."""
    number = F.try_variant_get(field, "$", "double")
    return F.when(((kind == "BIGINT") | _fractional(kind)) & (F.abs(number) < F.lit(float("inf"))), number)


def to_boolean(field: Column, kind: Column) -> Column:
    return F.when(kind == "BOOLEAN", F.try_variant_get(field, "$", "boolean"))


def to_instant(field: Column, kind: Column) -> Column:
    """An RFC 3339 string with an offset; a plain cast would also take dates and times without one.

    No other kind of value has a text of this shape, so the kind need not be looked at.
    """
    text = F.upper(F.try_variant_get(field, "$", "string"))
    return F.when(text.rlike(RFC3339), text.try_cast("timestamp"))


# Declared type names, their Spark type and their coercion. Any other name means text.
DECLARED_TYPES = {
    "text": (T.StringType(), to_text),
    "json": (T.StringType(), to_text),
    "timestamptz": (T.TimestampType(), to_instant),
    "timestamp": (T.TimestampType(), to_instant),
    "int": (T.LongType(), to_bigint),
    "bigint": (T.LongType(), to_bigint),
    "float": (T.DoubleType(), to_double),
    "double": (T.DoubleType(), to_double),
    "boolean": (T.BooleanType(), to_boolean),
    "bool": (T.BooleanType(), to_boolean),
}


def spark_type(declared: str) -> T.DataType:
    return DECLARED_TYPES.get(declared, DECLARED_TYPES["text"])[0]


def coerce(field: Column, kind: Column, declared: str) -> Column:
    """The field as its declared type, NULL if the value does not qualify."""
    return DECLARED_TYPES.get(declared, DECLARED_TYPES["text"])[1](field, kind)
