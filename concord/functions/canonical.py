"""Canonical text of values and content hashes of rows, as SQL text.

A content hash identifies the values of a row across columns of different types and across sides. The text form of each
column is injective, NULL has a marker of its own, and the separator is escaped inside text, so two rows share a hash
only when all their values are equal.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

from concord.functions.columns import quote, text

# Field separator (ASCII unit separator), its escaped form, and the marker of a NULL field.
SEPARATOR = "\x1f"
ESCAPED_SEPARATOR = "\\s"
NULL_MARKER = "\\N"
NULL_DISPLAY = "NULL"

_NESTED = (T.ArrayType, T.StructType, T.MapType)
_TEXT = (T.StringType, T.CharType, T.VarcharType)
#: Options under which JSON keeps NULL fields and the whole fraction of a second.
JSON_OPTIONS = (
    "map('ignoreNullFields', 'false', 'timestampFormat', \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\", "
    "'timestampNTZFormat', \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
)


def holds_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.MapType):
        return True
    if isinstance(data_type, T.ArrayType):
        return holds_map(data_type.elementType)
    return isinstance(data_type, T.StructType) and any(holds_map(field.dataType) for field in data_type)


def comparable(column: str, data_type: T.DataType, depth: int = 0) -> str:
    """A value that can be compared, joined, grouped and sorted: maps, at any depth, as arrays of their sorted entries."""
    if not holds_map(data_type):
        return column
    item = f"x{depth}"
    if isinstance(data_type, T.ArrayType):
        return f"transform({column}, {item} -> {comparable(item, data_type.elementType, depth + 1)})"
    if isinstance(data_type, T.StructType):
        fields = ", ".join(
            f"{text(field.name)}, {comparable(quote(field.name, column), field.dataType, depth)}" for field in data_type
        )
        return f"IF({column} IS NULL, NULL, named_struct({fields}))"
    value = comparable(f"{item}.value", data_type.valueType, depth + 1)
    return f"sort_array(transform(map_entries({column}), {item} -> named_struct('key', {item}.key, 'value', {value})))"


def comparable_type(data_type: T.DataType) -> T.DataType:
    """The type of :func:`comparable`."""
    if not holds_map(data_type):
        return data_type
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(comparable_type(data_type.elementType), data_type.containsNull)
    if isinstance(data_type, T.StructType):
        return T.StructType([T.StructField(f.name, comparable_type(f.dataType), f.nullable) for f in data_type])
    fields = [T.StructField("key", data_type.keyType), T.StructField("value", comparable_type(data_type.valueType))]
    return T.ArrayType(T.StructType(fields))


def _nested_text(column: str, data_type: T.DataType, depth: int) -> str:
    """Text of a value inside another one: never NULL. Texts stand in quotes, so that no text looks like a bracket, a comma
    or a missing value; fields of a struct go by position, entries of a map in the order of their texts."""
    item = f"x{depth}"
    if isinstance(data_type, T.ArrayType):
        parts = f"transform({column}, {item} -> {_nested_text(item, data_type.elementType, depth + 1)})"
        value = f"concat('[', array_join({parts}, ','), ']')"
    elif isinstance(data_type, T.MapType):
        entry = (
            f"concat({_nested_text(item + '.key', data_type.keyType, depth + 1)}, ':', "
            f"{_nested_text(item + '.value', data_type.valueType, depth + 1)})"
        )
        value = f"concat('<', array_join(array_sort(transform(map_entries({column}), {item} -> {entry})), ','), '>')"
    elif isinstance(data_type, T.StructType):
        fields = [_nested_text(quote(field.name, column), field.dataType, depth) for field in data_type]
        value = f"concat('{{', concat_ws(','{''.join(', ' + field for field in fields)}), '}}')"
    elif isinstance(data_type, _TEXT):
        doubled = f"replace({column}, {text(chr(92))}, {text(chr(92) * 2)})"
        value = f"concat('\"', replace({doubled}, '\"', {text(chr(92) + chr(34))}), '\"')"
    else:
        value = plain_text(column, data_type)
    return f"IF({column} IS NULL, 'null', {value})"


def plain_text(column: str, data_type: T.DataType) -> str:
    """Text of a value in a fixed, locale-free format; NULL stays NULL. Equal values have equal text, other values other
    text: a float zero has no sign, a decimal no trailing zeros, and nested values follow the same rules at any depth."""
    as_string = f"CAST({column} AS STRING)"
    if isinstance(data_type, T.BinaryType):
        return f"hex({column})"
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return f"CASE WHEN {column} = 0 THEN '0.0' ELSE {as_string} END"
    if isinstance(data_type, T.DecimalType) and data_type.scale > 0:
        return f"trim(TRAILING '.' FROM trim(TRAILING '0' FROM CAST(CAST({column} AS DECIMAL(38, {data_type.scale})) AS STRING)))"
    if isinstance(data_type, T.TimestampNTZType):
        # The cast knows no time zone; the fraction is filled up to six digits.
        with_point = f"concat({as_string}, IF(contains({as_string}, '.'), '', '.'))"
        return f"rpad({with_point}, greatest(26, length({as_string})), '0')"
    if isinstance(data_type, T.TimestampType):
        # The offset keeps the two passes through a repeated hour apart.
        return f"date_format({column}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\")"
    if isinstance(data_type, _NESTED):
        return f"IF({column} IS NULL, NULL, {_nested_text(column, data_type, 0)})"
    return as_string


def canonical_text(column: str, data_type: T.DataType) -> str:
    """Text of a value for hashing: never NULL, and free of the separator."""
    value = plain_text(column, data_type)
    if isinstance(data_type, (*_TEXT, *_NESTED)):
        doubled = f"replace({value}, {text(chr(92))}, {text(chr(92) * 2)})"
        value = f"replace({doubled}, chr({ord(SEPARATOR)}), {text(ESCAPED_SEPARATOR)})"
    return f"coalesce({value}, {text(NULL_MARKER)})"


def content_hash(columns: Iterable[tuple[str, T.DataType]]) -> str:
    """Upper-case hex SHA-256 over the canonical text of the columns, in the given order."""
    texts = [canonical_text(column, data_type) for column, data_type in columns]
    return f"upper(sha2(concat_ws({', '.join([f'chr({ord(SEPARATOR)})', *texts])}), 256))"


def display_text(column: str, data_type: T.DataType) -> str:
    """What a person reads: hex for bytes, the word NULL for NULL, otherwise the value as text."""
    if isinstance(data_type, _NESTED):
        value = f"to_json({comparable(column, data_type)}, {JSON_OPTIONS})"
    elif isinstance(data_type, T.BinaryType):
        value = plain_text(column, data_type)
    else:
        value = f"CAST({column} AS STRING)"
    return f"coalesce({value}, {text(NULL_DISPLAY)})"
