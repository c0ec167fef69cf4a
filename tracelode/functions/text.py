"""Text functions: key=value tokens, HTTP messages, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import latin1

# A value is a bare word or a quoted JSON string. The possessive repeats keep the matcher from recursing, so
# a value may have any length.
KV = r'(\w+)=("(?:[^"\\]++|\\.)*+"|\S+)'


def kv_keys(line: Column) -> Column:
    """Keys of a key=value line, last token first."""
    return F.reverse(F.regexp_extract_all(line, F.lit(KV), 1))


def kv_values(line: Column) -> Column:
    """Unquoted values in the order of ``kv_keys``."""
    return F.transform(F.reverse(F.regexp_extract_all(line, F.lit(KV), 2)), unquote)


def unquote(value: Column) -> Column:
    """A quoted JSON string without its quotes; other values stay. Escapes go the slow way."""
    escaped = F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(0))
    return (
        F.when(~F.startswith(value, F.lit('"')), value)
        .when(F.contains(value, F.lit("\\")), escaped)
        .otherwise(F.substring(value, F.lit(2), F.length(value) - 2))
    )


def kv_field(keys: Column, values: Column, field: str) -> Column:
    """The value of the last token with this key, or null."""
    return F.get(values, (F.array_position(keys, field) - 1).cast("int"))


def kv_rest(line: Column) -> Column:
    """What is left of a line once its tokens are taken out; empty for a clean line."""
    return F.trim(F.regexp_replace(line, KV, ""))


def http_parts(payload: Column) -> dict[str, Column]:
    """Request/response parts of one payload. Lengths are in bytes.

    ``header_bytes`` includes the blank line; it is null when there is none. ``header_list`` has every header line in
    order; in the map ``headers`` the last of several equal names counts. A line without a colon is no header.
    """
    text = latin1(payload)
    cut = F.locate("\r\n\r\n", text)
    found = cut > 0
    head = F.when(found, F.substring(text, F.lit(1), cut - 1))
    lines = F.split(head, "\r\n")
    pairs = F.transform(
        F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda v: F.contains(v, F.lit(":"))),
        lambda v: F.struct(
            F.substring_index(v, ":", 1).alias("key"),
            F.btrim(F.substring(v, F.locate(":", v) + 1, F.length(v)), F.lit(" \t")).alias("value"),
        ),
    )
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["key"] == n), -1)["value"])
    body = F.when(found, F.substring(text, cut + 4, F.length(text)))
    return {
        "request_line": F.get(lines, F.lit(0)),
        "headers": F.when(found, F.map_from_arrays(names, last)),
        "header_list": F.when(found, pairs),
        "payload_bytes": F.length(payload).cast("bigint"),
        "header_bytes": F.when(found, (cut + 3).cast("bigint")),
        "body_bytes": F.when(found, (F.length(payload) - cut - 3).cast("bigint")),
        "body": body,
    }


def header(headers: Column, name: str) -> Column:
    """The last header of this name in a ``header_list``, in any case; null if there is none."""
    return F.get(F.reverse(F.filter(headers, lambda h: F.lower(h["key"]) == name.lower())), F.lit(0))["value"]


def entropy_bits(text: Column) -> Column:
    """Shannon entropy per character. Row-local, so no shuffle."""
    chars = F.split(text, "")
    size = F.length(text)
    # Occurrences of a character = length lost when it is removed.
    return F.aggregate(
        F.transform(
            F.array_distinct(chars),
            lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size,
        ),
        F.lit(0.0),
        lambda acc, p: F.when(p > 0, acc - p * F.log2(p)).otherwise(acc),
    )


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1))
