"""CRC-32 in DuckDB SQL, for the queries whose contract names it."""

from __future__ import annotations

# The table follows from the polynomial; ``crc_table`` has one row with a list of 256 numbers.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM range(256) AS r(i))"""


def utf8(text: str) -> str:
    """SQL for the list of a text's bytes."""
    return f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"


def crc32(data: str) -> str:
    """SQL for the checksum of a list of bytes; ``crc`` has to be in scope."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])))"
