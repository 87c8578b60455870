"""CRC-32 in DuckDB SQL, for check SQL of queries that hash."""

from __future__ import annotations

#: WITH entries that :func:`crc` needs: the table of the reflected polynomial, and the hexadecimal digits. One row each.
CRC_TABLES = """crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hexes AS (SELECT '0123456789abcdef' AS digits)"""


def crc(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a VARCHAR expression; ``crc_table`` and ``hexes`` must be in the same FROM."""
    byte = f"(instr(digits, lower(hex(encode({text})))[2 * i + 1]) - 1) * 16 + instr(digits, lower(hex(encode({text})))[2 * i + 2]) - 1"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({text}))), lambda i: ({byte})::BIGINT)), "
            f"lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")
