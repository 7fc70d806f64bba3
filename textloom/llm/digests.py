"""Checksums of document numbers in DuckDB SQL."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """A DuckDB expression for the unsigned CRC-32 of an ASCII string, bit by bit; null for null."""
    of_bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    return f"CASE WHEN {text} IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: {of_bits}), 4294967295) END"
