"""SQL that states hashes and checksums on its own, for ASCII keys: what the registered hash queries are held against."""

from __future__ import annotations

from stratakv.functions.sketch import M32, M64, R32, R64, SEED32, SEED64


def _let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _byte(key: str, at: str) -> str:
    return f"CAST(ascii({key}[{at} + 1]) AS UHUGEINT)"


def _murmur(key: str, bits: int, m: int, r: int, seed: int, last: tuple[int, int]) -> str:
    """Words of bits / 8 bytes, low byte first, then the rest as one; all modulo 2 ** bits."""
    width, number = bits // 8, lambda x: f"CAST('{x}' AS UHUGEINT)"
    times = lambda a: f"(({a}) * {number(m)}) % {number(1 << bits)}"
    word = lambda first, count: f"coalesce(list_reduce(list_transform(range({count}), lambda b: {_byte(key, f'{first} + b')} << CAST(8 * b AS UHUGEINT)), lambda s, y: s + y), {number(0)})"
    words = f"list_transform(range(strlen({key}) // {width}), lambda j: {word(f'{width} * j', width)})"
    mixed = _let(times("k"), "k1", times(f"xor(k1, k1 >> {r})"))
    step = times(f"xor(h, {mixed})") if bits == 64 else f"xor({times('h')}, {mixed})"
    start = f"xor({number(seed)}, ({number(m)} * CAST(strlen({key}) AS UHUGEINT)) % {number(1 << bits)})" if bits == 64 else f"xor({number(seed)}, CAST(strlen({key}) AS UHUGEINT))"
    body = f"list_reduce(list_prepend({start}, {words}), lambda h, k: {step})"
    rest = f"CASE WHEN strlen({key}) % {width} > 0 THEN {times(f'xor({body}, {word(f"{width} * (strlen({key}) // {width})", f"strlen({key}) % {width}")})')} ELSE {body} END"
    a, b = last
    return _let(_let(rest, "x", times(f"xor(x, x >> {a})")), "y", f"xor(y, y >> {b})")


def murmur64(key: str) -> str:
    """As an unsigned number."""
    return _murmur(key, 64, M64, R64, SEED64, (47, 47))


def murmur32(key: str) -> str:
    return _murmur(key, 32, M32, R32, SEED32, (13, 15))


def signed(value: str, bits: int) -> str:
    kind = "BIGINT" if bits == 64 else "INTEGER"
    return _let(f"CAST({value} AS HUGEINT)", "u", f"CAST(CASE WHEN u >= {1 << bits - 1} THEN u - {1 << bits} ELSE u END AS {kind})")


#: A common table `crc(tab)`: the 256 steps of the reflected CRC-32.
CRC = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END)) AS tab)"


def crc32(text: str) -> str:
    """Of an ASCII text, beside the table crc."""
    codes = f"list_transform(range(strlen({text})), lambda j: CAST(ascii({text}[j + 1]) AS UBIGINT))"
    return f"CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {codes}), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS BIGINT)"
