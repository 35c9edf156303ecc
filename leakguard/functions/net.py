"""IP address and prefix expressions, all in built-in SQL functions.

Both families share one 128-bit form: 32 lower-case hex digits, IPv4 as
``::ffff:a.b.c.d``.  Fixed-width hex sorts in address order, so ranges and
their ends can be compared as text without any 128-bit number type.

Arguments are SQL expressions as text (usually a column name).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOTTED = f"{_OCTET}(?:[.]{_OCTET}){{3}}"
_HEXTETS = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
_FULL = "^[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}$"
_SHORT = f"^(?:{_HEXTETS})?::(?:{_HEXTETS})?$"
_MAPPED = "0" * 20 + "ffff"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` computed once under ``name``; keeps plans small."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _is_v4(addr: str) -> str:
    return f"({addr} rlike '^{_DOTTED}$')"


def _v4_hex(addr: str) -> str:
    """Eight hex digits of dotted text."""
    octets = [
        f"substring_index({addr}, '.', 1)",
        f"substring_index(substring_index({addr}, '.', 2), '.', -1)",
        f"substring_index(substring_index({addr}, '.', -2), '.', 1)",
        f"substring_index({addr}, '.', -1)",
    ]
    n = " + ".join(f"try_cast({o} as bigint) * {256 ** (3 - i)}" for i, o in enumerate(octets))
    return f"lpad(lower(hex({n})), 8, '0')"


def _padded(hextets: str) -> str:
    """Colon-separated hextets -> their digits, each padded to four."""
    digits = f"array_join(transform(split({hextets}, ':'), x -> lpad(x, 4, '0')), '')"
    return f"if({hextets} = '', '', {digits})"


def _v6_hex(base: str) -> str:
    """32 hex digits of lower-case text without dots; "::" is at least one hextet."""
    left = _padded(f"substring_index({base}, '::', 1)")
    right = _padded(f"substring_index({base}, '::', -1)")
    colons = f"(length({base}) - length(replace({base}, ':', '')))"
    edges = f"(if(startswith({base}, '::'), 1, 0) + if(endswith({base}, '::'), 1, 0))"
    return (
        f"case when {base} rlike '{_FULL}' then {_padded(base)} "
        f"when {base} rlike '{_SHORT}' and {colons} - {edges} <= 7 "
        f"then concat(rpad({left}, 32 - length({right}), '0'), {right}) end"
    )


def _address_hex(addr: str) -> str:
    # runs per log line: no regex replacement unless the address is dotted IPv6
    base = f"lower(substring_index({addr}, '%', 1))"
    tail = f"substring_index({base}, ':', -1)"
    dotted = f"contains({addr}, '.')"
    # a dotted tail stands for the last two hextets
    plain = f"if({dotted}, regexp_replace({base}, '(?<=:){_DOTTED}$', '0:0'), {base})"
    v6 = f"concat(left({_v6_hex(plain)}, if({dotted}, 24, 32)), if({dotted}, {_v4_hex(tail)}, ''))"
    return (
        f"case when {_is_v4(addr)} then concat('{_MAPPED}', {_v4_hex(addr)}) "
        f"when contains({addr}, ':') and not endswith({addr}, '%') then {v6} end"
    )


def address_hex(addr: str) -> Column:
    """Address text -> 32 hex digits, NULL when it is not an address.

    A zone (``fe80::1%eth0``) is allowed on IPv6 only and has no part in the key.
    """
    return F.expr(_address_hex(addr))


def address_key(addr: str) -> Column:
    """Address text -> 16-byte bucket key."""
    return F.expr(f"unhex({_address_hex(addr)})")


def address_family(addr: str) -> Column:
    """4 for dotted text, 6 for anything else that is an address (S12)."""
    return F.expr(f"case when {_is_v4(addr)} then 4 when {addr} like '%:%' then 6 end")


def _v4_text(hex32: str) -> str:
    parts = ", ".join(f"conv(substr({hex32}, {25 + 2 * i}, 2), 16, 10)" for i in range(4))
    return f"concat_ws('.', {parts})"


def _v6_text(hex32: str) -> str:
    """Canonical text: lower case, the first longest zero run shortened."""
    hextets = ", ".join(
        f"regexp_replace(substr({hex32}, {1 + 4 * i}, 4), '^0{{1,3}}', '')" for i in range(8)
    )
    cases = []
    for n in range(8, 1, -1):
        run = ":" + "0:" * n
        at = f"locate('{run}', j)"
        cases.append(
            f"when {at} > 0 then concat(substr(j, 2, greatest({at} - 2, 0)), '::', "
            f"rtrim(':', substr(j, {at} + {len(run)})))"
        )
    text = f"case {' '.join(cases)} else trim(BOTH ':' FROM j) end"
    canonical = _let(f"concat(':', concat_ws(':', {hextets}), ':')", "j", text)
    return (
        f"if(startswith({hex32}, '{_MAPPED}'), concat('::ffff:', {_v4_text(hex32)}), {canonical})"
    )


def v4_text(hex32: str) -> Column:
    return F.expr(_v4_text(hex32))


def v6_text(hex32: str) -> Column:
    return F.expr(_v6_text(hex32))


def ban_prefix(
    key: str, family: str, v4_len: int, v6_len: int, unmap_v4: bool = False
) -> Column:
    """Network text for a 16-byte key; host bits are kept, the zone is not."""
    as_v4 = f"{family} = 4"
    if unmap_v4:
        as_v4 = f"({as_v4} or startswith(h, '{_MAPPED}'))"
    text = (
        f"if({as_v4}, concat({_v4_text('h')}, '/{v4_len}'), concat({_v6_text('h')}, '/{v6_len}'))"
    )
    return F.expr(_let(f"lower(hex({key}))", "h", text))


def parse_prefix(prefix: str) -> Column:
    """Prefix text -> struct(family, hex32, bits), NULL when it is not a prefix.

    ``bits`` counts from the start of the 128-bit form (IPv4 length + 96).
    """
    length = f"try_cast(regexp_extract({prefix}, '^[^/%]+/(0|[1-9][0-9]{{0,2}})$', 1) as int)"
    made = (
        "if(h is not null and n <= if(contains(a, ':'), 128, 32), "
        "named_struct('family', if(contains(a, ':'), 6, 4), 'hex32', h, "
        "'bits', if(contains(a, ':'), n, n + 96)), null)"
    )
    body = _let(_address_hex("a"), "h", _let(length, "n", made))
    return F.expr(_let(f"substring_index({prefix}, '/', 1)", "a", body))


def _edge(hex32: str, bits: str, high: bool) -> str:
    """Hex digits up to and including the one that the prefix end cuts through."""
    free = f"element_at(array(15, 7, 3, 1), {bits} % 4 + 1)"
    digit = f"cast(conv(substr({hex32}, {bits} div 4 + 1, 1), 16, 10) as int)"
    cut = f"(({digit} & (15 - {free})) {'| ' + free if high else ''})"
    return f"concat(substr({hex32}, 1, cast({bits} div 4 as int)), lower(hex({cut})))"


def range_lo(hex32: str, bits: str) -> Column:
    """First address of the prefix, 32 hex digits."""
    return F.expr(f"if({bits} >= 128, {hex32}, rpad({_edge(hex32, bits, False)}, 32, '0'))")


def range_hi(hex32: str, bits: str) -> Column:
    """Last address of the prefix, 32 hex digits."""
    return F.expr(f"if({bits} >= 128, {hex32}, rpad({_edge(hex32, bits, True)}, 32, 'f'))")


def successor(hex32: str) -> Column:
    """Next address as 33 hex digits, so that the last one has a successor too."""
    body = (
        "rpad(concat(substr(p, 1, length(p) - 1), "
        "translate(right(p, 1), '0123456789abcde', '123456789abcdef')), 33, '0')"
    )
    return F.expr(_let(f"rtrim('f', concat('0', {hex32}))", "p", body))


def hex33_bits(hex33: str) -> Column:
    """33 hex digits -> 132 binary digits."""
    pieces = ((1, 9), (10, 8), (18, 8), (26, 8))
    parts = ", ".join(
        f"lpad(conv(substr({hex33}, {at}, {n}), 16, 2), {4 * n}, '0')" for at, n in pieces
    )
    return F.expr(f"concat({parts})")


def bits_hex32(bits132: str) -> str:
    """SQL text: 132 binary digits (the first four zero) -> 32 hex digits."""
    parts = ", ".join(
        f"lpad(conv(substr({bits132}, {5 + 32 * i}, 32), 2, 16), 8, '0')" for i in range(4)
    )
    return f"lower(concat({parts}))"


def prefix_text(family: str, hex32: str, bits: str) -> Column:
    """Prefix text of the shared 128-bit form."""
    return F.expr(
        f"if({family} = 4, concat({_v4_text(hex32)}, '/', {bits} - 96), "
        f"concat({_v6_text(hex32)}, '/', {bits}))"
    )
