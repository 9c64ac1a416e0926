"""IP literals in their compressed text form, as plain expressions.

IPv6 text runs through higher-order functions, but only for values that hold a
colon; IPv4 is one regular expression. No Python is involved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats.
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}\z"
_HEX_GROUP = r"^[0-9a-f]{1,4}\z"


def is_ipv4(text: Column) -> Column:
    return text.rlike(IPV4)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name an intermediate value, so that the expression does not repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hex_pair(octets: Column) -> Column:
    """Four decimal octets as two hex groups."""
    word = lambda at: F.lower(F.hex(octets[at].cast("int") * 256 + octets[at + 1].cast("int")))
    return F.concat_ws(":", word(0), word(2))


def _without_dotted_tail(address: Column) -> Column:
    """Rewrite a trailing dotted quad as two hex groups; NULL when it is not valid."""

    def rewrite(tail: Column) -> Column:
        prefix = address.substr(F.lit(1), F.length(address) - F.length(tail))
        return F.when(~tail.contains("."), address).when(
            is_ipv4(tail), F.concat(prefix, _hex_pair(F.split(tail, r"\.")))
        )

    return _bind(F.substring_index(address, ":", -1), rewrite)


def _groups(part: Column) -> Column:
    return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))


def _eight_groups(plain: Column) -> Column:
    """The eight groups without leading zeros, NULL where the shape is wrong."""
    one_side = lambda side: F.when(F.size(side) == 8, side)

    def two_sides(pair: Column) -> Column:
        missing = F.lit(8) - F.size(pair[0]) - F.size(pair[1])
        return F.when(
            missing >= 1, F.concat(pair[0], F.array_repeat(F.lit("0"), missing), pair[1])
        )

    def fill(sides: Column) -> Column:
        return F.when(F.size(sides) == 1, _bind(_groups(sides[0]), one_side)).when(
            F.size(sides) == 2, _bind(F.transform(sides, _groups), two_sides)
        )

    checked = lambda groups: F.when(
        F.forall(groups, lambda g: g.rlike(_HEX_GROUP)),
        F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")),
    )
    return _bind(_bind(F.split(plain, "::"), fill), checked)


def _squeeze(text: Column) -> Column:
    """Write the longest leftmost run of two or more zero groups as ``::``."""
    result = text
    for length in range(2, 9):  # a longer run wraps a shorter one, so it wins
        pattern = rf"^(|.*?:)0(?::0){{{length - 1}}}(|:.*)$"
        squeezed = F.concat(
            F.rtrim(F.regexp_extract(text, pattern, 1), F.lit(":")),
            F.lit("::"),
            F.ltrim(F.regexp_extract(text, pattern, 2), F.lit(":")),
        )
        result = F.when(text.rlike(pattern), squeezed).otherwise(result)
    return result


def _render(groups: Column) -> Column:
    """Text of eight groups; IPv4-mapped addresses end in dotted decimals."""
    octets = F.flatten(
        F.transform(
            F.slice(groups, 7, 2),
            lambda g: _bind(
                F.conv(g, 16, 10).cast("int"),
                lambda n: F.array(F.floor(n / 256).cast("string"), (n % 256).cast("string")),
            ),
        )
    )
    return _bind(
        F.array_join(groups, ":"),
        lambda text: F.when(
            text.startswith("0:0:0:0:0:ffff:"),
            F.concat(F.lit("::ffff:"), F.array_join(octets, ".")),
        ).otherwise(_squeeze(text)),
    )


def ipv6_text(address: Column) -> Column:
    """Compressed lower-case IPv6, NULL where the text is not an IPv6 literal."""

    def render(parts: Column) -> Column:  # address, zone
        bare = _bind(F.lower(parts[0]), _without_dotted_tail)
        text = _bind(_eight_groups(bare), _render)
        return F.when(F.size(parts) == 1, text).when(
            (F.size(parts) == 2) & (parts[1] != ""), F.concat(text, F.lit("%"), parts[1])
        )

    return _bind(F.split(address, "%"), render)


def ip_text(address: Column) -> Column:
    """Canonical text of an IPv4 or IPv6 literal, NULL for anything else."""
    return F.when(is_ipv4(address), address).when(address.contains(":"), ipv6_text(address))
