"""Port and IPv4 expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsieve.functions.scalars import lenient_int

# Port sets behind the four port flags and the routing fallback.
DNS_PORTS = (53,)
HTTP_PORTS = (80, 8000, 8008, 8080, 8888)
TLS_PORTS = (443, 8443)
SSH_PORTS = (22,)
# The one port of each application where a table knows no alternatives.
SINGLE_PORTS = {"dns": (53,), "http": (80,), "https": (443,), "ssh": (22,)}

# IPv4 blocks that are not globally reachable (IANA special-purpose registry).
NON_GLOBAL_BLOCKS = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
)
# Two globally reachable addresses inside 192.0.0.0/24.
GLOBAL_EXCEPTIONS = ("192.0.0.9", "192.0.0.10")
# The three RFC 1918 blocks.
RFC1918_BLOCKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")

_OCTETS = r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$"


def port_class(port: Column) -> Column:
    """0 invalid, 1 well-known, 2 registered, 3 dynamic."""
    p = lenient_int(port)
    return (
        F.when(p.between(1, 1023), 1)
        .when(p.between(1024, 49151), 2)
        .when(p >= 49152, 3)
        .otherwise(0)
    )


def port_in(port: Column, ports: tuple[int, ...]) -> Column:
    return F.coalesce(lenient_int(port).isin(*ports), F.lit(False)).cast("int")


def port_flags(port: Column, ports: Mapping[str, tuple[int, ...]] = SINGLE_PORTS) -> dict[str, Column]:
    """``dport_is_<application>`` flags by the given ports."""
    return {f"dport_is_{name}": port_in(port, some) for name, some in ports.items()}


def ipv4_number(ip: Column) -> Column:
    """Address as an unsigned 32-bit number, null unless it is four decimal octets."""
    text = ip.cast("string")
    part = F.split(text, r"\.")
    octet = [part.getItem(i).try_cast("bigint") for i in range(4)]
    in_range = octet[0] <= 255
    for value in octet[1:]:
        in_range = in_range & (value <= 255)
    number = octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3]
    return F.when(text.rlike(_OCTETS), F.when(in_range, number))


def _block_bounds(block: str) -> tuple[int, int]:
    base, bits = block.split("/")
    a, b, c, d = (int(x) for x in base.split("."))
    low = a * 16777216 + b * 65536 + c * 256 + d
    return low, low + 2 ** (32 - int(bits)) - 1


def _in_blocks(number: Column, blocks: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for block in blocks:
        low, high = _block_bounds(block)
        test = test | number.between(low, high)
    return F.coalesce(test, F.lit(False))


def is_private(ip: Column) -> Column:
    """1 for any IPv4 address that is not globally reachable."""
    exceptions = ip.isin(*GLOBAL_EXCEPTIONS)
    return (_in_blocks(ipv4_number(ip), NON_GLOBAL_BLOCKS) & ~F.coalesce(exceptions, F.lit(False))).cast("int")


def is_rfc1918(ip: Column) -> Column:
    """1 for the three private ranges only; the narrower rule of the table encoder."""
    return _in_blocks(ipv4_number(ip), RFC1918_BLOCKS).cast("int")


def subnet24(ip: Column) -> Column:
    """First three dotted parts; text with fewer parts gives ``0.0.0``."""
    text = ip.cast("string")
    prefix = F.substring_index(text, ".", 3)
    return F.when(F.size(F.split(text, r"\.")) >= 3, prefix).otherwise(F.lit("0.0.0"))


def same_subnet24(left: Column, right: Column) -> Column:
    """Compares the prefixes themselves, so two subnets never collide."""
    return (subnet24(left) == subnet24(right)).cast("int")
