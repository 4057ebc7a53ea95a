"""Addresses, hosts and URLs."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = f"^{_OCTET}([.]{_OCTET}){{3}}$"


def is_ipv4(ip: Column) -> Column:
    """True for a dotted address whose octets are all at most 255."""
    return ip.rlike(IPV4)


def ip_to_long(ip: Column) -> Column:
    """Address as a number; null if it is not a valid address."""
    octet = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).cast("long")
    number = octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4)
    return F.when(is_ipv4(ip), number)


def is_private(ip: Column) -> Column:
    """True for an address of a private, loopback or link-local network; null if it is not a valid address."""
    number = ip_to_long(ip)
    # Fixed values: (first address, prefix) of those networks.
    networks = ((10 << 24, 8), (127 << 24, 8), (169 << 24 | 254 << 16, 16), (172 << 24 | 16 << 16, 12), (192 << 24 | 168 << 16, 16))
    inside = [number.between(first, first + (1 << 32 - prefix) - 1) for first, prefix in networks]
    return reduce(or_, inside)


def mask_address(number: Column, prefix: Column) -> Column:
    """The network part of an address: its lowest 32 - prefix bits set to zero."""
    # SQL function form: the shift width is a column.
    return F.call_function("shiftleft", F.call_function("shiftright", number, F.lit(32) - prefix), F.lit(32) - prefix)


def url_host(url: Column) -> Column:
    """Lower-case host of an http(s) URL, empty if there is none."""
    return F.lower(F.regexp_extract(url, "https?://([^/?#:]+)", 1))


def canonical_host(col: Column) -> Column:
    """URL or host name -> lower-case host without scheme, user, port, path or leading ``www.``."""
    bare = F.regexp_replace(F.lower(F.trim(col)), "^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, "[/?#].*$", "")
    bare = F.regexp_replace(bare, "^.*@", "")
    bare = F.regexp_replace(bare, ":[0-9]+$", "")
    return F.regexp_replace(bare, "^www[.]", "")


def migrate_url(col: Column, old: tuple[str, int | None], new: tuple[str, int | None]) -> Column:
    """Move URLs from one (scheme, port) to another; URLs of other endpoints stay as they are.

    A port of None means that the URL names no port.
    """
    (old_scheme, old_port), (new_scheme, new_port) = old, new
    port = f":{old_port}" if old_port else ""
    pattern = f"^{re.escape(old_scheme)}://([^/?#:]+){port}([/?#].*)?$"
    target = f"{new_scheme}://$1{f':{new_port}' if new_port else ''}$2"
    return F.when(col.rlike(pattern), F.regexp_replace(col, pattern, target)).otherwise(col)
