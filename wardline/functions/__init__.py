"""Column functions: all built from Spark's own expressions."""

from wardline.functions.net import canonical_host, ip_to_long, is_ipv4, is_private, mask_address, migrate_url, url_host
from wardline.functions.text import find_all, first_token, kv_extract, rewrite_line
from wardline.functions.times import elapsed_parts, expiry_date
from wardline.functions.versions import version_key, version_number

__all__ = [
    "canonical_host", "elapsed_parts", "expiry_date", "find_all", "first_token", "ip_to_long", "is_ipv4", "is_private", "kv_extract",
    "mask_address", "migrate_url", "rewrite_line", "url_host", "version_key", "version_number",
]
