"""Host names in HTTP requests and application names in paths, as expressions over bytes read as ISO-8859-1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def latin1(payload: Column) -> Column:
    """Bytes as characters, one for one."""
    return F.decode(payload, "ISO-8859-1")


def is_http_request(payload: Column) -> Column:
    return latin1(F.substring(payload, 1, 8)).rlike(r"^(GET|POST|PUT|HEAD|DELETE|OPTIONS|PATCH|CONNECT) ")


def http_host(payload: Column) -> Column:
    """The first Host header of the first 4096 bytes, lower-case; empty if missing, too long or not a name."""
    head = latin1(F.substring(payload, 1, 4096))
    host = F.regexp_extract(head, r"(?s)\n[Hh][Oo][Ss][Tt]: *([^\r\n:]*)", 1)
    return F.when((F.length(host) <= 253) & host.rlike(r"^[A-Za-z0-9._-]+$"), F.lower(host)).otherwise("")


def app_name_from_path(path: Column) -> Column:
    """The outermost ``X.app`` whose program is directly in Contents/MacOS, else the file's name."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    name = F.regexp_extract(path, r"^(?:.*?/)?([^/]*?)\.app/", 1)
    return F.when(path.rlike(r"/Contents/MacOS/[^/]*$") & (name != ""), name).otherwise(base)
