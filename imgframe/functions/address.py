"""Addresses of application entities: ``TITLE@host:port``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def parse(text: Column) -> Column:
    """struct<title, host, port>; the title is optional, a port that is no number of 16 bits is NULL."""
    def parts(t: Column) -> Column:
        title = F.when(t.contains("@"), F.substring_index(t, "@", 1))
        rest = F.when(t.contains("@"), F.regexp_replace(t, "^[^@]*@", "")).otherwise(t)
        port = F.when(rest.contains(":"), F.substring_index(rest, ":", -1)).try_cast("int")
        host = F.when(rest.contains(":"), F.regexp_replace(rest, ":[^:]*$", "")).otherwise(rest)
        return F.struct(title.alias("title"), host.alias("host"), F.when(port.between(0, 65_535), port).alias("port"))

    return let(text, parts)
