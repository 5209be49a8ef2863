"""Identifiers: name-based UUIDs and content hashes as Column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own namespace; a kind's namespace is derived from it.
ROOT = uuid.uuid5(uuid.NAMESPACE_URL, "urn:signalcontext:ids")


def joined(*parts: Column) -> Column:
    """Parts with their byte lengths in front, so that their borders cannot be confused."""
    return F.concat(*(x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)))


def named_uuid(kind: str, *parts: Column) -> Column:
    """kind:uuid, a version 5 UUID of the parts in the kind's namespace."""
    space = F.unhex(F.lit(uuid.uuid5(ROOT, kind).hex))
    h = F.substring(F.sha1(F.concat(space, F.encode(joined(*parts), "utf-8"))), 1, 32)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.lit(f"{kind}:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))
