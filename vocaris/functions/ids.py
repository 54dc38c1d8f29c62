"""Identifiers and names of voiceprint collections and points."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespace of voiceprint point ids, and the form of a collection's name.
POINT_NAMESPACE = "b8a9cf6e-0000-4000-8000-5370656b4944"
COLLECTION = "^spkid_([0-9a-f]{24})_([0-9a-f]{24})$"


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 name-based UUID: SHA-1 of namespace and name, with version and variant set."""
    raw = F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "UTF-8"))
    h = F.sha1(raw)
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def speaker_point_id(speaker_id: Column) -> Column:
    return uuid5(POINT_NAMESPACE, speaker_id)


def parse_collection(name: Column) -> Column:
    """struct(organization_id, studio_collection_id, valid); the parts are null if the name isn't one."""
    safe = F.coalesce(name, F.lit(""))
    valid = safe.rlike(COLLECTION)
    part = lambda i: F.when(valid, F.regexp_extract(safe, COLLECTION, i))
    return F.struct(part(1).alias("organization_id"), part(2).alias("studio_collection_id"), valid.alias("valid"))


def payload_name(name: Column, person: Column) -> Column:
    """The display name; an empty one falls through to the older field."""
    return F.coalesce(F.when(name != "", name), person)
