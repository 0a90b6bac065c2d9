"""Identifiers and versions derived from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL namespace of name-based UUIDs, a fixed value.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def source_version(text: Column) -> Column:
    """sha256: and the digest of the UTF-8 text; null for null."""
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(text, "utf-8"), 256))


def uuid5(name: Column) -> Column:
    """The name-based UUID (version 5) of a name in the URL namespace, by native hashing."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"), F.lit(1))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def document_identity(file_type: Column, name: Column, version: Column) -> Column:
    """Identifier of a document by its type, name and version."""
    return uuid5(F.concat(F.lit("document:"), file_type, F.lit(":"), name, F.lit(":"), version))


def issue_identity(version: Column, rule_id: Column, start: Column, end: Column, original: Column) -> Column:
    """Identifier of an issue by the version of its text, its rule and its span."""
    return uuid5(F.concat_ws(":", version, rule_id, start.cast("string"), end.cast("string"), original))
