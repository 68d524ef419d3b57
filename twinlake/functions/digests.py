"""Content digests and the synthetic digests of name and near-content groups."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_BYTES = 4096


def full_digest(content: Column) -> Column:
    """SHA-256 of all content, lower-case hex; null content is empty."""
    return F.sha2(F.coalesce(content.cast("binary"), F.lit(b"")), 256)


def sample_digest(content: Column) -> Column:
    """SHA-256 of the first ``SAMPLE_BYTES`` bytes."""
    return F.sha2(F.substring(F.coalesce(content.cast("binary"), F.lit(b"")), 1, SAMPLE_BYTES), 256)


def covers_whole_file(size: Column) -> Column:
    return size <= SAMPLE_BYTES


def synthetic_digest(kind: str, key: Column) -> Column:
    """A digest for groups that are keyed by something other than content; ``kind`` keeps kinds apart."""
    return F.sha2(F.concat(F.lit(f"twinlake:{kind}:"), key), 256)


def parse_digest(text: str) -> bytes:
    """64 hex characters of either case."""
    if not re.fullmatch("[0-9a-fA-F]{64}", text):
        raise ValueError(f"not a digest: {text!r}")
    return bytes.fromhex(text)


def parse_algorithm(name: str) -> str:
    found = name.strip().lower() or "sha256"
    if found not in ("sha256", "blake3"):
        raise ValueError(f"unknown hash algorithm: {name!r}")
    return found
