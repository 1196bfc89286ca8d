"""Content hashes and fingerprint distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacat.schema import ZERO_FINGERPRINT


def content_hash(content: Column, method: str = "sha256") -> Column:
    """Hash of the whole content: collision-proof SHA-256, or xxhash64 for speed."""
    if method == "sha256":
        return F.sha2(content, 256)
    if method == "xxhash64":
        return F.lpad(F.lower(F.hex(F.xxhash64(content))), 16, "0")
    raise ValueError(f"unknown hash method {method!r}")


def prefix_hash(content: Column, n: int = 1024) -> Column:
    """Hash of the first ``n`` bytes."""
    return F.sha2(F.substring(content, 1, n), 256)


def sampled_hash(content: Column, chunk: int = 1 << 20) -> Column:
    """Hash of head, middle and tail, or of everything up to three chunks."""
    size = F.octet_length(content)
    half = chunk // 2
    middle_start = F.floor(size / 2).cast("int") - half + 1
    sample = F.concat(
        F.substring(content, 1, chunk),
        F.substr(content, middle_start, F.lit(2 * half)),
        F.substring(content, -chunk, chunk),
    )
    return F.sha2(F.when(size <= 3 * chunk, content).otherwise(sample), 256)


def is_legacy_hash(value: Column) -> Column:
    """True for a 32-digit hex hash of an earlier catalogue version."""
    return F.coalesce(value.rlike(r"^[A-Fa-f0-9]{32}$"), F.lit(False))


def usable_fingerprint(value: Column) -> Column:
    """A full-length fingerprint that is not the undecodable marker."""
    return value.isNotNull() & value.rlike(r"^[01]{64}$") & (value != ZERO_FINGERPRINT)


def fingerprint_bits(value: Column) -> Column:
    """A 64-character bit string packed into one BIGINT."""
    def half(start):
        return F.conv(F.substring(value, start, 32), 2, 10).cast("bigint")

    return F.shiftleft(half(1), 32).bitwiseOR(half(33))


def hamming_bits(a: Column, b: Column) -> Column:
    """Differing bits of two packed fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of two bit strings; extra length counts as different."""
    packed = hamming_bits(fingerprint_bits(a), fingerprint_bits(b))
    common = F.least(F.length(a), F.length(b))
    spelled = F.aggregate(
        F.zip_with(
            F.split(F.substr(a, F.lit(1), common), ""),
            F.split(F.substr(b, F.lit(1), common), ""),
            lambda x, y: F.when(x != y, 1).otherwise(0),
        ),
        F.lit(0),
        lambda acc, x: acc + x,
    ) + F.abs(F.length(a) - F.length(b))
    return F.when((F.length(a) == 64) & (F.length(b) == 64), packed).otherwise(spelled)
