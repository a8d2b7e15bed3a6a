"""Identity codecs: canonical key bytes, digests and ids, as column expressions.

Byte layouts are fixed: a bigint key is 01 01 00000008 and its eight big-endian bytes; a
tuple is 02, its arity in one byte, and per component a tag, a four-byte length and bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Component tags.
TAGS = {"bigint": "01", "uuid": "02", "text": "03"}
MAX_ARITY = 4


def _hex(text: str) -> Column:
    return F.unhex(F.lit(text))


def _big_endian(number: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("bigint")), 2 * size, "0"))


def component(value: Column, kind: str) -> Column:
    """Tag, length and bytes of one key component."""
    if kind == "bigint":
        raw, size = _big_endian(value, 8), F.lit(8)
    elif kind == "uuid":
        raw, size = F.unhex(F.replace(F.lower(value), F.lit("-"), F.lit(""))), F.lit(16)
    elif kind == "text":
        raw, size = F.encode(value, "UTF-8"), F.octet_length(value)
    else:
        raise ValueError(f"key components are bigint, uuid or text, not {kind}")
    return F.concat(_hex(TAGS[kind]), _big_endian(size, 4), raw)


def canonical_bigint(key: Column) -> Column:
    return F.concat(_hex("010100000008"), _big_endian(key, 8))


def canonical_tuple(parts: list[tuple[Column, str]]) -> Column:
    if not 1 <= len(parts) <= MAX_ARITY:
        raise ValueError(f"a key has 1 to {MAX_ARITY} components")
    return F.concat(_hex(f"02{len(parts):02x}"), *(component(c, k) for c, k in parts))


def canonical_subject(parts: list[tuple[Column, str]]) -> Column:
    """The layout for eligibility subjects: the arity takes four bytes after 02 02."""
    if not 1 <= len(parts) <= MAX_ARITY:
        raise ValueError(f"a key has 1 to {MAX_ARITY} components")
    return F.concat(_hex(f"0202{len(parts):08x}"), *(component(c, k) for c, k in parts))


def digest(version: str, canonical: Column) -> Column:
    """Lower-case hex SHA-256 of the rule version's 16 bytes and the canonical key."""
    return F.sha2(F.concat(_hex(version.replace("-", "")), canonical), 256)


def uuid_of(digest_hex: Column) -> Column:
    """The id in a digest's first 16 bytes: version nibble 8, RFC variant."""
    part = lambda start, size: F.substring(digest_hex, start, size)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def activation_id(version: str, canonical: Column) -> Column:
    return uuid_of(digest(version, canonical))


def surrogate(canonical: Column) -> Column:
    """The signed 64-bit number in the first eight bytes of the canonical key's SHA-256."""
    return F.conv(F.substring(F.sha2(canonical, 256), 1, 16), 16, -10).cast("bigint")


def event_key(version: Column, activation: Column, generation: Column, kind: Column, revision: Column) -> Column:
    """The idempotency key of a lifecycle event."""
    return F.sha2(F.concat_ws(":", version, activation, generation.cast("string"), kind, revision.cast("string")), 256)


def decision_activation(version: str, subject: Column, candidate: Column) -> Column:
    return uuid_of(F.sha2(F.concat(_hex(version.replace("-", "")), _big_endian(subject, 8), _big_endian(candidate, 8)), 256))


def support_id(rule_version: Column, activation: Column, generation: Column, revision: Column, fact: Column) -> Column:
    return uuid_of(F.sha2(F.concat_ws(":", rule_version, activation, generation.cast("string"), revision.cast("string"), fact), 256))
