"""Keys: tags, internal keys, comparators as sort keys, separators, file names and status text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.codec import fixed, let, read_fixed
from strata.schema import VALUE


def pack_tag(seq: Column, vtype: Column) -> Column:
    return F.shiftleft(seq.cast("long"), 8).bitwiseOR(vtype.cast("long"))


def tag_seq(tag: Column) -> Column:
    return F.shiftrightunsigned(tag, 8)


def tag_type(tag: Column) -> Column:
    return tag.bitwiseAND(F.lit(255)).cast("int")


def internal_key(user_key: Column, seq: Column, vtype: Column) -> Column:
    """The key's bytes followed by the little-endian tag."""
    return F.concat(user_key, fixed(pack_tag(seq, vtype), 8))


def parse_internal_key(key: Column) -> Column:
    """(user_key, seq, vtype, is_valid); invalid if shorter than a tag or of an unknown type."""
    n = F.octet_length(key)
    tag = read_fixed(F.when(n >= 8, F.substring(key, n - 7, F.lit(8))), 8)
    parts = lambda t: F.struct(
        F.when(n >= 8, F.substring(key, F.lit(1), n - 8)).alias("user_key"),
        tag_seq(t).alias("seq"),
        tag_type(t).alias("vtype"),
        F.coalesce((n >= 8) & (tag_type(t) <= VALUE), F.lit(False)).alias("is_valid"),
    )
    return parts(tag)


def sort_key(comparator: str, user_key: Column) -> Column:
    """An order-preserving key: rows compare under ``comparator`` as their sort keys compare as bytes.

    ``bytewise`` is the key itself, ``reverse`` compares the reversed bytes, ``numeric`` takes the
    number in brackets, decimal or hexadecimal. Grouping by it makes keys equal that compare equal.
    """
    if comparator == "bytewise":
        return user_key
    if comparator == "reverse":
        return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(user_key), F.lit("(..)"), F.lit(1))), ""))
    if comparator == "numeric":
        text = user_key.cast("string")
        sixteen = F.conv(F.regexp_extract(text, r"\[0[xX]([0-9a-fA-F]+)\]", 1), 16, 10)
        number = F.when(text.rlike(r"^\[0[xX]"), sixteen).otherwise(F.regexp_extract(text, r"\[(\d+)\]", 1))
        return F.encode(F.lpad(number, 20, "0"), "UTF-8")
    raise ValueError(f"no comparator {comparator!r}; any order with a sort key can be added here")


def _byte(b: Column, i: Column) -> Column:
    return F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("int")


def _bumped(b: Column, i: Column) -> Column:
    """The first i bytes with the last of them one larger."""
    return F.concat(F.substring(b, F.lit(1), i - 1), F.unhex(F.lpad(F.hex(_byte(b, i) + 1), 2, "0")))


def shortest_separator(a: Column, b: Column) -> Column:
    """A short key s with a <= s < b: at the first unequal byte, that byte of ``a`` plus one, if it is
    below 0xff and stays below b's byte; otherwise ``a`` itself."""
    least = F.least(F.octet_length(a), F.octet_length(b))
    at = F.get(F.filter(F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))), 0)
    return let(at, lambda i: F.when(i.isNotNull() & (_byte(a, i) < 255) & (_byte(a, i) + 1 < _byte(b, i)), _bumped(a, i)).otherwise(a))


def short_successor(a: Column) -> Column:
    """A short key >= a: the first byte below 0xff plus one, and nothing after it; all-0xff keys stay."""
    n = F.octet_length(a)
    at = F.get(F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.hex(F.substring(a, i, F.lit(1))) != "FF"), 0)
    return let(at, lambda i: F.when(i.isNotNull(), _bumped(a, i)).otherwise(a))


#: File kinds by pattern; the number is the first group.
FILE_KINDS = (
    ("log", r"^(\d+)\.log$"),
    ("table", r"^(\d+)\.(?:ldb|sst)$"),
    ("temp", r"^(\d+)\.dbtmp$"),
    ("manifest", r"^MANIFEST-(\d+)$"),
    ("current", r"^CURRENT$"),
    ("lock", r"^LOCK$"),
    ("info", r"^LOG(?:\.old)?$"),
)


def file_kind(name: Column) -> Column:
    """The kind of a file of a store; null for foreign names."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(FILE_KINDS):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return out


def file_number(name: Column) -> Column:
    """The number in the name, 0 for names without one, null for foreign names and numbers beyond a long."""
    digits = F.regexp_extract(name, r"(\d+)", 1).try_cast("long")
    return F.when(file_kind(name).isin("log", "table", "temp", "manifest"), digits).when(file_kind(name).isNotNull(), F.lit(0).cast("long"))


def file_name(kind: str, number: Column) -> Column:
    six = F.lpad(number.cast("string"), 6, "0")
    six = F.when(F.length(number.cast("string")) > 6, number.cast("string")).otherwise(six)
    return {"log": F.concat(six, F.lit(".log")), "table": F.concat(six, F.lit(".ldb")), "temp": F.concat(six, F.lit(".dbtmp")), "manifest": F.concat(F.lit("MANIFEST-"), six)}[kind]


#: Status labels by code.
STATUS = {"OK": "OK", "NOT_FOUND": "NotFound: ", "CORRUPTION": "Corruption: ", "NOT_SUPPORTED": "Not implemented: ", "INVALID_ARGUMENT": "Invalid argument: ", "IO_ERROR": "IO error: "}


def status_text(code: Column, message: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, label in STATUS.items():
        out = F.when(code == k, F.lit(label) if k == "OK" else F.concat(F.lit(label), message)).otherwise(out)
    return out
