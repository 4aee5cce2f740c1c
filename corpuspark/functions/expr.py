"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of the model's name-based identifiers.
NAMESPACE = "7b3a2c1e-5d4f-4a8b-9c6e-1f2d3a4b5c6d"
#: Roles by rank, and the token separators.
ROLES = ("viewer", "editor", "admin", "owner")
SEPARATORS = r"[\s,，。.;；:：!！?？()（）\[\]]+"
SPACE = r"[\s 　  \u0085]"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The name-based (SHA-1) UUID of a string."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12)
    )


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two signed 64-bit fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))


def hex_to_signed(h: Column) -> Column:
    """16 hex digits as a signed long."""
    high, low = F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.conv(F.substring(h, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def signed_to_hex(n: Column) -> Column:
    return F.lpad(F.lower(F.hex(n)), 16, "0")


def tokens(text: Column) -> Column:
    """Lower-cased tokens; separators are white space and punctuation of both widths."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != "")


def bigrams(text: Column) -> Column:
    """Distinct character pairs of the lower-cased text without white space; a single character is itself."""
    s = F.regexp_replace(F.lower(text), SPACE + "+", "")
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2)))
    return F.when(F.length(s) >= 2, F.array_distinct(pairs)).when(F.length(s) == 1, F.array(s)).otherwise(F.array().cast("array<string>"))


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is 0."""
    norms = norm(a) * norm(b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def role_rank(role: Column) -> Column:
    """1 viewer to 4 owner; 0 for anything else."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ROLES)), role), F.lit(0)), F.lit(0)).cast("int")


def rank_role(rank: Column) -> Column:
    return F.when(rank >= 1, F.element_at(F.array(*map(F.lit, ROLES)), F.greatest(rank, F.lit(1))))


def mask_secret(secret: Column) -> Column:
    """All but the last four characters as stars; four stars for shorter ones."""
    n = F.length(secret)
    return F.when(n <= 4, "****").otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(secret, F.lit(4))))
