"""Scalar expressions: normalisation of matches, structural validators, predicates. All stay in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.model import ENTITY_TYPES, KEEP_TAIL

#: What str.strip removes, as far as it is ASCII.
BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def normalize_type(t: Column) -> Column:
    """Unknown types are OTHER."""
    return F.when(t.isin(ENTITY_TYPES), t).otherwise(F.lit("OTHER"))


def trim_match(text: Column, t: Column) -> Column:
    """Drops trailing sentence punctuation unless the type may end in it."""
    return F.when(t.isin(KEEP_TAIL), text).otherwise(F.rtrim(text, F.lit(".,;!?")))


def luhn(s: Column) -> Column:
    """Of the digits in s, at least two."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    return (F.length(digits) >= 2) & F.call_function("luhn_check", digits)


def iban_mod97(s: Column) -> Column:
    """P5: blanks removed, upper case, first four moved behind, letters as 10 to 35; remainder 1 by 97."""
    clean = F.upper(F.regexp_replace(s, "[ ]", ""))
    turned = F.concat(F.substring(clean, 5, 1 << 20), F.substring(clean, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        digit, letter = ch.between("0", "9"), ch.between("A", "Z")
        return F.when(digit, (acc * 10 + F.ascii(ch) - 48) % 97).when(letter, (acc * 100 + F.ascii(ch) - 55) % 97).otherwise(acc)

    value = F.aggregate(F.split(turned, ""), F.lit(0), step)
    return (F.length(clean) >= 5) & clean.rlike("^[A-Z0-9]+$") & (value == 1)


def _octet_ok(part: Column) -> Column:
    return F.coalesce(part.rlike(r"^[0-9]{1,9}$") & (part.try_cast("int") <= 255), F.lit(False))


def ipv4(s: Column) -> Column:
    """Four parts of 0 to 255; leading zeros are fine."""
    parts = F.split(s, "[.]", -1)
    return (F.size(parts) == 4) & F.forall(parts, _octet_ok)


def ipv4_cidr(s: Column) -> Column:
    """An address and a prefix of 0 to 32; host bits are fine."""
    bits = F.substring_index(s, "/", -1)
    return F.contains(s, F.lit("/")) & ipv4(F.substring_index(s, "/", 1)) & bits.rlike("^[0-9]{1,3}$") & F.coalesce(bits.try_cast("int") <= 32, F.lit(False))


_H = "[0-9A-Fa-f]{1,4}"


def ipv6(s: Column) -> Column:
    """An address, its %zone ignored: eight groups, or fewer around one '::'; the last two groups may be an IPv4 address."""
    bare = F.substring_index(s, "%", 1)
    v4 = F.regexp_extract(bare, r":([0-9.]+)$", 1)
    has_v4 = F.contains(v4, F.lit("."))
    # an IPv4 tail counts as two groups
    plain = F.when(has_v4, F.concat(F.regexp_replace(bare, r"[0-9.]+$", ""), F.lit("0:0"))).otherwise(bare)
    groups = F.size(F.filter(F.split(plain, ":", -1), lambda g: g != ""))
    full = plain.rlike(f"^{_H}(:{_H}){{7}}$")
    short = plain.rlike(f"^({_H}(:{_H})*)?::({_H}(:{_H})*)?$") & (groups <= 7)
    return (full | short) & (~has_v4 | (ipv4(v4) & ~v4.rlike(r"(^|[.])0[0-9]")))


def ipv6_cidr(s: Column) -> Column:
    """An address and a prefix of 0 to 128."""
    bits = F.substring_index(s, "/", -1)
    return F.contains(s, F.lit("/")) & ipv6(F.substring_index(s, "/", 1)) & bits.rlike("^[0-9]{1,3}$") & F.coalesce(bits.try_cast("int") <= 128, F.lit(False))


def valid(value: Column, t: Column) -> Column:
    """P10: types without a validator are always valid."""
    return (
        F.when(t == "CREDIT_CARD", luhn(value))
        .when(t == "IBAN", iban_mod97(value))
        .when(t == "IPV4_ADDRESS", ipv4(value))
        .when(t == "IPV4_CIDR", ipv4_cidr(value))
        .when(t == "IPV6_ADDRESS", ipv6(value))
        .when(t == "IPV6_CIDR", ipv6_cidr(value))
        .otherwise(F.lit(True))
    )


def partial_token(text: Column) -> Column:
    """The text ends inside an opaque token."""
    return text.rlike(r"(?d)\[[A-Z0-9_]*$")


def grounded(entity: Column, source: Column) -> Column:
    """Not empty, and found in the source."""
    return (entity != "") & F.contains(source, entity)


def escape_regex(s: Column) -> Column:
    return F.regexp_replace(s, r"([\\.\[\]{}()*+?^$|#\-&~\s])", r"\\$1")


def bearer(headers: Column) -> Column:
    """The token of an Authorization header, whatever the case of its name; '[present]' is none."""
    value = F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == "authorization")), 0)
    token = strip(F.regexp_extract(value, r"(?is)^\s*bearer\s+(.*)$", 1))
    return F.when((strip(value) == "[present]") | (token == "") | (token == "[present]"), F.lit(None)).otherwise(token)


def snippet(text: Column, most: int = 160) -> Column:
    """K6: at most ``most`` characters, then an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def json_object(reply: Column) -> Column:
    """Without thinking blocks; the object in a code fence, else from the first brace to the last, else all."""
    clean = strip(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""))
    fenced = F.regexp_extract(clean, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(clean, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", fenced).when(bare != "", bare).otherwise(clean)
