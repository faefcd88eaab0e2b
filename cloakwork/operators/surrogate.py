"""Surrogates: opaque tokens and seeded realistic values, unique in their call, as expressions of type, text and salt."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.arrays import let, record
from cloakwork.model import ALWAYS_OPAQUE
from cloakwork.operators.resolve import lookup_or_compute

ATTEMPTS = 4
MOST_SALT_BYTES = 64

# Our own vocabularies, by locale.
NAMES = {
    "en_US": (["Avery", "Blake", "Casey", "Dana", "Elliot", "Frankie", "Harper", "Jordan", "Kendall", "Morgan", "Quinn", "Rowan", "Sawyer", "Taylor"], ["Ashford", "Bennett", "Carver", "Dalton", "Everly", "Fairbank", "Granger", "Holloway", "Irving", "Kingsley", "Lockwood", "Merrick", "Norwood", "Prescott"]),
    "de_DE": (["Alex", "Bente", "Eike", "Finn", "Helge", "Jona", "Kai", "Luca", "Mika", "Robin", "Sascha", "Toni"], ["Ahlers", "Brandt", "Claasen", "Dietrich", "Ebert", "Fuchs", "Gruber", "Hartwig", "Jansen", "Keller", "Lorenz", "Petersen"]),
    "fr_FR": (["Alix", "Camille", "Charlie", "Claude", "Dominique", "Eden", "Lou", "Maxime", "Noa", "Sacha"], ["Aubert", "Blanchet", "Carpentier", "Delorme", "Fontaine", "Garnier", "Lambert", "Marchand", "Perrin", "Rousseau"]),
    "es_ES": (["Alexis", "Andrea", "Cruz", "Guadalupe", "Jael", "Noa", "Reyes", "Rosario", "Trinidad", "Valentin"], ["Aguilar", "Benitez", "Cordero", "Dominguez", "Fuentes", "Herrera", "Lozano", "Medina", "Navarro", "Salgado"]),
    "pt_BR": (["Ariel", "Cris", "Darci", "Eli", "Iris", "Jaci", "Juraci", "Nadir", "Sidnei", "Val"], ["Almeida", "Barbosa", "Cardoso", "Duarte", "Esteves", "Figueira", "Guedes", "Macedo", "Pacheco", "Teixeira"]),
}
COMPANIES = ["Alder", "Beacon", "Cobalt", "Driftwood", "Ember", "Foxglove", "Granite", "Harbor", "Indigo", "Juniper", "Larkspur", "Meridian"]
ENDINGS = ["Group", "Holdings", "Industries", "Labs", "Partners", "Systems", "Works"]
DOMAINS = ["example.com", "example.net", "example.org"]
STREETS = ["Birch Lane", "Cedar Street", "Elm Avenue", "Hill Road", "Lake Drive", "Mill Street", "Park Avenue", "River Road"]
CITIES = ["Brookfield", "Clearwater", "Fairview", "Greenville", "Lakeside", "Milton", "Oakdale", "Riverton"]
#: How a date is written in a locale; others get ISO.
DATES = {"en_US": "MMM d, yyyy", "de_DE": "dd.MM.yyyy", "fr_FR": "dd/MM/yyyy", "es_ES": "dd/MM/yyyy", "pt_BR": "dd/MM/yyyy"}


def salt_bytes(salt: str | None) -> str:
    """No salt gives a random one for this job; else at most 64 bytes of it."""
    return os.urandom(16).hex() if not salt else salt.encode()[:MOST_SALT_BYTES].decode(errors="ignore")


def choose_locale(chain: list[str] | None, warnings: list[str] | None = None) -> str:
    """The first locale of the chain that there is, else en_US."""
    for x in chain or []:
        if x in NAMES:
            return x
        (warnings if warnings is not None else []).append(f"unknown locale {x!r}")
    return "en_US"


def locale_of(chain: Column) -> Column:
    """X8 row by row: the first locale of an array that there is, else en_US."""
    return F.coalesce(F.get(F.filter(chain, lambda x: x.isin(list(NAMES))), 0), F.lit("en_US"))


def cache_key(entity_type: Column, text: Column, use_realistic: Column, locale: Column) -> Column:
    """What a surrogate depends on. Opaque ones don't depend on the locale, so all locales share their key."""
    opaque_one = ~use_realistic | entity_type.isin(ALWAYS_OPAQUE)
    return F.struct(entity_type.alias("entity_type"), text.alias("text"), (~opaque_one).alias("realistic"), F.when(opaque_one, F.lit("")).otherwise(locale).alias("locale"))


def surrogates(wanted: DataFrame, salt: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Adds ``surrogate`` to rows (entity_type, text, use_realistic, locale), and gives the rows to append to the cache.

    Each key is computed once, and not at all if the cache (key, surrogate) has it.
    """
    keyed = wanted.withColumn("key", cache_key(F.col("entity_type"), F.col("text"), F.col("use_realistic"), F.col("locale")))
    kind, body = F.col("key.entity_type"), F.col("key.text")

    def compute(keys: DataFrame) -> DataFrame:
        made = opaque(kind, body, salt)
        for name in NAMES:
            made = F.when(F.col("key.realistic") & (F.col("key.locale") == name), realistic(kind, body, salt, name)).otherwise(made)
        return keys.select("key", made.alias("surrogate"))

    known = cache if cache is not None else compute(keyed.select("key").limit(0))
    found, fresh = lookup_or_compute(keyed, known, ["key"], compute)
    return found.drop("key"), fresh


def salted(salt: str, *parts: Column) -> Column:
    """SHA-256 of the salt and the parts. The salt's length stands in front, so no other salt and text give the same input."""
    return F.sha2(F.concat(F.lit(f"{len(salt.encode())}:{salt}"), *parts), 256)


def opaque(entity_type: Column, text: Column, salt: str) -> Column:
    """[TYPE_XXXXXXXX]; the type isn't hashed."""
    return F.concat(F.lit("["), entity_type, F.lit("_"), F.upper(F.substring(salted(salt, text), 1, 8)), F.lit("]"))


def digest(entity_type: Column, text: Column, salt: str) -> Column:
    """Hexadecimal digits that seed a value of this type and text."""
    return salted(salt, entity_type, F.lit(":"), text)


def seed(entity_type: Column, text: Column, salt: str) -> Column:
    return F.conv(F.substring(digest(entity_type, text, salt), 1, 15), 16, 10).cast("bigint")


def realistic(entity_type: Column, text: Column, salt: str, locale: str = "en_US") -> Column:
    """A value of the type's shape from our own vocabularies, or an opaque token for types that never get one.

    Eight-digit pieces of the digest each pick one part.
    """
    d = digest(entity_type, text, salt)
    n = lambda k: F.conv(F.substring(d, 1 + 7 * k, 7), 16, 10).cast("bigint")
    pick = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), (n(k) % len(values)).cast("int"))
    num = lambda k, low, high: (n(k) % (high - low + 1) + low).cast("string")
    padded = lambda k, width: F.lpad((n(k) % 10**width).cast("string"), width, "0")
    first, last = NAMES[locale]
    v4 = F.concat_ws(".", num(0, 11, 99), num(1, 0, 255), num(2, 0, 255), num(3, 1, 254))
    v6 = F.concat(F.lit("2001:db8:"), F.concat_ws(":", *[F.substring(d, 1 + 4 * k, 4) for k in range(6)]))
    host = F.concat(F.lower(pick(COMPANIES, 0)), F.lit("-"), num(1, 1, 999))
    user = F.concat(F.lower(pick(first, 0)), F.lit("."), F.lower(pick(last, 1)), num(2, 1, 9999))
    card15 = F.concat(F.lit("4"), padded(0, 7), padded(1, 7))
    check = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, F.when(card15.substr(i, F.lit(1)).cast("int") > 4, card15.substr(i, F.lit(1)).cast("int") * 2 - 9).otherwise(card15.substr(i, F.lit(1)).cast("int") * 2)).otherwise(card15.substr(i, F.lit(1)).cast("int")))
    uuid = F.concat_ws("-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.concat(F.lit("4"), F.substring(d, 14, 3)), F.concat(F.lit("a"), F.substring(d, 18, 3)), F.substring(d, 21, 12))
    born = F.date_add(F.lit("1940-01-01").cast("date"), (n(0) % 25000).cast("int"))
    bban = F.concat(F.lit("500105"), padded(0, 6), padded(1, 6))
    # ISO 7064: 98 minus the remainder of the number with the country (DE) and 00 behind
    rest = F.aggregate(F.split(F.concat(bban, F.lit("131400")), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * 10 + F.ascii(c) - 48) % 97))
    values = {
        "PERSON": F.concat_ws(" ", pick(first, 0), pick(last, 1)),
        "ORGANIZATION": F.concat_ws(" ", pick(COMPANIES, 0), pick(last, 1), pick(ENDINGS, 2)),
        "EMAIL_ADDRESS": F.concat(user, F.lit("@"), pick(DOMAINS, 3)),
        "IPV4_ADDRESS": v4,
        "IPV6_ADDRESS": v6,
        "IPV4_CIDR": F.concat(F.concat_ws(".", num(0, 11, 99), num(1, 0, 255), num(2, 0, 255)), F.lit(".0/24")),
        "IPV6_CIDR": F.concat(F.lit("2001:db8:"), F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4), F.lit("::/64")),
        "HOSTNAME": host,
        "DOMAIN": F.concat(host, F.lit("."), pick(DOMAINS, 2)),
        "USERNAME": user,
        "PHONE": F.concat(F.lit("+1-555-"), padded(0, 3), F.lit("-"), padded(1, 4)),
        "UUID": uuid,
        "MAC_ADDRESS": F.concat(F.lit("02:"), F.concat_ws(":", *[F.substring(d, 1 + 2 * k, 2) for k in range(5)])),
        "URL": F.concat(F.lit("https://"), host, F.lit("."), pick(DOMAINS, 2), F.lit("/")),
        "ADDRESS": F.concat(num(0, 1, 9999), F.lit(" "), pick(STREETS, 1), F.lit(", "), pick(CITIES, 2)),
        "CREDIT_CARD": F.concat(card15, ((F.lit(10) - check % 10) % 10).cast("string")),
        "DATE_OF_BIRTH": F.date_format(born, DATES.get(locale, "yyyy-MM-dd")),
        "IBAN": F.concat(F.lit("DE"), F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), bban),
        "NATIONAL_ID": F.concat_ws("-", num(0, 900, 999), padded(1, 2), padded(2, 4)),
    }
    out = opaque(F.when(entity_type.isin(ALWAYS_OPAQUE) | entity_type.isin(list(values)), entity_type).otherwise("OTHER"), text, salt)
    for k, v in values.items():
        out = F.when(entity_type == k, v).otherwise(out)
    return out


def candidates(entity_type: Column, text: Column, salt: str, use_realistic: bool, locale: str) -> Column:
    """The values of attempts 0 to 3; later ones are those of text#1, text#2, text#3."""
    return F.array(*[_made(entity_type, text if a == 0 else F.concat(text, F.lit(f"#{a}")), salt, use_realistic, locale) for a in range(ATTEMPTS)])


def _made(entity_type: Column, text: Column, salt: str, use_realistic: bool, locale: str) -> Column:
    return realistic(entity_type, text, salt, locale) if use_realistic else opaque(entity_type, text, salt)


def assign(entities: Column, salt: str, use_realistic: bool = False, locale: str = "en_US") -> Column:
    """X6 in a call: entities (text, entity_type, source_detectors) with a surrogate each, unique and never an original.

    The order of the array decides who gets a contested value; the last resort is sixteen digits of the seed. Where no value is
    contested, which is nearly always so, all get their first one, and nothing is compared one by one.
    """
    kind = "array<struct<surrogate:string,original:string,entity_type:string,source_detectors:array<string>>>"
    tried = F.transform(entities, lambda e: F.struct(e["text"].alias("original"), e["entity_type"].alias("entity_type"), e["source_detectors"].alias("source_detectors"), candidates(e["entity_type"], e["text"], salt, use_realistic, locale).alias("c"), F.concat(F.lit("["), e["entity_type"], F.lit("_"), F.upper(F.substring(digest(e["entity_type"], e["text"], salt), 1, 16)), F.lit("]")).alias("last")))

    def step(acc: Column, e: Column) -> Column:
        free = F.filter(e["c"], lambda c: (c != e["original"]) & ~F.exists(acc, lambda a: a["surrogate"] == c))
        one = F.struct(F.coalesce(F.get(free, 0), e["last"]).alias("surrogate"), e["original"].alias("original"), e["entity_type"].alias("entity_type"), e["source_detectors"].alias("source_detectors"))
        return F.concat(acc, F.array(one).cast(kind))

    first = F.transform(entities, lambda e: record(surrogate=_made(e["entity_type"], e["text"], salt, use_realistic, locale), original=e["text"], entity_type=e["entity_type"], source_detectors=e["source_detectors"])).cast(kind)
    apart = lambda f: (F.size(F.array_distinct(F.transform(f, lambda x: x["surrogate"]))) == F.size(f)) & F.forall(f, lambda x: x["surrogate"] != x["original"])
    return F.coalesce(let(first, lambda f: F.when(apart(f), f)), F.aggregate(tried, F.array().cast(kind), step))


def opaque_blake2b(df: DataFrame, salt: str, text: str = "text", entity_type: str = "entity_type", into: str = "surrogate") -> DataFrame:
    """X1 with keyed BLAKE2b, for tokens that must equal those of systems that use it. Needs Python; batches of columns."""
    at, kind = df.columns.index(text), df.columns.index(entity_type)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{into}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        key = salt.encode()[:MOST_SALT_BYTES]
        for b in batches:
            made = [None if t is None else f"[{k}_{hashlib.blake2b(t.encode(), key=key, digest_size=4).hexdigest().upper()}]" for t, k in zip(b.column(at).to_pylist(), b.column(kind).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, into])

    return df.mapInArrow(run, schema)
