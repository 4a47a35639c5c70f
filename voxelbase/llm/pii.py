"""Operator 1, surrogates for personal data.

Detected entities (e-mail, IPv4 and whole IPv6 addresses, phone, card and social
security numbers, secrets, titled names) get keyed surrogates of the same type and
format: digits stay digits, letters keep case, separators stay, card numbers
keep their Luhn validity, phone numbers their country code, addresses their top
domain and private range, names their gender (first name, family ending) and script.

Surrogates belong to an entity's canonical form (lower case, bare digits), so
all its spellings stay one entity across the corpus, and each spelling keeps its
own format; a family name has one surrogate with and without a first name of the list. A
surrogate is a keyed permutation (a Feistel network over the signs or numbers of
its format), so distinct entities get distinct surrogates by construction. The
collision check runs over the table of distinct entities: a candidate that equals
an original entity of its type, or another surrogate, is drawn again with another
key, ``ROUNDS`` times at most. Numbers and addresses whose space is so full that
every draw hits an original keep the first permutation's image, which is another
entity's original and never their own; names and e-mails get a counter then.

Texts that hold none of the signs an entity needs pass straight through; only
mentions shuffle, and each text is put together again from the pieces between
its mentions. Null texts stay null, empty ones empty, texts of any length are
treated whole. Rows are told apart by id and text, so repeated rows and null ids
are fine. Further columns pass through; one named n_replaced is replaced. Ties: a
surface that is a man's and a woman's name in one text keeps the smaller
surrogate. An empty table gives no rows. DataFrame functions only. Names without
a title, street addresses and account numbers are not detected. Use a secret
``key`` in production.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carried, materialize

KEY = "voxelbase-surrogates"
#: Draws that avoid originals; afterwards full spaces keep the first draw, and names and e-mails get the round as a counter.
ROUNDS = 8

# Patterns of the entity types, tried in this order.
_NAME = r"\p{Lu}[\p{L}'’-]+(?:\h\p{Lu}[\p{L}'’-]+)?"
MEN = r"(?:Mr|Sir|Herrn?|Monsieur|Señor|Sr|Don|Господин|г-н)"
WOMEN = r"(?:Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Señora|Sra|Doña|Госпожа|г-жа)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
TYPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ipv6": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "card": r"(?<![\d])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})[ .-]\d{3}[ .-]\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "man": rf"(?<=(?<!\p{{L}}){MEN}\.?\h){_NAME}",
    "woman": rf"(?<=(?<!\p{{L}}){WOMEN}\.?\h){_NAME}",
}
ANY = "|".join(f"(?:{p})" for p in TYPES.values()).replace(r"([ -]?)", r"(?<sep>[ -]?)").replace(r"\1", r"\k<sep>")
SIGNS = rf"[@0-9]|{MEN}\.?\h|{WOMEN}\.?\h"
DIGITS = ("card", "phone", "ssn")

#: Types of a fixed format, which have no room for a counter.
FIXED = ("ip", "ipv6", "secret", "card", "phone", "ssn")

# First names by gender and script.
NAMES = {
    ("man", "latin"): "James John Robert Michael David Thomas Daniel Paul Mark Peter Lukas Felix Jonas Hugo Louis Pierre Carlos Pablo Diego Javier".split(),
    ("woman", "latin"): "Mary Anna Linda Susan Sarah Karen Laura Emma Julia Helen Clara Lena Marie Chloe Alice Sophie Lucia Carmen Elena Paula".split(),
    ("man", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Павел Олег".split(),
    ("woman", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Вера".split(),
}
# Signs that stand for one another: hexadecimal digits; digits and letters; a name's vowels and consonants of either script.
HEX = ("0123456789abcdef",)
PLAIN = ("0123456789", "abcdefghijklmnopqrstuvwxyz")
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäéèêëíìîïóòôöúùûü", "çñß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ")
#: Endings of Cyrillic family names that tell the gender; they stay.
ENDING = r"(?:(?:ов|ев|ёв|ин|ын)а?|ск(?:ий|ая))$"


def _turned(value: Column, digest: Column, kind: Column) -> Column:
    """Each sign of ``value`` moved within its alphabet by a draw from ``digest``; other signs stay."""

    def one(c: Column, i: Column) -> Column:
        draw, out = F.xxhash64(digest, i), F.when(c == "", c)
        for mine, alphabets in ((kind.isin("secret", "ipv6"), HEX), (kind.isin("man", "woman"), LETTERS), (~kind.isin("secret", "ipv6", "man", "woman"), PLAIN)):
            for a in alphabets:
                at = F.position(c, F.lit(a))
                out = out.when(mine & (at > 0), F.substring(F.lit(a), (F.pmod(at - 1 + F.pmod(draw, F.lit(len(a))), F.lit(len(a))) + 1).cast("int"), F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _digest(key: str, attempt: int, step: str, *of: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(attempt)), F.lit(step), F.when(F.col("kind").isin("man", "woman"), "name").otherwise(F.col("kind")), *of).cast("binary"), 256)


def _permute_text(rows: DataFrame, name: str, salt: Column, key: str, attempt: int) -> DataFrame:
    """Column ``name`` permuted among the texts of its format: halves turn one another, four times."""
    n = F.ceil(F.length(name) / 2).cast("int")
    rows = rows.withColumns({"__l": F.substring(F.col(name), F.lit(1), n), "__r": F.substring(F.col(name), n + 1, F.length(name)), "__salt": salt})
    for i in range(4):
        side, other = ("__l", "__r") if i % 2 == 0 else ("__r", "__l")
        rows = rows.withColumn(side, _turned(F.col(side), _digest(key, attempt, f"{name}{i}", F.col("__salt"), F.length(name).cast("string"), F.col(other)), F.col("kind")))
    return rows.withColumn(name, F.concat("__l", "__r")).drop("__l", "__r", "__salt")


def _permute_address(rows: DataFrame, key: str, attempt: int) -> DataFrame:
    """Column ``address``: a dotted address permuted within its range (three private ones, and all others)."""
    octet = F.split("canon", r"\.")
    number = sum((octet[i].cast("long") * 256 ** (3 - i) for i in range(1, 4)), octet[0].cast("long") * 256**3)
    ranges = [(10 << 24, 1 << 24), (172 << 24 | 16 << 16, 1 << 20), (192 << 24 | 168 << 16, 1 << 16)]  # fixed values: first address and size
    rest = (1 << 32) - sum(size for _, size in ranges)
    rows = rows.withColumn("__n", F.when(F.col("kind") == "ip", number))
    low, width = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.lit(0))
    rank, split = F.col("__n"), None
    for first, size in ranges:
        inside = F.col("__n").between(first, first + size - 1)
        low, width = low.when(inside, F.lit(first)), width.when(inside, F.lit(1 << (size.bit_length() // 2)))
        rank = rank - F.when(F.col("__n") >= first + size, F.lit(size)).otherwise(0)
    rows = rows.withColumns({"__low": low.cast("long"), "__b": width.otherwise(F.lit(1 << 16)).cast("long")})
    rows = rows.withColumn("__a", F.when(F.col("__low").isNull(), F.lit(rest >> 16)).otherwise(F.when(F.col("__b") == 256, 256).when(F.col("__b") == 1024, 1024).otherwise(4096)).cast("long"))
    rows = rows.withColumn("__x", F.when(F.col("__low").isNull(), rank).otherwise(F.col("__n") - F.col("__low")))
    rows = rows.withColumns({"__l": F.floor(F.col("__x") / F.col("__b")), "__r": F.col("__x") % F.col("__b")})
    for i in range(4):
        side, other, size = ("__l", "__r", "__a") if i % 2 == 0 else ("__r", "__l", "__b")
        draw = F.xxhash64(_digest(key, attempt, f"ip{i}", F.coalesce(F.col("__low").cast("string"), F.lit("-")), F.col(other).cast("string")))
        rows = rows.withColumn(side, F.pmod(F.col(side) + F.pmod(draw, F.col(size)), F.col(size)))
    rows = rows.withColumn("__x", F.col("__l") * F.col("__b") + F.col("__r"))
    out = F.col("__x")
    for first, size in ranges:  # ranks back to addresses outside the private ranges
        out = out + F.when(out >= first, F.lit(size)).otherwise(0)
    rows = rows.withColumn("__x", F.when(F.col("__low").isNull(), out).otherwise(F.col("__x") + F.col("__low")))
    octets = [(F.shiftright("__x", 8 * (3 - i)).bitwiseAND(F.lit(255))).cast("string") for i in range(4)]
    return rows.withColumn("address", F.concat_ws(".", *octets)).drop("__n", "__low", "__a", "__b", "__x", "__l", "__r")


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def candidates(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    """(kind, canon) with ``stand_in``: the canonical entity's image under the attempt's permutation."""
    kind, canon = F.col("kind"), F.col("canon")
    name, two = kind.isin("man", "woman"), F.col("canon").contains(" ")
    domain = F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    code = F.when(kind == "phone", F.greatest(F.length(canon) - 10, F.lit(0))).otherwise(0)  # digits before a ten-digit number: the country's
    family = F.substring_index(canon, " ", -1)
    ending = F.when(name & canon.rlike(r"\p{IsCyrillic}"), F.regexp_extract(family, ENDING, 0)).otherwise("")
    body = F.when(kind == "email", F.substring_index(canon, "@", 1)).when(kind == "card", F.substring(canon, 1, 15)).when(kind == "phone", F.substring(canon, code + 1, F.length(canon)))
    body = body.when(name, F.substring(family, F.lit(1), F.length(family) - F.length("ending"))).when(kind == "ip", "").otherwise(canon)
    rows = entities.select("kind", "canon").withColumn("ending", ending)
    rows = rows.withColumns({"body": body, "host": F.when(kind == "email", F.substring(domain, F.lit(1), F.length(domain) - F.length(top))).otherwise(""), "first": F.when(name & two, F.substring_index(canon, " ", 1)).otherwise("")})
    # Listed first names change places in their list, by a step that is never 0; of the others each has one of the list.
    old, listed, known = F.col("first"), F.lit(""), F.col("first") == ""
    cyrillic = canon.rlike(r"\p{IsCyrillic}")
    for (gender, script), names in NAMES.items():
        low = [n.lower() for n in names]
        step = F.pmod(F.xxhash64(_digest(key, attempt, script)), F.lit(len(low) - 1)) + 1
        at = F.array_position(F.array(*map(F.lit, low)), old)
        place = F.when(at > 0, at - 1 + step).otherwise(F.xxhash64(_digest(key, attempt, "first", old)))
        mine = (kind == gender) & (cyrillic if script == "cyrillic" else ~cyrillic)
        listed = F.when(mine, F.element_at(F.array(*map(F.lit, low)), (F.pmod(place, F.lit(len(low))) + 1).cast("int"))).otherwise(listed)
        known = known | (mine & (at > 0))
    # A family name turns alike with a listed first name and with none; another first name turns it its own way.
    own = F.when(known, "").otherwise(old)
    salt = F.when(kind == "email", domain).when(kind == "phone", F.substring(canon, F.lit(1), code)).when(name, F.concat_ws("\x1f", "ending", own)).otherwise("")
    rows = rows.withColumns({"listed": listed, "salt": salt})
    rows = _permute_text(_permute_text(rows, "body", F.col("salt"), key, attempt), "host", F.lit(""), key, attempt)
    rows = _permute_address(rows, key, attempt)
    late = F.lit(str(attempt) if attempt >= ROUNDS else "")
    # The check digit that keeps the Luhn sum of the original.
    check = F.pmod(luhn(canon) - luhn(F.concat("body", F.lit("0"))), F.lit(10)).cast("string")
    full = F.concat(F.col("body"), F.col("ending"), late)
    out = F.when(kind == "email", F.concat("body", late, F.lit("@"), "host", top)).when(kind == "ip", F.col("address")).when(kind == "card", F.concat("body", check))
    out = out.when(kind == "phone", F.concat(F.substring(canon, F.lit(1), code), "body")).when(name & two, F.concat_ws(" ", "listed", full)).when(name, full).otherwise(F.col("body"))
    return rows.select("kind", "canon", out.alias("stand_in"))


def _kind(mention: Column) -> Column:
    out = F.when(mention.contains("@"), "email").when(mention.contains(":"), "ipv6").when(mention.rlike(r"^\d+(\.\d+){3}$"), "ip").when(mention.rlike(r"^(?=.*[a-f])[0-9a-f]{32,64}$"), "secret")
    return out.when(mention.rlike(r"^\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}$"), "card").when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(mention.rlike(r"\d"), "phone")


def render(surface: Column, kind: Column, stand_in: Column) -> Column:
    """A surrogate in the format of a mention."""
    digit = lambda c, i: F.when(c.between("0", "9"), F.substring(stand_in, F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)
    digits = F.array_join(F.transform(F.split(surface, ""), digit), "")
    upper = (F.length(surface) > 1) & (surface == F.upper(surface)) & (surface != F.lower(surface))
    cased = F.when(upper, F.upper(stand_in)).when(kind.isin("man", "woman"), F.initcap(stand_in)).otherwise(stand_in)
    case = lambda c, i: F.when(F.substring(surface, i + 1, F.lit(1)).between("A", "Z"), F.upper(c)).otherwise(c)
    email = F.array_join(F.transform(F.split(stand_in, ""), case), "")
    return F.when(kind.isin(*DIGITS), digits).when(kind == "email", email).otherwise(cased)


def draw_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon) distinct to (kind, canon, stand_in), one to one, and no original where the space has room."""
    originals = entities.select("kind", F.col("canon").alias("stand_in"))
    done, left, first = None, entities.select("kind", "canon"), None
    for attempt in range(2 * ROUNDS):
        drawn = materialize(candidates(left, key, attempt), "drawn")
        first = drawn if first is None else first
        good = drawn.groupBy("kind", "stand_in").agg(F.min("canon").alias("canon")).join(originals, ["kind", "stand_in"], "left_anti")
        if done is not None:
            good = good.join(done.select("kind", "stand_in"), ["kind", "stand_in"], "left_anti")
        good = materialize(good.select("kind", "canon", "stand_in"), "stand-in")
        left = materialize(drawn.join(good, ["kind", "canon"], "left_anti").select("kind", "canon"), "left")
        done = good if done is None else done.unionByName(good)
        if attempt == ROUNDS - 1:  # full spaces: the first permutation, whose images of these are originals and so not taken
            full = first.join(left.where(F.col("kind").isin(*FIXED)), ["kind", "canon"], "left_semi")
            done = done.unionByName(materialize(_unfixed(full), "full"))
            left = materialize(left.where(~F.col("kind").isin(*FIXED)), "left")
        if left.isEmpty():
            return done
    raise RuntimeError("surrogates of names or e-mails still meet originals")


def _unfixed(rows: DataFrame) -> DataFrame:
    """Images of a permutation, where entities that are their own image trade with one another and one other of their type.

    A random permutation has about one such entity, so the window sorts a handful of rows.
    """
    rows = materialize(rows, "images")
    same = rows.where("canon = stand_in")
    other = rows.where("canon <> stand_in").groupBy("kind").agg(F.min("canon").alias("canon"))
    ring = same.select("kind", "canon").unionByName(other.join(same.select("kind").distinct(), "kind", "left_semi").select("kind", "canon"))
    ring = rows.join(ring, ["kind", "canon"], "left_semi")
    by = Window.partitionBy("kind").orderBy("canon")
    turned = ring.select("kind", "canon", F.coalesce(F.lead("stand_in").over(by), F.first("stand_in").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("stand_in"))
    return rows.join(ring.select("kind", "canon"), ["kind", "canon"], "left_anti").unionByName(turned)


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the column n_replaced (one of that name is replaced)."""
    return carried(docs.drop("n_replaced"), ("text",), lambda rows: _replaced(rows, key))


def _replaced(docs: DataFrame, key: str) -> DataFrame:
    names = docs.columns
    signs = F.coalesce(F.col("text").rlike(SIGNS), F.lit(False))
    found = F.regexp_extract_all(F.col("text"), F.lit(ANY), F.lit(0))
    row_key = F.unhex(F.substring(F.sha2(F.to_json(F.struct(*names)).cast("binary"), 256), 1, 32))
    hits = materialize(docs.where(signs).withColumns({"__found": found, "__key": row_key}), "hits")
    plain = docs.where(~signs).withColumn("n_replaced", F.lit(0))

    some = hits.where(F.size("__found") > 0)
    pieces = F.split("text", ANY, -1)
    mention = some.select("__key", F.posexplode("__found").alias("i", "surface"), pieces.alias("__p")).withColumn("before", F.element_at("__p", F.col("i") + 1)).drop("__p")
    gender = F.when(F.col("before").rlike(rf"(?<!\p{{L}}){MEN}\.?\h$"), "man").otherwise("woman")
    mention = mention.withColumn("kind", F.coalesce(_kind(F.col("surface")), gender))
    canon = F.when(F.col("kind").isin(*DIGITS), F.regexp_replace("surface", "[^0-9]", "")).when(F.col("kind") == "ip", F.regexp_replace("surface", r"(?<![0-9])0+(?=[0-9])", "")).otherwise(F.lower("surface"))
    mention = materialize(mention.select("__key", "surface", "kind", canon.alias("canon")).distinct(), "mentions")
    table = materialize(draw_surrogates(mention.select("kind", "canon").distinct(), key), "surrogates")
    said = mention.join(table, ["kind", "canon"]).select("__key", "surface", "kind", render(F.col("surface"), F.col("kind"), F.col("stand_in")).alias("new"))
    # A surface that is a man's and a woman's name in one text keeps one of the two.
    maps = said.groupBy("__key", "surface").agg(F.min("new").alias("new")).groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("surface", "new"))).alias("__map"))
    joined = hits.join(maps, "__key", "left")
    new = F.transform(F.col("__found"), lambda e: F.coalesce(F.element_at(F.col("__map"), e), e))
    text = F.array_join(F.flatten(F.zip_with(F.split("text", ANY, -1), new, lambda p, e: F.array(p, F.coalesce(e, F.lit(""))))), "")
    text = F.when(F.size("__found") > 0, text).otherwise(F.col("text"))
    rest = joined.withColumn("__text", text).withColumn("n_replaced", F.size("__found"))
    rest = rest.select(*(F.col("__text").alias(c) if c == "text" else F.col(f"`{c}`") for c in names), "n_replaced")
    return plain.unionByName(rest)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return replace_entities(docs).select("doc_id", "text", "n_replaced")
