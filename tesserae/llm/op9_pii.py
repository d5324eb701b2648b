"""Operator 9: surrogates for personal data, in DataFrame functions only.

One regular expression finds e-mail addresses, IPv4 addresses, phone and national numbers, card
numbers, and names after a title: all their words, initials and particles up to the last name. Each entity has a canonical form (lower case; digits only for
numbers), and its surrogate is a function of a key, the kind and the canonical form, so one entity
has one surrogate wherever and however it is written, and the way it is written stays: separators,
brackets, country code, letter case, title.

* A phone number keeps its country code, read from its digits. Numbers go through a keyed Feistel permutation of the digit strings of their length, so distinct
  numbers get distinct surrogates. Cards that pass the Luhn test have surrogates that pass it.
* IPv4 addresses go through a permutation of the 32-bit numbers.
* E-mail addresses get `WIDTH` keyed letters (and the digits their local part ends in) at a reserved domain.
* Given names come from lists by gender and script, with keyed syllables added where the lists are too
  short; surnames are built from keyed syllables of the script. The gender is that of the title; a name
  under a title of neither has the gender that the same full name has elsewhere in the corpus, else a
  keyed one. The same full name under titles of both genders counts as two people.

Letters drawn from a hash may collide. `exceptions` counts the surrogates of all distinct addresses,
surnames and given names, and those that share one with a smaller entity, or (but for given names) meet an
entity of the corpus, draw again until none does; so distinct full names have distinct surrogates. The
few that had to are broadcast as a map. Beyond `EXCEPTIONS_MOST` the width is raised instead. Full names
whose gender is known from elsewhere only, and isn't the keyed one, are broadcast too, all of them.

A null text stays null, an empty one empty; other columns stay. Whole texts are read. Repeated rows
give repeated results; an empty table gives an empty result. Nothing but distinct entities is shuffled.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, materialize, release

KEY = "surrogate-key-1"
WIDTH = 9
EXCEPTIONS_MOST = 20_000
#: Maps are dealt into so many, as Spark searches a map from its start.
BUCKETS = 1024
#: The calling codes of countries, by their first digits.
CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Г-жа")
_MALE = ("Mr", "Herr", "Monsieur", "Señor", "Г-н")
_TITLE = "(?:" + "|".join((*_FEMALE, *_MALE, "Dr", "Prof")) + r")\.?"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
PHONE = r"(?<![\d+])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.+-])\d{3}[-. ]\d{2,3}[-. ]\d{4}(?![\d-])"
CARD = r"(?<!\d)\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?!\d)|(?<!\d)\d{13,19}(?!\d)"
_TITLES = rf"(?:{_TITLE} )+"
#: A name word runs to the end of its letters, with apostrophes and hyphens between them, but without a genitive's 's.
_LINK = r"['’-](?!s(?![\p{L}\p{M}]))"
_WORD = rf"(?!{_TITLE}(?![\p{{L}}\p{{M}}]))\p{{Lu}}(?=[\p{{L}}\p{{M}}]|{_LINK}\p{{L}})[\p{{L}}\p{{M}}]*+(?:{_LINK}\p{{L}}[\p{{L}}\p{{M}}]*+)*+"
_INITIAL = r"(?:(?:\p{Lu}\.-?)++|\p{Lu}(?= \p{Lu}))"
_PARTICLE = "(?:van|von|vom|der|den|de|del|della|di|da|do|dos|das|du|des|la|las|le|los|el|al|bin|ibn|bint|ben|ten|ter|te|zu|zum|zur|af|av|of|y|фон|де|ван|дер)"
_FAMILY = rf"(?:{_PARTICLE} )*+(?:(?:d|l|dell|dall|al|el)['’-])?{_WORD}"
#: Any number of names and initials, up to the last name.
NAME = rf"(?<![\p{{L}}\p{{M}}\p{{N}}_]){_TITLES}(?:{_INITIAL} )*+{_FAMILY}(?:(?: {_INITIAL})*+ {_FAMILY})*+"
ANY = "|".join((EMAIL, IP, CARD, PHONE, NAME))

_LAST = rf"(?<!\S)(?:{_PARTICLE} )*+\S+$"

#: Given names by gender and script, and syllables of surnames by script.
GIVEN = {
    ("f", "latin"): "Alma Berta Clara Dora Elena Flora Greta Helena Irma Julia Klara Laura Marta Nora Olga Paula".split(),
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jakob Konrad Leo Martin Nils Otto Paul".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса София".split(),
    ("f", "greek"): "Άννα Βέρα Γεωργία Δάφνη Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Κλειώ Λυδία Μαρία Νίκη Ξένια Όλγα Σοφία".split(),
    ("m", "greek"): "Ανδρέας Βασίλης Γιώργος Δήμος Ευάγγελος Ζήσης Ηλίας Θωμάς Ιωάννης Κώστας Λεωνίδας Μάρκος Νίκος Πέτρος Σταύρος Φώτης".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Семён".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ka ke ko la le lo ma me mo na ne no pa ra re ro sa se so ta to".split(),
    "greek": "βα βε βο γα γε γο δα δε δο ζα ζε θα θο κα κε κο λα λε λο μα με μο να νε νο πα ρα ρε ρο σα σο τα".split(),
    "cyrillic": "ба бе бо да де до фа фе га го ха ка ке ко ла ле ло ма ме мо на не но па ра ре ро са се со та то".split(),
}


def _array(words) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def _draw(most: int, *by) -> Column:
    """A keyed number from 0 to most - 1."""
    return F.pmod(F.xxhash64(F.lit(KEY), *by), F.lit(most))


def _permuted(digits: Column) -> Column:
    """A keyed permutation of the strings of up to 36 digits of one length, by an unbalanced Feistel network."""

    def of(d: Column) -> Column:
        n = F.length(d)
        cut = F.floor(n / 2).cast("int")
        low, high = F.pow(F.lit(10.0), n - cut).cast("long"), F.greatest(F.pow(F.lit(10.0), cut), F.lit(1.0)).cast("long")
        start = F.struct(F.coalesce(F.substring(d, F.lit(1), cut).try_cast("long"), F.lit(0).cast("long")).alias("a"), F.coalesce(F.substring(d, cut + 1, n).try_cast("long"), F.lit(0).cast("long")).alias("b"))

        def turn(s: Column, r: Column) -> Column:
            a = F.pmod(s["a"] + F.pmod(F.xxhash64(F.lit(KEY), n, r, s["b"]), high), high)
            return let(a, lambda x: F.struct(x.alias("a"), F.pmod(s["b"] + F.pmod(F.xxhash64(F.lit(KEY), n, -r, x), low), low).alias("b")))

        end = F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, turn)
        return let(end, lambda e: F.concat(F.when(cut > 0, F.lpad(e["a"].cast("string"), cut, "0")).otherwise(""), F.lpad(e["b"].cast("string"), n - cut, "0")))

    return let(digits, of)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(d, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10


def _written(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced, in order, by `digits`."""
    parts = F.split(shape, r"\d", -1)
    return F.array_join(F.zip_with(parts, F.concat(F.split(digits, ""), F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email").when(m.rlike(f"^{IP}$"), "ip").when(m.rlike(f"^(?:{CARD})$"), "card").when(m.rlike(f"^{_TITLE} "), "name").otherwise("phone")
    )


def canonical(m: Column) -> Column:
    """The kind and the form in which all mentions of an entity agree."""
    k = kind(m)
    bare = F.when(k.isin("card", "phone"), F.regexp_replace(m, r"\D", "")).when(k == "name", _bare(m)).otherwise(F.lower(m))
    return F.concat(k, F.lit(":"), bare)


def _letters(width: int, seed: Column, tries: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _draw(26, seed, tries, i).cast("int") + 1, F.lit(1))), "")


def _number(m: Column, luhn: bool) -> Column:
    digits = F.regexp_replace(m, r"\D", "")
    if not luhn:
        # a country code stays; it is read from the digits, so that separators make no difference
        code = F.when(m.startswith("+"), F.regexp_extract(digits, CALLING, 0)).otherwise("")
        return let(code, lambda c: _written(m, F.concat(c, _permuted(F.substring(digits, F.length(c) + 1, F.length(digits))))))
    # the last digit of a valid card follows from the others, which are permuted
    head = _permuted(F.substring(digits, F.lit(1), F.length(digits) - 1))
    check = let(head, lambda h: F.concat(h, F.pmod(10 - _luhn(F.concat(h, F.lit("0"))), F.lit(10)).cast("string")))
    return _written(m, F.when(_luhn(digits) == 0, check).otherwise(_broken(digits)))


def _broken(digits: Column) -> Column:
    """For digits that fail the Luhn test: the head permuted, the same distance from validity."""
    head = _permuted(F.substring(digits, F.lit(1), F.length(digits) - 1))
    return let(head, lambda h: F.concat(h, F.pmod(10 - _luhn(F.concat(h, F.lit("0"))) + _luhn(digits), F.lit(10)).cast("string")))


def _ip(m: Column) -> Column:
    """A keyed permutation of 32-bit numbers, as an address."""

    def of(p: Column) -> Column:
        a, b = F.get(p, 0) * 256 + F.get(p, 1), F.get(p, 2) * 256 + F.get(p, 3)

        def turn(s: Column, r: Column) -> Column:
            x = s["a"].bitwiseXOR(_draw(65536, F.lit("ip"), r, s["b"]).cast("int"))
            return let(x, lambda v: F.struct(v.alias("a"), s["b"].bitwiseXOR(_draw(65536, F.lit("ip"), -r, v).cast("int")).alias("b")))

        end = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.struct(a.alias("a"), b.alias("b")), turn)
        return let(end, lambda e: F.concat_ws(".", F.floor(e["a"] / 256).cast("string"), (e["a"] % 256).cast("string"), F.floor(e["b"] / 256).cast("string"), (e["b"] % 256).cast("string")))

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), of)


def _bare(m: Column) -> Column:
    """A name without its title, in lower case: the entity."""
    return F.lower(F.regexp_replace(m, f"^{_TITLES}", ""))


def _family(bare: Column) -> Column:
    """The last word with the particles before it."""
    return F.regexp_extract(bare, _LAST, 0)


def _given(bare: Column) -> Column:
    """What comes before the surname; empty where nothing does."""
    return F.rtrim(F.regexp_replace(bare, _LAST, ""))


def _titled(m: Column, titles: tuple[str, ...]) -> Column:
    return F.regexp_extract(m, f"^{_TITLES}", 0).rlike(r"(?:^| )(?:" + "|".join(titles) + r")\.? ")


def _drawn_female(bare: Column) -> Column:
    return _draw(2, F.lit("gender"), bare) == 0


def _table(word: Column, by: dict[str, list[str]]) -> Column:
    """The list of the word's script: Cyrillic, Greek, else Latin."""
    return F.when(word.rlike(r"\p{IsCyrillic}"), _array(by["cyrillic"])).when(word.rlike(r"\p{IsGreek}"), _array(by["greek"])).otherwise(_array(by["latin"]))


def _syllables(count: Column, *by) -> Column:
    table = _table(by[1], SYLLABLES)
    return F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.get(table, _draw(32, *by, i).cast("int"))), ""))


def _new_family(family: Column, width: int, tries: Column) -> Column:
    return _syllables(F.lit(width // 2 + 1), F.lit("surname"), family, tries)


def _new_given(given: Column, female: Column, width: int, tries: Column) -> Column:
    """A listed name; where it was taken before or the letters are widened, with syllables, more each time."""
    f, m = ({script: GIVEN[gender, script] for script in SYLLABLES} for gender in "fm")
    words = F.when(female, _table(given, f)).otherwise(_table(given, m))
    listed = F.get(words, _draw(16, F.lit("given"), given).cast("int"))
    more = F.lit((width - WIDTH) // 2) + F.when(tries > 0, tries + 1).otherwise(0)
    return F.when(more > 0, F.concat(listed, F.lit("-"), _syllables(F.greatest(more, F.lit(1)), F.lit("given more"), given, tries))).otherwise(listed)


def _given_entity(female: Column, given: Column) -> Column:
    return F.concat(F.when(female, "given:f:").otherwise("given:m:"), given)


def _name(m: Column, width: int, tries: dict[str, int], genders: dict[str, int]) -> Column:
    def of(bare: Column) -> Column:
        family, given = _family(bare), _given(bare)
        known = _looked_up(bare, genders)
        female = _titled(m, _FEMALE) | (~_titled(m, _MALE) & F.when(known > 0, known == 1).otherwise(_drawn_female(bare)))
        first = F.concat(_new_given(given, female, width, _looked_up(_given_entity(female, given), tries)), F.lit(" "))
        return F.concat(F.when(given != "", first).otherwise(""), _new_family(family, width, _looked_up(F.concat(F.lit("family:"), family), tries)))

    return F.concat(F.regexp_extract(m, f"^{_TITLES}", 0), let(_bare(m), of))


def _email(m: Column, width: int, tries: Column) -> Column:
    return F.concat(_letters(width, F.lower(m), tries), F.regexp_extract(m, r"[._]?\d*(?=@)", 0), F.lit("@example.org"))


def surrogate(m: Column, width: int = WIDTH, tries: dict[str, int] | None = None, genders: dict[str, int] | None = None) -> Column:
    """The replacement of a mention; `tries` counts how often an entity has drawn before, `genders` is 1 for female, 2 for male."""
    tries, genders = tries or {}, genders or {}
    k = kind(m)
    at = _email(m, width, _looked_up(canonical(m), tries))
    return F.when(k == "email", at).when(k == "ip", _ip(m)).when(k == "card", _number(m, True)).when(k == "name", _name(m, width, tries, genders)).otherwise(_number(m, False))


def hinted(text: Column) -> Column:
    """A cheap test that every text with an entity passes."""
    found = text.rlike("[0-9@]")
    for title in (*_FEMALE, *_MALE, "Dr", "Prof"):
        found = found | text.contains(f"{title} ") | text.contains(f"{title}. ")
    return found


def mentions(text: Column) -> Column:
    return F.when(hinted(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def exceptions(df: DataFrame, text: str = "text") -> tuple[int, dict[str, int], dict[str, int]]:
    """The width to draw letters with, the entities that must draw again, with their number of tries,
    and the genders of full names that are known from other mentions only.

    Only addresses, surnames and given names can collide; numbers are permuted.
    """
    found = df.select(F.explode(mentions(F.col(text))).alias("m")).select("m", kind(F.col("m")).alias("k")).where("k IN ('email', 'name')")
    # one row for each address and full name: under which titles it is met, and the spelling that is least
    c, female, male = canonical(F.col("m")), _titled(F.col("m"), _FEMALE), _titled(F.col("m"), _MALE)
    entities = found.groupBy(c.alias("c"), "k").agg(F.min("m").alias("m"), F.max(female).alias("f"), F.max(male).alias("l"), F.max(~female & ~male).alias("n"))
    entities = materialize(entities, "entities")
    try:
        names = entities.where("k = 'name'").withColumn("bare", F.expr("substring(c, 6)")).withColumn("given", _given(F.col("bare"))).withColumn("drawn", _drawn_female(F.col("bare")))
        other = names.where("n AND given <> '' AND f <> l AND f <> drawn").select("bare", "f").collect()
        genders = {r.bare: 1 if r.f else 2 for r in other}
        alone = F.when(F.col("f") != F.col("l"), F.col("f")).otherwise(F.col("drawn"))
        both = F.array_distinct(F.filter(F.array(F.when(F.col("f"), True), F.when(F.col("l"), False), F.when(F.col("n"), alone)), lambda x: x.isNotNull()))
        given = names.where("given <> ''").select(F.col("given").alias("word"), F.explode(both).alias("female")).distinct()
        family = names.select(_family(F.col("bare")).alias("word")).distinct()
        known = entities.where("k = 'email'").select("c", F.col("m").alias("word"), F.lit(False).alias("female"))
        known = known.union(family.select(F.concat(F.lit("family:"), F.col("word")), "word", F.lit(False)))
        known = known.union(given.select(_given_entity(F.col("female"), F.col("word")), "word", "female"))
        known = materialize(known, "known")
        try:
            width, tries = WIDTH, {}
            while True:
                again = _colliding(known, width, tries)
                rows = again.limit(EXCEPTIONS_MOST + 1).collect()
                if len(rows) + len(tries) > EXCEPTIONS_MOST:
                    width, tries = width + 4, {}
                    continue
                if not rows:
                    return width, tries, genders
                tries = tries | {r.c: tries.get(r.c, 0) + 1 for r in rows}
        finally:
            release(known)
    finally:
        release(entities)


def _colliding(known: DataFrame, width: int, tries: dict[str, int]) -> DataFrame:
    c, word, n = F.col("c"), F.col("word"), _looked_up(F.col("c"), tries)
    new = F.when(c.startswith("given:"), F.concat(F.substring(c, 1, 8), F.lower(_new_given(word, F.col("female"), width, n))))
    new = new.when(c.startswith("family:"), F.concat(F.lit("family:"), F.lower(_new_family(word, width, n)))).otherwise(F.concat(F.lit("email:"), F.lower(_email(word, width, n))))
    drawn = known.withColumn("s", new)
    least = drawn.groupBy("s").agg(F.min("c").alias("first"), F.count("*").alias("n")).where("n > 1").select("s", "first")
    shared = drawn.join(least, "s").where("c <> first").select("c")
    met = drawn.where(~c.startswith("given:")).join(known.select(c.alias("s")), "s", "left_semi").select("c")
    return shared.union(met).distinct()


def _looked_up(c: Column, table: dict[str, int]) -> Column:
    """The number of `c` in the table, else 0."""
    if not table:
        return F.lit(0)
    dealt: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for k, n in table.items():
        dealt[zlib.crc32(k.encode()) % BUCKETS][k] = n
    maps = F.from_json(F.lit(json.dumps(dealt)), "array<map<string,int>>")
    return F.coalesce(F.try_element_at(F.get(maps, (F.crc32(c.cast("binary")) % BUCKETS).cast("int")), c), F.lit(0))


def pseudonymized(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows with surrogates in `text`, and `mentions`: the kinds found, in order."""
    width, tries, genders = exceptions(df, text)

    def replace(m: Column) -> Column:
        return surrogate(m, width, tries, genders)

    found = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    gaps = F.split(F.col(text), ANY, -1)
    whole = let(found, lambda ms: F.when(F.size(ms) == 0, F.struct(F.col(text).alias("t"), F.array().cast("array<string>").alias("k"))).otherwise(F.struct(
        F.array_join(F.zip_with(gaps, F.transform(ms, replace), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "").alias("t"), F.transform(ms, kind).alias("k"))))
    done = df.withColumn("_done", F.when(hinted(F.col(text)), whole).otherwise(F.struct(F.col(text).alias("t"), F.array().cast("array<string>").alias("k"))))
    return done.withColumn(text, F.col("_done.t")).withColumn("mentions", F.col("_done.k")).drop("_done")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymized(documents(spark, sf_dir).select("doc_id", "text"))

    def count(name: str) -> Column:
        return F.size(F.filter("mentions", lambda k: k == name)).cast("long").alias(f"n_{name}")

    counts = [count(name) for name in ("email", "ip", "phone", "card", "name")]
    return out.select("doc_id", "text", *counts)
