"""Surrogates for personal data, in DataFrame operations only.

Entities are e-mail addresses, telephone, card, account and social security numbers, IPv4 addresses, long hexadecimal and prefixed secrets, and
persons named after a title. One value has one surrogate wherever it occurs and however it is punctuated (coreference), and two values never share
one (distinctness): each distinct value draws its surrogate from SHA-256 of key, type, value and attempt, and the values whose draw equals another's
or a real value of the corpus draw again until none do; surnames get a syllable more with each attempt. Surrogates keep the type: digits stay digits in their
format, a card number that passes the Luhn check gets one that does, country code and first card digit stay, IPv4 addresses go to the reserved
block 240/4, a valid account number gets valid check digits, secrets of any length keep length and alphabet, addresses keep their case, and persons get a name of the title's gender
in the script of the name. First names and surnames have surrogates of their own, so "Mr John Smith" and "Mr Smith" stay one family, and a full
name that a title introduces is replaced wherever else its text has it. Names that no title introduces in their text are not found.

Only texts with a part that some pattern needs (three digits, an @, a secret's prefix, a title and the like) are searched. Values and their surrogates are tables joined by value; a value that occurs in many
documents is one row of the mapping.

Defined cases: a null text stays null; texts without entities stay as they are; repeated rows get equal results; null ids are ids like any other;
extra columns are kept by ``pseudonymize``, but for an ``n_entities``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import materialize

# Titles and the names that stand in, by gender and script.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Г-н")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Г-жа")
OTHER_TITLES = ("Dr", "Prof", "Доктор")
NAMES = {
    ("m", "latin"): ("Alan", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marco", "Nils", "Oscar", "Paul"),
    ("f", "latin"): ("Alma", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("n", "latin"): ("Alex", "Robin", "Kim", "Sascha", "Toni", "Noel", "Jamie", "Charlie", "Andrea", "Dominique", "Camille", "Eden", "Jess", "Luca", "Mika", "Sam"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей", "Фёдор"),
    ("f", "cyrillic"): ("Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "Софья", "Юлия"),
    ("n", "cyrillic"): ("Саша", "Женя", "Валя", "Слава", "Паша", "Шура", "Тоня", "Витя", "Рита", "Ника", "Люся", "Гена", "Федя", "Толя", "Нюра", "Лёня"),
}
SYLLABLES = {
    "latin": ("ba", "den", "fo", "gar", "hel", "jo", "kin", "lam", "mo", "ner", "pol", "ros", "sten", "tur", "vel", "win"),
    "cyrillic": ("ба", "ден", "фо", "гар", "хел", "ёл", "кин", "лам", "мо", "нер", "пол", "рос", "стен", "тур", "вел", "вин"),
}

_TITLES = "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Types in the order in which they are tried at one place of a text.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?<![0-9A-Za-z])(?:(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}|(?:AKIA|ghp_|sk-|xox[bp]-)[0-9A-Za-z_-]{16,})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?(?=[A-Z]{0,2}\d)[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![\d.+-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\d)",
    "phone": r"(?<![\d.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\d.-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "person": rf"(?<![\p{{L}}\p{{N}}-])(?:{_TITLES})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Something that every match of a pattern above contains; texts without it are not searched.
_MAYBE = rf"\d{{3}}|@|\d\.\d|\+\d|[A-Z]{{2}}\d{{2}}|[0-9A-Fa-f]{{32}}|(?:AKIA|ghp_|sk-|xox[bp]-)[0-9A-Za-z_-]{{16}}|(?:{_TITLES})\.? \p{{Lu}}"
ATTEMPTS = 40
#: Most texts whose replacements are sent to all executors.
BROADCAST_TEXTS = 100_000


def _kind(entity: Column) -> Column:
    out = F.lit("person")
    for kind in reversed([k for k in PATTERNS if k != "person"]):
        out = F.when(entity.rlike(rf"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def _value(kind: Column, entity: Column) -> Column:
    """What makes two mentions the same: digits for numbers, lower case for addresses and hex, the surname for persons."""
    digits = F.regexp_replace(entity, r"\D", "")
    plain = F.upper(F.regexp_replace(entity, r"[ -]", ""))
    name = F.element_at(F.split(entity, " "), -1)
    return F.when(kind.isin("card", "phone", "ssn"), digits).when(kind == "iban", plain).when(kind.isin("email", "secret"), F.lower(entity)).when(kind == "ip", entity).otherwise(name)


def _nibble(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, k + 1, 1), 16, 10).cast("int")


def _pick(options: tuple[str, ...], digest: Column, k: int) -> Column:
    return F.get(F.array(*map(F.lit, options)), _nibble(digest, k))


def _syllables(options: tuple[str, ...], nibbles: Column) -> Column:
    return F.array_join(F.transform(F.split(nibbles, ""), lambda c: F.get(F.array(*map(F.lit, options)), F.conv(c, 16, 10).cast("int"))), "")


def _digits(digest: Column, n: Column) -> Column:
    """``n`` decimal digits, from the hex digits of the digest (twice its length of 64 at most)."""
    return F.substring(F.translate(F.concat(digest, F.reverse(digest)), "abcdef", "258147"), F.lit(1), n)


def _luhn(number: Column) -> Column:
    """Sum of the Luhn check over all digits."""
    places = F.transform(F.reverse(F.split(number, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x)


def _mod97(account: Column) -> Column:
    """The account number, letters counting from 10 on, modulo 97."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.conv(c, 36, 10).cast("int")).otherwise(a * 100 + F.conv(c, 36, 10).cast("int")) % 97
    return F.aggregate(F.split(account, ""), F.lit(0), step)


def _country(kind: Column, entity: Column) -> Column:
    """Number of digits of the country code that a mention of a phone number sets off; 0 for others."""
    return F.when((kind == "phone") & entity.startswith("+"), F.length(F.regexp_extract(entity, r"^\+(\d{1,3})(?=[ .(-])", 1))).otherwise(0)


def _surrogate(kind: Column, value: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The value that stands in, before the mention's own format is put on it; a phone's ``gender`` says what its country code leaves of 9."""
    d = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string")), 256)
    n = F.length(value)
    body = F.concat(F.substring(value, 1, 1), _digits(d, n - 1))
    stem = F.substring(body, F.lit(1), n - 1)
    check = (10 - _luhn(F.concat(stem, F.lit("0"))) % 10) % 10
    card = F.when(_luhn(value) % 10 == 0, F.concat(stem, check.cast("string"))).otherwise(body)
    ip = F.concat_ws(".", (240 + _nibble(d, 0) % 15).cast("string"), *((_nibble(d, 1 + 2 * k) * 16 + _nibble(d, 2 + 2 * k)).cast("string") for k in range(3)))
    email = F.concat(F.lit("user"), F.substring(d, 1, 12), F.lit("@"), F.substring(F.sha2(F.concat(F.lit(key), F.substring_index(value, "@", -1)), 256), 1, 8), F.lit(".example"))
    start = F.regexp_extract(value, r"^(akia|ghp_|sk-|xox[bp]-)?", 0)
    secret = F.concat(start, F.rpad(d, n - F.length(start), F.reverse(d)))
    land, account = F.substring(value, 1, 2), _digits(d, n - 4)
    valid = _mod97(F.concat(F.substring(value, F.lit(5), n), F.substring(value, 1, 4))) == 1
    checked = F.concat(land, F.lpad((98 - _mod97(F.concat(account, land, F.lit("00")))).cast("string"), 2, "0"), account)
    iban = F.when(valid, checked).otherwise(F.concat(land, _digits(d, n - 2)))
    person = given = F.lit(None).cast("string")
    for (g, script), names in NAMES.items():
        here = value.rlike(r"\p{IsCyrillic}") if script == "cyrillic" else ~value.rlike(r"\p{IsCyrillic}")
        last = F.initcap(_syllables(SYLLABLES[script], F.substring(d, F.lit(2), attempt + 4)))  # longer with each attempt, so that draws end
        person = F.when(here & (gender == g), last).otherwise(person)
        more = _syllables(SYLLABLES[script], F.substring(d, F.lit(2), attempt))
        given = F.when(here & (gender == g), F.concat(_pick(names, d, 0), F.when(attempt > 0, more).otherwise(""))).otherwise(given)
    country = F.coalesce(9 - gender.try_cast("int"), F.lit(0))
    # A format whose numbers run out gets more digits.
    phone = F.concat(F.substring(value, F.lit(1), country), _digits(d, n - country + F.greatest(attempt - ATTEMPTS // 2, F.lit(0))))
    return F.when(kind == "card", card).when(kind == "ip", ip).when(kind == "email", email).when(kind == "secret", secret).when(kind == "iban", iban).when(kind == "person", person).when(kind == "given", given).otherwise(phone)


def _formatted(kind: Column, entity: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's punctuation, case and, for persons, after its title."""
    start = F.struct(F.lit("").alias("o"), F.lit(0).alias("k"))

    def step(a: Column, c: Column) -> Column:
        mine = F.substring(surrogate, a["k"] + 1, F.lit(1))
        is_place = F.when(kind == "iban", c.rlike("[0-9A-Z]")).otherwise(c.rlike("[0-9]"))
        return F.struct(F.concat(a["o"], F.when(is_place, mine).otherwise(c)).alias("o"), (a["k"] + F.when(is_place, 1).otherwise(0)).alias("k"))

    punctuated = F.aggregate(F.split(entity, ""), start, step, lambda a: F.concat(a["o"], F.substring(surrogate, a["k"] + 1, F.length(surrogate))))
    cased = F.when(entity == F.upper(entity), F.upper(surrogate)).otherwise(surrogate)
    title = F.regexp_extract(entity, rf"^(?:{_TITLES})\.? ", 0)
    return F.when(kind.isin("card", "phone", "ssn", "iban"), punctuated).when(kind.isin("email", "secret"), cased).when(kind == "ip", surrogate).otherwise(F.concat(title, surrogate))


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, at, entity, kind, value, gender, given) of every entity; ``at`` counts them from 0 in each text, ``given`` is a person's first name."""
    # Two steps and an outer generator: the patterns run once for each text.
    texts = docs.where(F.col("text").rlike(_MAYBE)).select("doc_id", F.xxhash64("text").alias("text_key"), F.regexp_extract_all("text", F.lit(_ANY), F.lit(0)).alias("entities"))
    found = texts.select("doc_id", "text_key", F.posexplode_outer("entities").alias("at", "entity")).where("entity IS NOT NULL")
    found = found.distinct().withColumn("kind", _kind(F.col("entity")))
    title = F.regexp_extract("entity", rf"^({_TITLES})\.? ", 1)
    gender = F.when(title.isin(*MALE_TITLES), "m").when(title.isin(*FEMALE_TITLES), "f").otherwise("n")
    # The least of a value's mentions counts: for a phone, the longest country code that one of them sets off.
    gender = F.when(F.col("kind") == "phone", (9 - _country(F.col("kind"), F.col("entity"))).cast("string")).otherwise(gender)
    given = F.when(F.col("kind") == "person", F.nullif(F.regexp_extract("entity", rf"^(?:{_TITLES})\.? (\S+) \S", 1), F.lit("")))
    return found.withColumn("value", _value(F.col("kind"), F.col("entity"))).withColumn("gender", gender).withColumn("given", given)


def mapping(found: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate), one to one: draws that collide with another value's draw or with a real value are drawn again."""
    if "given" in found.columns:
        first = found.where("given IS NOT NULL").select(F.lit("given").alias("kind"), F.col("given").alias("value"), "gender")
        found = found.select("kind", "value", "gender").union(first)
    values = found.groupBy("kind", "value").agg(F.min("gender").alias("gender"))
    drawn = values.withColumn("attempt", F.lit(0)).withColumn("surrogate", _surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.lit(0), key))
    drawn = materialize(drawn, "surrogates")
    for _ in range(ATTEMPTS):
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"), F.count("*").alias("n"))
        shared = first.where("n > 1").select("kind", "surrogate", "owner")
        real = drawn.select("kind", F.col("value").alias("surrogate"), F.lit(None).cast("string").alias("owner")).join(drawn.select("kind", "surrogate"), ["kind", "surrogate"], "left_semi")
        clash = materialize(shared.union(real).distinct(), "clashes")
        if clash.isEmpty():
            return drawn.select("kind", "value", "surrogate")
        losers = drawn.join(clash, ["kind", "surrogate"]).where("owner IS NULL OR value <> owner").select("kind", "value", F.lit(True).alias("again")).distinct()
        redo = drawn.join(losers, ["kind", "value"], "left").withColumn("attempt", F.col("attempt") + F.when(F.col("again"), 1).otherwise(0))
        draw = F.when(F.col("again"), _surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.col("attempt"), key)).otherwise(F.col("surrogate"))
        drawn = materialize(redo.withColumn("surrogate", draw).drop("again"), "surrogates")
    raise RuntimeError(f"surrogates still collide after {ATTEMPTS} draws")


def pseudonymize(docs: DataFrame, key: str = "sextant") -> DataFrame:
    """The documents with every entity replaced, and ``n_entities`` (long) added."""
    names = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(*names)
    found = materialize(mentions(docs), "mentions")
    drawn = materialize(mapping(found, key), "mapping")
    first = drawn.where("kind = 'given'").select(F.col("value").alias("given"), F.col("surrogate").alias("first"))
    named = found.join(drawn, ["kind", "value"]).join(first, "given", "left")
    surrogate = F.when(F.col("kind") == "person", F.concat_ws(" ", "first", "surrogate")).otherwise(F.col("surrogate"))
    new = _formatted(F.col("kind"), F.col("entity"), surrogate)
    # A full name that a title introduces is replaced in the rest of its text too.
    full = F.when(F.col("given").isNotNull(), F.struct(F.concat_ws(" ", "given", "value").alias("old"), surrogate.alias("new")))
    named = named.select("doc_id", "text_key", "at", new.alias("new"), full.alias("full"))
    lists = named.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("new"), F.sort_array(F.collect_set("full")).alias("full"))
    lists = materialize(lists.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("new.new").alias("__new"), F.col("full").alias("__full")), "replacements")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    if lists.count() <= BROADCAST_TEXTS:
        both, rest = docs.join(F.broadcast(lists), same, "left"), None
    else:  # texts that were not searched pass by the join and are not shuffled
        maybe = F.coalesce(F.col("text").rlike(_MAYBE), F.lit(False))
        both, rest = docs.where(maybe).join(lists, same, "left"), docs.where(~maybe).withColumn("n_entities", F.lit(0).cast("long"))
    joined = F.array_join(F.zip_with(F.split("text", _ANY, -1), "__new", lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    quoted = lambda x: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), x["old"], F.lit(r"\E(?![\p{L}\p{N}])"))
    joined = F.aggregate("__full", joined, lambda t, x: F.regexp_replace(t, quoted(x), x["new"]))
    both = both.withColumn("text", F.when(F.col("__new").isNull(), F.col("text")).otherwise(joined))
    both = both.withColumn("n_entities", F.coalesce(F.size("__new"), F.lit(0)).cast("long")).select(*names, "n_entities")
    return both if rest is None else both.unionByName(rest)
