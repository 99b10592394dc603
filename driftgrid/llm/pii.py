"""PII surrogates: detected entities get keyed replacements of their own type, script, gender and format.

All in DataFrame functions. Entities are found by patterns; numbers with check digits that only look like a card or IBAN in a rare
form must pass the check. A name is found after a title; its parts (given names, family name) have surrogates of their own, so that "Mr. Paul Jones", "Mr. Jones" and a
plain "Jones" agree, and every other mention of a part in the same document, capitalised, is replaced as well.

Surrogates of other types come from a keyed permutation of their format (a Feistel network over the two halves of the value, in which
each letter or digit moves within its own kind), so distinct values of a format have distinct surrogates by construction; check digits are
recomputed. Name parts draw from lists and syllables. Collision checks over the distinct values of the whole corpus then see to it that
no surrogate equals a value that occurs or another surrogate: a value in conflict takes a further attempt, a permutation with another key or a
longer name. Formats of which a quarter or more is in use (a two-digit number) are left to the permutation alone, so the checks always end.
Only the few values with an attempt above 0 are joined back; all others are replaced in place, so texts are not shuffled unless some are.

Null texts stay null; empty texts and texts without entities are unchanged. Rows are mapped one by one, so repeated rows, null ids
and extra columns pass through; where the input has a column named as one of the results, the result's name gets the prefix "pii_".
Mail addresses and names compare without regard to case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, settled, written

# Titles of address by the gender they tell.
TITLES = {
    "male": "Mr|Mister|Sir|Lord|Herr|Monsieur|Señor|господин|κύριος|Κύριος",
    "female": "Mrs|Ms|Miss|Madam|Lady|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|госпожа|κυρία|Κυρία",
    "any": "Dr|Doctor|Doktor|Prof|Professor|Rev|Judge|Captain|доктор|профессор",
}
# Given names of a gender and script (Latin where none is said) to choose from.
GIVEN = {
    "male": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul",
    "female": "Ada Berta Clara Diana Emma Flora Greta Helena Ida Julia Karla Lena Marta Nina Olga Paula",
    "any": "Alex Andrea Ariel Charlie Chris Dominique Eden Jean Kim Luca Morgan Nikita Robin Sam Sascha Toni",
    "male_cyrillic": "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Макар Назар Олег Павел Роман Тимур",
    "female_cyrillic": "Анна Белла Вера Галина Дарья Ева Зоя Инна Клара Лидия Мария Нина Ольга Полина Раиса Тамара",
    "any_cyrillic": "Валя Вася Женя Ира Кира Лера Миша Ника Паша Рома Саша Слава Тася Шура Юля Яна",
    "male_greek": "Άγγελος Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Ιάσων Κώστας Λάμπρος Μάριος Νίκος Ορέστης Πέτρος Σπύρος Τάσος Φώτης",
    "female_greek": "Αθηνά Βάσω Γεωργία Δήμητρα Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Κατερίνα Λίνα Μαρία Νίκη Ξένια Ουρανία Σοφία",
    "any_greek": "Άρης Βαλεντίνη Γιάννα Δάφνη Έλλη Ζήνων Ήβη Θέμις Ίρις Κλειώ Λευκή Μυρτώ Νεφέλη Ξάνθη Ορφέας Σίλια",
}
#: Consonants and vowels of each script.
SYLLABLES = {"latin": ("bdfgklmnprstvzhw", "aeio"), "cyrillic": ("бвгджзклмнпрстфх", "аеио"), "greek": ("βγδζθκλμνπρστφχξ", "αειο")}

_ALL_TITLES = "|".join(TITLES.values())
_NAME = r"\p{Lu}\p{L}+(?:[’'-]\p{L}+)*"
#: Type and pattern, in order of precedence. A secret's group is its value; of a name, the words after the title.
PATTERNS = {
    "secret": r"(?i:(?<![A-Za-z])(?:token|secret|passwd|password|api_?key|access_?key))\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/-]{8,}",
    "access_key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\d+])\+\d(?:[ .()-]{0,2}\d){6,14}(?!\d)|(?<![\d.-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\d-])|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ipv6": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![0-9A-Za-z:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "name": rf"(?<!\p{{L}})(?:{_ALL_TITLES})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts in which no entity can be are passed over after one plain scan.
HINT = rf"[0-9@]|[0-9A-Fa-f]::?[0-9A-Fa-f]|(?i:token|secret|passw|key)|(?:{_ALL_TITLES})\.? "
SEP = "\x1f"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(v: Column) -> Column:
    return F.split(F.regexp_replace(v, r"\D", ""), "").cast("array<int>")


def _luhn(digits: Column) -> Column:
    """The check digit that belongs to these digits."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, b: a + b), F.lit(10)).cast("int")


def _mod97(text: Column) -> Column:
    """The remainder of an IBAN's letters and digits, letters counting from 10."""
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(text, ""), value), F.lit(0), lambda a, b: (a * F.when(b > 9, 100).otherwise(10) + b) % 97)


def _iban_check(country: Column, rest: Column) -> Column:
    """The check number, between 2 and 98, of a country and the account in capitals without spaces."""
    return F.lit(98) - _mod97(F.concat(rest, country, F.lit("00")))


def _type(m: Column) -> Column:
    """The type of a matched string; null for numbers in a rare form whose check digits don't fit."""
    out = F.when(m.rlike(f"^(?:{PATTERNS['secret']})$"), "secret")
    for kind in ("access_key", "email", "iban", "phone", "card", "ip", "ipv6", "ssn"):
        out = out.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    kind, bare = out.otherwise("name"), F.replace(m, F.lit(" "), F.lit(""))
    digits = _digits(m)
    card = (~m.rlike(r"^(?:\d{4}[ -]){3}\d{4}$|^\d{16}$")) & (_luhn(F.slice(digits, 1, F.size(digits) - 1)) != F.element_at(digits, -1))
    iban = (F.length(bare) < 18) & (_iban_check(F.substring(bare, 1, 2), F.substring(bare, 5, 99)) != F.substring(bare, 3, 2).cast("int"))
    return F.when((kind == "card") & card, None).when((kind == "iban") & iban, None).otherwise(kind)


def _units(m: Column) -> Column:
    """A matched string as an array of (type, lead, value): what stands before a value, and the value; of a name, its parts."""

    def plain(kind: Column) -> Column:
        lead = F.when(kind == "secret", F.regexp_extract(m, r"^(?s:.*?[=:]\s{0,3}[\"']?)", 0)).when(kind == "access_key", F.lit("AKIA"))
        lead = lead.when((kind == "phone") & m.startswith("+"), F.regexp_extract(m, r"^\+\d{1,3}", 0)).otherwise("")
        return F.array(F.struct(kind.alias("type"), lead.alias("lead"), F.substring(m, F.length(lead) + 1, F.length(m)).alias("value")))

    def name(kind: Column) -> Column:
        title = F.regexp_extract(m, r"^\p{L}+\.? ", 0)
        gender = F.when(title.rlike(rf"^(?:{TITLES['male']})\b"), "male").when(title.rlike(rf"^(?:{TITLES['female']})\b"), "female").otherwise("any")
        parts = F.split(F.substring(m, F.length(title) + 1, F.length(m)), " ")
        part = lambda x, i: F.struct(F.when(i + 1 < F.size(parts), F.concat(F.lit("given_"), gender)).otherwise("family").alias("type"), F.when(i == 0, title).otherwise(" ").alias("lead"), x.alias("value"))
        return F.transform(parts, part)

    return _let(_type(m), lambda kind: F.when(kind == "name", name(kind)).when(kind.isNotNull(), plain(kind)).otherwise(F.array(F.struct(kind.alias("type"), m.alias("lead"), F.lit("").alias("value")))))


def matches(text: Column) -> Column:
    """The matches of a text, in order, each an array of (type, lead, value); type is null where nothing is to be replaced."""
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), 0))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), _units)


def entities(text: Column) -> Column:
    """The entities of a text, in order: array of (type, lead, value)."""
    return F.filter(F.flatten(matches(text)), lambda e: e["type"].isNotNull())


def _is_name(kind: Column) -> Column:
    return (kind == "family") | kind.startswith("given_")


def _identity(e: Column) -> Column:
    """What entities that refer to the same thing share: of mail addresses and name parts, the value without case."""
    return F.when((e["type"] == "email") | _is_name(e["type"]), F.lower(e["value"])).otherwise(e["value"])


def _stream(*seed: Column | str) -> Column:
    """A keyed stream of hexadecimal digits."""
    whole = F.concat_ws(SEP, *[F.lit(s) if isinstance(s, str) else s.cast("string") for s in seed])
    return F.concat(F.sha2(F.concat_ws(SEP, whole, F.lit("0")), 256), F.sha2(F.concat_ws(SEP, whole, F.lit("1")), 256))


def _number(stream: Column, i: Column) -> Column:
    """The i-th number of a stream, under 65536."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _alphabet(kind: Column, v: Column, c: Column, i: Column, stop: Column) -> Column:
    """The letters or digits that may stand for c, which is at place i; null for what stays."""
    hexadecimal = ((kind == "secret") & v.rlike("^[0-9a-f]+$")) | (kind == "ipv6")
    return (
        F.when(i >= stop, None)
        .when((kind == "card") & (i == 0) & c.between("1", "9"), "123456789")
        .when(c.between("0", "9"), "0123456789")
        .when(hexadecimal & c.between("a", "f"), "abcdef")
        .when(hexadecimal & c.between("A", "F"), "ABCDEF")
        .when(c.between("a", "z"), LOWER)
        .when(c.between("A", "Z"), UPPER)
    )


def _stop(kind: Column, v: Column) -> Column:
    """Where the part that is permuted ends: before the last label of an address, before a card's check digit."""
    return F.when(kind == "email", F.length(v) - F.length(F.regexp_extract(v, r"\.[A-Za-z0-9-]+$", 0))).when(kind == "card", F.length(v) - 1).otherwise(F.length(v))


def _permuted(kind: Column, v: Column, key: str, attempt: Column) -> Column:
    """v under a keyed permutation of its format: places of one parity are moved by a function of the others, four times."""

    def turn(r: int) -> Callable[[Column], Column]:
        def turned(chars: Column) -> Column:
            others = F.array_join(F.filter(chars, lambda c, i: i % 2 != r % 2), "")

            def moved(stream: Column) -> Column:
                def one(c: Column, i: Column) -> Column:
                    return _let(_alphabet(kind, v, c, i, stop), lambda a: F.when((i % 2 == r % 2) & a.isNotNull(), F.substring(a, (F.instr(a, c) - 1 + _number(stream, i)) % F.length(a) + 1, F.lit(1))).otherwise(c))

                return F.transform(chars, one)

            return _let(_stream(key, kind, attempt, F.lit(r), F.length(v), others), moved)

        return turned

    stop, chars = _stop(kind, v), F.split(v, "")
    for r in (1, 0, 3, 2):
        chars = _let(chars, turn(r))
    return F.array_join(chars, "")


def _card(v: Column, permuted: Column) -> Column:
    """permuted with a check digit that is as right, or as wrong, as that of v."""
    body = lambda x: F.slice(_digits(x), 1, F.size(_digits(x)) - 1)
    check = F.pmod(_luhn(body(permuted)) + F.element_at(_digits(v), -1) - _luhn(body(v)), F.lit(10))
    return F.concat(F.substring(permuted, F.lit(1), F.length(permuted) - 1), check.cast("string"))


def _iban(v: Column, account: Column) -> Column:
    """The country of v, a check number that is as right, or as wrong, as that of v, and the permuted account."""
    country, bare = F.substring(v, 1, 2), lambda x: F.replace(x, F.lit(" "), F.lit(""))
    off = F.substring(v, 3, 2).cast("int") - _iban_check(country, bare(F.substring(v, 5, 99)))
    return F.concat(country, F.lpad((F.pmod(_iban_check(country, bare(account)) + off - 2, F.lit(97)) + 2).cast("string"), 2, "0"), account)


def _ip(v: Column, key: str, attempt: Column) -> Column:
    """An address under a keyed permutation of all addresses: its halves are moved by functions of each other."""
    octets = F.split(v, r"\.").cast("array<int>")
    halves = F.array(F.get(octets, F.lit(0)) * 256 + F.get(octets, F.lit(1)), F.get(octets, F.lit(2)) * 256 + F.get(octets, F.lit(3)))

    def turn(r: int) -> Callable[[Column], Column]:
        return lambda h: F.array(F.get(h, F.lit(1)), (F.get(h, F.lit(0)) + _number(_stream(key, "ip", attempt, F.lit(r), F.get(h, F.lit(1))), F.lit(0))) % 65536)

    for r in range(4):
        halves = _let(halves, turn(r))
    return _let(halves, lambda h: F.concat_ws(".", *[(F.floor(F.get(h, F.lit(k)) / 256) if hi else F.get(h, F.lit(k)) % 256).cast("string") for k in (0, 1) for hi in (True, False)]))


def _name(e: Column, key: str, attempt: Column) -> Column:
    """A part of a name: a given name of the same gender and script, with syllables added at later attempts, or syllables."""
    v, kind = e["value"], e["type"]

    def made(stream: Column) -> Column:
        def letter(alphabet: str, i: Column) -> Column:
            return F.substring(F.lit(alphabet), _number(stream, i) % len(alphabet) + 1, F.lit(1))

        def of(script: str) -> Column:
            consonants, vowels = SYLLABLES[script]
            many = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(letter(consonants, i), letter(vowels, i + 8))), "")
            lists = [F.array(*map(F.lit, GIVEN[gender if script == "latin" else f"{gender}_{script}"].split())) for gender in ("male", "female", "any")]
            names = F.when(kind == "given_male", lists[0]).when(kind == "given_female", lists[1]).otherwise(lists[2])
            longer = F.when(attempt > 0, many(F.least(attempt, F.lit(8)))).otherwise("")
            family = F.initcap(many(F.lit(4) + F.least(F.floor(attempt / 4).cast("int"), F.lit(4))))
            return F.when(kind == "family", family).otherwise(F.concat(F.get(names, _number(stream, F.lit(20)) % F.size(names)), longer))

        return F.when(v.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(v.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))

    name = _let(_stream(key, kind, F.lower(v), attempt), made)
    return F.when((v == F.upper(v)) & (F.length(v) > 1), F.upper(name)).otherwise(name)


def surrogate(e: Column, key: str, attempt: Column) -> Column:
    """The replacement of the value of entity e."""
    v, kind = e["value"], e["type"]
    # an address is permuted without case, and gets the capitals of its places back
    cased = lambda new: F.array_join(F.zip_with(F.split(v, ""), F.split(new, ""), lambda old, c: F.when(old != F.lower(old), F.upper(c)).otherwise(c)), "")
    # an IBAN is permuted without its country and check number, an address without case
    body = F.when(kind == "iban", F.substring(v, 5, 99)).when(kind == "email", F.lower(v)).otherwise(v)

    def finished(p: Column) -> Column:
        return F.when(kind == "iban", _iban(v, p)).when(kind == "card", _card(v, p)).when(kind == "email", cased(p)).otherwise(p)

    charwise = _let(body, lambda x: _let(_permuted(kind, x, key, attempt), finished))
    return F.when(_is_name(kind), _name(e, key, attempt)).when(kind == "ip", _ip(v, key, attempt)).otherwise(charwise)


def _format(e: Column) -> Column:
    """The format of a value: what the permutation keeps."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(_identity(e), "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    return F.when(_is_name(e["type"]), "name").when(e["type"] == "email", F.concat(shape, F.regexp_extract(e["value"], r"\.[A-Za-z0-9-]+$", 0))).otherwise(shape)


def _room(e: Column) -> Column:
    """The logarithm to base 10 of the number of values of a format; of secrets, at least."""
    v, kind = e["value"], e["type"]
    each = F.transform(F.split(v, ""), lambda c, i: F.coalesce(F.log10(F.length(_alphabet(kind, v, c, i, _stop(kind, v)))), F.lit(0.0)))
    return F.when(_is_name(kind), 99.0).when(kind == "ip", 9.0).otherwise(F.aggregate(each, F.lit(0.0), lambda a, b: a + b))


def surrogate_attempts(docs: DataFrame, key: str) -> DataFrame:
    """(type, identity, attempt) of the values that need an attempt above 0; every value of docs(text) is checked."""
    found = docs.select(F.explode(entities(F.col("text"))).alias("e")).select(F.col("e.type").alias("type"), _identity(F.col("e")).alias("identity"), F.col("e"))
    # min keeps one spelling and one lead of an identity; the sums are made before the shuffle, so a hot value is a few rows
    values = written(found.groupBy("type", "identity").agg(F.min("e").alias("e")), "pii-values")
    # formats with room: four times the values that occur
    shaped = values.select("type", _format(F.col("e")).alias("format"), _room(F.col("e")).alias("room"))
    roomy = shaped.groupBy("type", "format").agg(F.count("*").alias("n"), F.min("room").alias("room")).where(F.col("room") >= F.log10(F.col("n") * 4.0)).select("type", "format")
    open_ = values.withColumn("format", _format(F.col("e"))).join(roomy, ["type", "format"], "left_semi").drop("format")
    originals = values.select("type", F.lower("e.value").alias("shown"))
    attempt, moved, taken = 0, None, None
    while True:
        tried = written(open_.withColumn("shown", F.lower(surrogate(F.col("e"), key, F.lit(attempt)))), "pii-tried")
        blocked = tried.join(originals, ["type", "shown"], "left_semi")
        if taken is not None:
            blocked = blocked.unionByName(tried.join(taken, ["type", "shown"], "left_semi"))
        first = tried.groupBy("type", "shown").agg(F.min("identity").alias("identity"))
        won = tried.join(first, ["type", "shown", "identity"], "left_semi").join(blocked.select("type", "identity"), ["type", "identity"], "left_anti")
        won = written(won.select("type", "identity", "shown"), "pii-won")
        taken = won.select("type", "shown") if taken is None else taken.unionByName(won.select("type", "shown"))
        if attempt:
            now = won.select("type", "identity", F.lit(attempt).alias("attempt"))
            moved = now if moved is None else moved.unionByName(now)
        rest = written(tried.join(won.select("type", "identity"), ["type", "identity"], "left_anti").select("type", "identity", "e"), "pii-rest")
        if rest.isEmpty():
            break
        open_, attempt = rest, attempt + 1
    return moved if moved is not None else values.select("type", "identity", F.lit(0).alias("attempt")).where("false")


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """docs with text rewritten; adds n_entities (matches), and entities: array of (type, value, surrogate), names by their parts."""
    spark = docs.sparkSession
    own = lambda name: name if name not in docs.columns else own(f"pii_{name}")
    place = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    # the row goes in a struct, so that names of its columns don't matter
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.col("text"))
    with scratch(spark):
        moved = written(surrogate_attempts(docs.select("text"), key).coalesce(1), "pii-moved", lasting=True)
    if moved.isEmpty():
        keyed = rows.withColumn("attempts", F.lit(None).cast("map<string,int>"))
    else:
        occurrences = docs.select(*place, F.explode(F.array_distinct(F.transform(entities(F.col("text")), lambda x: F.struct(x["type"].alias("type"), _identity(x).alias("identity"))))).alias("e"))
        # as few rows as values in conflict; sixteen copies of each spread a hot value over as many tasks
        spread = moved.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        hit = occurrences.select("doc_id", "text_hash", "e.*", F.pmod("text_hash", F.lit(16)).cast("int").alias("salt")).join(spread, ["type", "identity", "salt"])
        per_doc = hit.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(SEP, "type", "identity"), "attempt"))).alias("attempts"))
        per_doc = written(per_doc.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "attempts"), "pii-docs", lasting=True)
        keyed = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_hash")), "left")

    def replaced(x: Column) -> Column:
        attempt = F.coalesce(F.try_element_at("attempts", F.concat_ws(SEP, x["type"], _identity(x))), F.lit(0))
        return F.struct(x["type"].alias("type"), x["value"].alias("value"), F.when(x["type"].isNotNull(), surrogate(x, key, attempt)).otherwise("").alias("surrogate"), x["lead"].alias("lead"))

    units = F.flatten("matches")
    # parts of names of two letters or more, by their lower case; map_from_entries wants each once
    parts = F.filter(units, lambda u: _is_name(F.coalesce(u["type"], F.lit(""))) & (F.length(u["value"]) > 1))
    known = F.aggregate(parts, F.create_map().cast("map<string,string>"), lambda m, u: F.when(F.map_contains_key(m, F.lower(u["value"])), m).otherwise(F.map_concat(m, F.create_map(F.lower(u["value"]), u["surrogate"]))))

    def mentions(gap: Column) -> Column:
        def word(w: Column) -> Column:
            named = F.try_element_at("known", F.lower(w))
            return F.when(named.isNull() | (F.substring(w, 1, 1) == F.lower(F.substring(w, 1, 1))), w).when((w == F.upper(w)) & (F.length(w) > 1), F.upper(named)).otherwise(named)

        return F.array_join(F.transform(F.regexp_extract_all(gap, F.lit(r"\p{L}+(?:[’'-]\p{L}+)*|[^\p{L}]+"), 0), word), "")

    text = F.col("text")
    shown = lambda m: F.array_join(F.transform(m, lambda u: F.concat(u["lead"], u["surrogate"])), "")
    gaps = F.split(text, ENTITY, -1)
    gaps = F.when(F.size("known") > 0, F.transform(gaps, mentions)).otherwise(gaps)
    merged = F.array_join(F.flatten(F.zip_with(gaps, "matches", lambda gap, m: F.array(gap, F.coalesce(shown(m), F.lit(""))))), "")
    found = keyed.withColumn("matches", F.transform(matches(text), lambda m: F.transform(m, replaced))).withColumn("known", known)
    found = found.withColumn("new_text", F.when(F.size("matches") > 0, merged).otherwise(text))
    listed = F.transform(F.filter(units, lambda u: u["type"].isNotNull()), lambda u: F.struct(u["type"].alias("type"), u["value"].alias("value"), u["surrogate"].alias("surrogate")))
    n = F.size(F.filter("matches", lambda m: F.exists(m, lambda u: u["type"].isNotNull()))).cast("long")
    columns = [F.col("new_text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return settled(found.select(*columns, n.alias(own("n_entities")), listed.alias(own("entities"))))
