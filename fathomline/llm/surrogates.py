"""PII surrogates: keyed, type-consistent replacements, by built-in functions alone.

Entities are found by one pattern (e-mail, IPv4, IPv6, card, IBAN, social security number,
phone, API key, long hexadecimal secret, personal name with a title or a listed given name
before a capitalised word; no form has an upper limit of length but those whose format has
one). Words of a name are also replaced where they stand alone elsewhere in the same text,
with listed given names before them. An e-mail address keeps its public suffix, or a domain reserved for examples, alone.

Each entity gets a surrogate of the same form from a keyed permutation: its signs belong
to classes (digits, lower- and upper-case letters of a script; for names vowels and
consonants apart), and a Feistel network over the even and odd places shifts every sign
inside its class by an amount from SHA-256 of the key, the type, the round and the other half. The
network runs forward, one sign is moved on by a fixed keyed amount, and the network runs
back: a permutation without a fixed point. So two entities never share a surrogate, none
keeps its value, and equal entities always get equal surrogates, whatever document or task
they are in: distinctness and coreference need no shared state and no shuffle. Octets of
addresses are permuted as numbers. The last digit of a card and the check digits of an
IBAN move by as much as the check value of the rest does, so valid stays valid and the map
stays one to one.

Names: titles and particles stay. A given name of GIVEN_NAMES becomes another one of its
list, so gender and script match; any other word is permuted inside its letter classes, in
lower case (case is put back by place, so SMITH and Smith agree), longer words keep their
last letter and with it gendered endings, and a result that is a listed name is permuted
again, which keeps the map one to one.

``replace_checked`` holds all entities of a table against their surrogates and changes the
key if two of one kind ever met. A surrogate may equal another person's real value by
chance, as any random value may; ``collisions`` reports those as ``meets_real``.

The key is required. It is part of the query's plan: whoever reads plans or event logs can
read it and undo the surrogates.

Defined results: null texts stay null; empty texts and texts without entities are
unchanged; very long texts are taken whole; repeated rows change alike; an empty table
gives an empty one; extra columns pass through, and a clash with the count columns or an
inner column (``_found``, ``_kinds``, ``_put``, ``_names``) raises ValueError.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable
from dataclasses import dataclass, replace as changed

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.session import discard, materialize

TITLES = r"(?:Mrs?|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Doña|Don|Г-н|Г-жа|Κύριος|Κυρία)\.?"
_WORD = r"(?:\p{Lu}\.|\p{Lu}[\p{L}\p{M}'’]*+)"
_PARTICLE = r"(?:(?:von|van|der|den|de|del|della|di|da|dos|du|la|le|zu|bin|ben|al) )*+"
# Common given names by script and gender.
GIVEN_NAMES = (
    "john james robert michael david thomas peter paul daniel mark george martin hans karl stefan pierre louis antoine carlos miguel pablo javier marco luca".split(),
    "mary anna maria emma laura julia sarah sophie clara helen susan linda karin petra ursula monika camille juliette elena carmen lucia teresa giulia chiara".split(),
    "иван пётр алексей дмитрий сергей андрей николай михаил".split(),
    "анна мария елена ольга наталья татьяна ирина светлана".split(),
    "γιώργος νίκος κώστας δημήτρης γιάννης αλέξανδρος".split(),
    "ελένη κατερίνα σοφία άννα δήμητρα αγγελική".split(),
)
_GIVEN = "(?:" + "|".join(form for names in GIVEN_NAMES for name in names for form in (name.capitalize(), name.upper())) + ")"
# Forms of entities. Loops over groups are possessive or have small bounds: the matcher of the JVM takes
# these without a call per repetition, so no length of text can exhaust its stack.
# Order matters; the first that fits at a place wins.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:(?:\.[\p{L}\p{N}-]++)*+(?<=\.\p{L}{2,63})|(?:\.[\p{L}\p{N}-]++){0,126}\.\p{L}\p{L}+)(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{L}\p{N}_.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{L}\p{N}_]|\.[0-9])",
    "ipv6": r"(?<![\p{L}\p{N}_:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![\p{L}\p{N}_:])",
    "card": r"(?<![\p{L}\p{N}_])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}_]|[ -][0-9])",
    "iban": r"(?<![\p{L}\p{N}_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}_])",
    "ssn": r"(?<![\p{L}\p{N}_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}_]|-[0-9])",
    "phone": r"(?<![\p{L}\p{N}_+])(?<![0-9][ .-])(?:\+(?=(?:[ .()/-]*[0-9]){7})[0-9]{1,3}(?:[ ./-]?(?:\([0-9]++\)|[0-9]++))++|\(?0[0-9]{1,5}\)?[ ./-]?[0-9]{3,}+(?:[ .-][0-9]{2,}+)*+|(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{9,})(?![\p{L}\p{N}_]|[ .-][0-9])",
    "api_key": r"(?<![\p{L}\p{N}_])(?:[sprk]k_(?:live|test)_[0-9A-Za-z]{8,}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{20,}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+)(?![\p{L}\p{N}_])",
    "secret": r"(?<![\p{L}\p{N}_])[0-9A-Fa-f]{32,}(?![\p{L}\p{N}_])",
    "name": rf"(?<![\p{{L}}\p{{M}}])(?=\p{{Lu}})(?:{TITLES} |(?={_GIVEN} {_PARTICLE}\p{{Lu}})){_PARTICLE}{_WORD}(?:[ -]{_PARTICLE}{_WORD})*+",
}
#: A text without any of these signs has no entity.
HINT = rf"[0-9@]|eyJ|AKIA|AIza|xox[abprs]-|gh[pousr]_|_(?:live|test)_|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Sr|Doña|Don|Г-|Κυρ|Κύρ|(?=\p{{Lu}}){_GIVEN} "
_API_HEAD = r"^(?:[sprk]k_(?:live|test)_|AKIA|gh[pousr]_|xox[abprs]-|AIza|eyJ)"
# Classes of signs. Shifts stay inside a class.
DIGITS = "0123456789"
CLASSES = (
    DIGITS,
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæèéêëìíîïòóôõöøùúûüýÿ",
    "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜÝ",
    "çñ",
    "ÇÑ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
HEX_CLASSES = (DIGITS, "abcdef", "ABCDEF")
NAME_CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüý", "çñ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
@dataclass(frozen=True)
class SurrogateParams:
    key: str
    rounds: int = 3

    def __post_init__(self) -> None:
        if not self.key:
            raise ValueError("a key is required")

    def number(self, *parts: str) -> int:
        """A keyed number that does not depend on any entity."""
        return int(hashlib.sha256("|".join((self.key, *parts)).encode()).hexdigest()[:15], 16)


def session_key(spark: SparkSession) -> str:
    """The key in the setting fathomline.surrogates.key. Where it is unset, a random one for this session: surrogates
    then agree inside the session and with no other."""
    name = "fathomline.surrogates.key"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value evaluated once, for use inside lambdas, where no column can hold it."""
    return F.get(F.transform(F.array(value), body), 0)


def _number(*parts: Column | str) -> Column:
    """A keyed number of 60 bits."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _class_of(sign: Column, classes: tuple[str, ...]) -> Column:
    out = F.lit("")
    for members in reversed(classes):
        out = F.when(F.lit(members).contains(sign), F.lit(members)).otherwise(out)
    return out


def _signs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))


def _moved(x: Column, by: Column) -> Column:
    return F.substring(x["c"], (F.pmod(F.instr(x["c"], x["s"]) - 1 + by, F.length(x["c"])) + 1).cast("int"), F.lit(1))


def _turn(kind: Column, signs: Column, r: Column, way: Column, params: SurrogateParams) -> Column:
    """Round r of the network: signs at one half of the places are shifted by what stands at the others, way 1 or -1."""

    def shift(digests: Column) -> Column:
        def by(i: Column) -> Column:
            place = F.floor(i / 2).cast("int")
            return way * F.conv(F.substring(F.get(digests, F.floor(place / 8).cast("int")), place % 8 * 8 + 1, F.lit(8)), 16, 10).cast("long")

        return F.transform(signs, lambda x, i: F.struct(F.when((i % 2 == r % 2) & (x["c"] != ""), _moved(x, by(i))).otherwise(x["s"]).alias("s"), x["c"].alias("c")))

    # One digest of the other half serves eight signs, 32 bits each; longer entities take digests of the first one.
    held = F.array_join(F.transform(F.filter(signs, lambda x, i: i % 2 != r % 2), lambda x: x["s"]), "")
    first = F.sha2(F.concat_ws("|", F.lit(params.key), kind, r.cast("string"), held), 256)
    more = lambda d: F.transform(F.sequence(F.lit(0), F.floor(F.size(signs) / 16).cast("int")), lambda b: F.when(b == 0, d).otherwise(F.sha2(F.concat_ws("|", d, b.cast("string")), 256)))
    return _let(first, lambda d: _let(more(d), shift))


def _bump(kind: Column, signs: Column, params: SurrogateParams) -> Column:
    """The first movable sign goes on by 1 to n - 1 of its n places."""
    amount = lambda x: F.pmod(_number(params.key, kind, "bump"), F.length(x["c"]) - 1) + 1
    first = F.array_position(F.transform(signs, lambda x: x["c"] != ""), F.lit(True)) - 1
    return _let(first, lambda at: F.transform(signs, lambda x, i: F.struct(F.when(i == at, _moved(x, amount(x))).otherwise(x["s"]).alias("s"), x["c"].alias("c"))))


def _text_of(signs: Column) -> Column:
    return F.array_join(F.transform(signs, lambda x: x["s"]), "")


def _address(text: Column, params: SurrogateParams) -> Column:
    """The four octets as two halves of 16 bits, permuted as in _permute."""

    def half(octets: Column, i: int) -> Column:
        return F.get(octets, i).cast("long") * 256 + F.get(octets, i + 1).cast("long")

    def turn(pair: Column, r: int, sign: int) -> Column:
        moved, other = ("a", "b") if r % 2 else ("b", "a")
        new = F.pmod(pair[moved] + F.lit(sign) * F.pmod(_number(params.key, "ip", str(r), pair[other].cast("string")), F.lit(65536)), F.lit(65536))
        return F.struct(*[(new if c == moved else pair[c]).alias(c) for c in ("a", "b")])

    bump = params.number("ip", "bump") % 65535 + 1
    steps: list[Callable[[Column], Column]] = [lambda p, r=r: turn(p, r, 1) for r in range(params.rounds)]
    steps += [lambda p: F.struct(F.pmod(p["a"] + bump, F.lit(65536)).alias("a"), p["b"].alias("b")), *(lambda p, r=r: turn(p, r, -1) for r in reversed(range(params.rounds)))]

    def chain(pair: Column, at: int) -> Column:
        if at == len(steps):
            return F.concat_ws(".", *[x.cast("string") for x in (F.floor(pair["a"] / 256), pair["a"] % 256, F.floor(pair["b"] / 256), pair["b"] % 256)])
        return _let(steps[at](pair), lambda p: chain(p, at + 1))

    return _let(F.split(text, r"\."), lambda o: _let(F.struct(half(o, 0).alias("a"), half(o, 2).alias("b")), lambda p: chain(p, 0)))


def _luhn(text: Column) -> Column:
    """The check digit that the digits of a text, without the last, ask for."""
    digits = F.regexp_extract_all(F.reverse(text), F.lit("([0-9])"), F.lit(1))
    weighed = F.transform(F.slice(digits, F.lit(2), F.greatest(F.size(digits) - 1, F.lit(0))), lambda d, i: F.when(i % 2 == 0, F.floor(d.cast("int") * 2 / 10) + d.cast("int") * 2 % 10).otherwise(d.cast("int")))
    return F.pmod(-F.aggregate(weighed, F.lit(0).cast("long"), lambda acc, v: acc + v), F.lit(10))


def _card(entity: Column, head: Column) -> Column:
    """All digits but the last were permuted; it keeps its distance to the valid check digit."""
    check = F.pmod(F.substring(entity, -1, 1).cast("int") - _luhn(entity) + _luhn(F.concat(head, F.lit("0"))), F.lit(10))
    return F.concat(head, check.cast("string"))


def _iban_check(country: Column, rest: Column) -> Column:
    """The check number that a country and the signs behind the check digits ask for."""
    signs = F.filter(_signs(F.concat(rest, country, F.lit("00"))), lambda s: s != " ")
    value = lambda s: F.when(s.between("0", "9"), F.ascii(s) - 48).otherwise(F.ascii(s) - 55)
    return F.lit(98) - F.aggregate(signs, F.lit(0).cast("long"), lambda acc, s: (acc * F.when(s.between("0", "9"), F.lit(10)).otherwise(F.lit(100)) + value(s)) % 97)


def _iban(entity: Column, rest: Column) -> Column:
    """The country stays, the check digits keep their distance to the valid ones."""
    country = F.substring(entity, 1, 2)
    check = F.pmod(F.substring(entity, 3, 2).cast("int") - _iban_check(country, F.substring(entity, F.lit(5), F.length(entity))) + _iban_check(country, rest), F.lit(100))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), rest)


def _given(params: SurrogateParams) -> dict[str, str]:
    """Each listed name's surrogate: a keyed number of places on in its list, never itself."""
    out = {}
    for number, names in enumerate(GIVEN_NAMES):
        by = params.number("given", str(number)) % (len(names) - 1) + 1
        out |= {name: names[(i + by) % len(names)] for i, name in enumerate(names)}
    return out


def _low(word: Column) -> Column:
    """Lower case where it keeps the length."""
    return F.when(F.length(F.lower(word)) == F.length(word), F.lower(word)).otherwise(word)


def _cased(word: Column, new: Column, params: SurrogateParams) -> Column:
    """Surrogate of a word of a name: another listed name, or its permuted letters in the old word's case."""
    given = _given(params)
    known = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
    low = F.lower(word)
    listed = F.map_contains_key(known, low)
    letters = F.array_join(F.zip_with(_signs(word), _signs(new), lambda old, sign: F.when(old != F.lower(old), F.upper(sign)).otherwise(sign)), "")
    return F.when(listed & (word == F.initcap(low)), F.initcap(known[low])).when(listed & (word == F.upper(low)), F.upper(known[low])).otherwise(letters)


def _pieces(entity: Column, kind: Column) -> Column:
    """An entity cut into (t: text, m: whether it moves)."""
    piece = lambda t, m: F.struct(t.alias("t"), F.lit(m).alias("m"))
    rest_of = lambda head: F.substring(entity, F.length(head) + 1, F.length(entity))
    title = F.regexp_extract(entity, rf"^{TITLES} ", 0)
    words = F.regexp_extract_all(rest_of(title), F.lit(r"([\p{L}\p{M}'’]+|[^\p{L}\p{M}'’]+)"), F.lit(1))
    name = F.concat(F.array(piece(title, False)), F.transform(words, lambda w: F.struct(w.alias("t"), w.rlike(r"^\p{Lu}").alias("m"))))
    # The country code of a number stays, as do the check digits of an IBAN, which are made later.
    head = (
        F.when(kind == "phone", F.regexp_extract(entity, r"^\+[0-9]{1,3}(?=[ ./(-])|^\+[0-9]{1,2}", 0))
        .when(kind == "api_key", F.regexp_extract(entity, _API_HEAD, 0))
        .when(kind == "iban", F.substring(entity, 1, 4))
        .when(kind == "ip", entity)
        .otherwise("")
    )
    # An address keeps its domain's public suffix, or a domain that is reserved for examples and is nobody's.
    tail = F.when(kind == "email", F.regexp_extract(entity, r"(?:(?<=[@.])example\.(?:com|net|org)|(?:\.(?:ac|co|com|edu|gov|ne|net|or|org))?\.[^.@]+)$", 0)).when(kind == "card", F.substring(entity, -1, 1)).otherwise("")
    other = _let(F.struct(head.alias("h"), tail.alias("t")), lambda x: F.array(piece(x["h"], False), piece(F.substring(entity, F.length(x["h"]) + 1, F.length(entity) - F.length(x["h"]) - F.length(x["t"])), True), piece(x["t"], False)))
    return F.when(kind == "name", name).otherwise(other)


def _opened(text: Column, kind: Column) -> Column:
    """The signs of a piece with their classes."""
    by_kind = lambda sign: F.when(kind == "name", _class_of(sign, NAME_CLASSES)).when(kind.isin("secret", "ipv6"), _class_of(sign, HEX_CLASSES)).otherwise(_class_of(sign, CLASSES))
    # Longer words of names keep their last letter.
    stays = lambda t, i: (kind == "name") & (i == F.length(t) - 1) & (F.length(t) > 3)
    return _let(F.when(kind == "name", _low(text)).otherwise(text), lambda t: F.transform(_signs(t), lambda sign, i: F.struct(sign.alias("s"), F.when(stays(t, i), F.lit("")).otherwise(by_kind(sign)).alias("c"))))


def _permuted(text: Column, kind: Column, params: SurrogateParams) -> Column:
    """A piece's signs through the network, and once more where a word of a name became a listed one."""
    rounds = range(params.rounds)
    turn = lambda r, way: F.struct(F.lit(r).alias("r"), F.lit(way).alias("way"))
    turns = F.array(*[turn(r, 1) for r in rounds], turn(0, 0), *[turn(r, -1) for r in reversed(rounds)])
    listed = F.array(*[F.lit(x) for names in GIVEN_NAMES for x in names])
    once = lambda signs: F.aggregate(turns, signs, lambda held, t: F.when(t["way"] == 0, _bump(kind, held, params)).otherwise(_turn(kind, held, t["r"], t["way"], params)))
    goes = lambda signs, k: (k == 0) | ((kind == "name") & F.array_contains(listed, _text_of(signs)))
    return _text_of(F.aggregate(F.array(F.lit(0), F.lit(1)), _opened(text, kind), lambda held, k: F.when(goes(held, k), once(held)).otherwise(held)))


def with_surrogates(step: DataFrame, params: SurrogateParams, kinds: str = "_kinds", out: str = "_put") -> DataFrame:
    """step with surrogates of an array of (e: entity, k: kind), in order.

    Pieces are permuted one by one inside one expression, so that a task holds the signs of one piece at a time.
    """

    def piece(x: Column, p: Column) -> Column:
        new = _permuted(p["t"], x["k"], params)
        return F.when(~p["m"], p["t"]).when(x["k"] == "name", _let(new, lambda n: _cased(p["t"], n, params))).otherwise(new)

    def put(x: Column, texts: Column) -> Column:
        body = F.get(texts, 1)
        return F.when(x["k"] == "card", _card(x["e"], body)).when(x["k"] == "iban", _iban(x["e"], body)).otherwise(F.array_join(texts, ""))

    one = lambda x: F.when(x["k"] == "ip", _address(x["e"], params)).otherwise(_let(F.transform(_pieces(x["e"], x["k"]), lambda p: piece(x, p)), lambda ts: put(x, ts)))
    return step.withColumn(out, F.transform(kinds, one))


def kind_of(entity: Column) -> Column:
    """The kind whose pattern an entity has as a whole; words of names standing alone have none."""
    out = F.lit("name")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


EVERY = "|".join(PATTERNS.values())


def _names(text: Column) -> Column:
    """A pattern of the words of all titled names in a text, as they are and in capitals; null where there is none."""
    titled = F.regexp_extract_all(text, F.lit(f"({PATTERNS['name']})"), F.lit(1))
    behind = F.transform(titled, lambda n: F.regexp_replace(n, rf"^{TITLES} ", ""))
    words = F.array_distinct(F.flatten(F.transform(behind, lambda n: F.regexp_extract_all(n, F.lit(r"(\p{Lu}[\p{L}\p{M}'’]+)"), F.lit(1)))))
    both = F.array_distinct(F.concat(words, F.transform(words, lambda w: F.upper(w))))
    # A listed given name before such a word belongs to it.
    alone = F.concat(F.lit(rf"|(?<![\p{{L}}\p{{M}}])(?=\p{{Lu}})(?:{_GIVEN} ){{0,2}}(?:"), F.array_join(both, "|"), F.lit(r")(?![\p{L}\p{M}])"))
    return F.when(F.size(words) > 0, alone)


def _found(text: Column, names: Column) -> Column:
    """Entities in order; names: the pattern of _names."""
    some = F.when(names.isNull(), F.regexp_extract_all(text, F.lit(f"({EVERY})"), F.lit(1))).otherwise(F.regexp_extract_all(text, F.concat(F.lit(f"({EVERY}"), names, F.lit(")")), F.lit(1)))
    return F.when(text.rlike(HINT), some).otherwise(F.array().cast("array<string>"))


def _replaced(docs: DataFrame, text: str, params: SurrogateParams) -> DataFrame:
    """docs with the text replaced, _kinds (e: entity, k: kind) and _put (surrogates)."""
    step = docs.withColumn("_names", F.when(F.col(text).rlike(HINT), _names(F.col(text))))
    step = step.withColumn("_found", _found(F.col(text), F.col("_names")))
    step = step.withColumn("_kinds", F.transform("_found", lambda e: F.struct(e.alias("e"), kind_of(e).alias("k"))))
    step = with_surrogates(step, params)
    between = F.when(F.col("_names").isNull(), F.split(F.col(text), EVERY)).otherwise(F.split(F.col(text), F.concat(F.lit(EVERY), F.col("_names"))))
    woven = F.array_join(F.zip_with(between, F.col("_put"), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    return step.withColumn(text, F.when(F.size("_found") > 0, woven).otherwise(F.col(text)))


def replace(docs: DataFrame, params: SurrogateParams, text: str = "text") -> DataFrame:
    """docs with entities replaced in the text, and n_email, n_ip, ... counts of what was replaced."""
    return _counted(_replaced(_open(docs), text, params), docs)


def _open(docs: DataFrame) -> DataFrame:
    if clash := {*(f"n_{kind}" for kind in PATTERNS), "_found", "_kinds", "_put", "_names"} & set(docs.columns):
        raise ValueError(f"columns would be overwritten: {sorted(clash)}")
    return docs


def _counted(step: DataFrame, docs: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("_kinds", lambda x: x["k"] == kind)).cast("long")
    return step.select(*docs.columns, *[count(kind).alias(f"n_{kind}") for kind in PATTERNS])


def replace_checked(docs: DataFrame, params: SurrogateParams, text: str = "text", attempts: int = 3) -> DataFrame:
    """As ``replace``, after a check of all entities of the table: if two of a kind share a surrogate, or one kept its
    value, the key is changed and the table replaced anew."""
    for attempt in range(attempts):
        used = params if not attempt else changed(params, key=f"{params.key}/{attempt}")
        done = materialize(_replaced(_open(docs), text, used).drop("_names", "_found"), "surrogates")
        pairs = done.select(F.explode(F.arrays_zip("_kinds", "_put")).alias("x")).select("x._kinds.e", "x._kinds.k", F.col("x._put").alias("p")).distinct()
        met = pairs.groupBy("k", "p").agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("e"))
        if met.where("n > 1 OR e = p").isEmpty():
            return _counted(done, docs)
        discard(done)
    raise RuntimeError(f"surrogates met under {attempts} keys")


def entities(docs: DataFrame, params: SurrogateParams, text: str = "text") -> DataFrame:
    """Distinct (kind, entity, surrogate) of a table; occurrences are reduced in the map tasks."""
    step = _replaced(docs.select(F.col(text).alias("text")), "text", params)
    found = step.select(F.explode(F.arrays_zip("_kinds", "_put")).alias("x")).select(F.col("x._kinds.e").alias("entity"), F.col("x._kinds.k").alias("kind"), F.col("x._put").alias("surrogate"))
    return found.groupBy("kind", "entity", "surrogate").agg(F.count(F.lit(1)).alias("occurrences"))


def collisions(docs: DataFrame, params: SurrogateParams, text: str = "text") -> DataFrame:
    """(kind, entities, surrogates, shared, meets_real): shared counts surrogates of two or more entities, none by design."""
    found = entities(docs, params, text)
    per = found.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"))
    real = found.select("kind", F.col("entity").alias("surrogate"), F.lit(1).alias("real"))
    return (
        per.join(real, ["kind", "surrogate"], "left")
        .groupBy("kind")
        .agg(F.sum("n").alias("entities"), F.count(F.lit(1)).alias("surrogates"), F.count_if(F.col("n") > 1).alias("shared"), F.count("real").alias("meets_real"))
    )
