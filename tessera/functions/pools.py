"""Fake-data pools. A pool is a rule from an index to a value, over short lists made of syllables, so no table is shipped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERSONS, OTHERS = 20_000, 10_000
#: Distinct first and last names; their pairs are the persons.
NAMES = 142
PERSON_TYPES = ("human_name", "first_name", "last_name", "human_name_kana", "first_name_kana", "last_name_kana")
KANA_TYPES = ("human_name_kana", "first_name_kana", "last_name_kana")
TYPES = (*PERSON_TYPES, "phone_number", "address", "company_name", "email", "username")
LOCALES = ("en", "ja")

# The syllables that names are made of.
_HEADS = ["Al", "Ber", "Cor", "Dan", "El", "Fer", "Gar", "Hol", "Ir", "Jor", "Kel", "Lor"]
_TAILS = ["a", "bert", "den", "ette", "is", "la", "mond", "nie", "o", "ric", "ston", "vin"]
_LAST_HEADS = ["Ash", "Birch", "Clay", "Dun", "East", "Fair", "Glen", "Hart", "King", "Lang", "Mill", "North"]
_LAST_TAILS = ["ard", "berg", "croft", "dale", "er", "field", "gate", "ham", "ley", "man", "son", "wood"]
_KANJI_HEADS, _KANJI_TAILS = list("山川田森林石高小大中西北"), list("本田村井口島野原崎谷沢橋")
_KANA_HEADS = ["ヤマ", "カワ", "タ", "モリ", "ハヤシ", "イシ", "タカ", "コ", "オオ", "ナカ", "ニシ", "キタ"]
_KANA_TAILS = ["モト", "ダ", "ムラ", "イ", "グチ", "シマ", "ノ", "ハラ", "ザキ", "タニ", "サワ", "ハシ"]
_GIVEN_HEADS, _GIVEN_TAILS = list("一健真直和美恵智春秋優明"), list("太郎子也人香奈樹介代実彦")
_GIVEN_KANA_HEADS = ["カズ", "ケン", "マ", "ナオ", "カズ", "ミ", "エ", "トモ", "ハル", "アキ", "ユウ", "アキ"]
_GIVEN_KANA_TAILS = ["タ", "ロウ", "コ", "ヤ", "ト", "カ", "ナ", "キ", "スケ", "ヨ", "ミ", "ヒコ"]
_STREETS = ["Street", "Road", "Lane", "Brook", "Avenue", "Court"]
_FORMS = ["Inc", "LLC", "Group", "and Sons", "Partners"]


def _names(heads: list[str], tails: list[str]) -> list[str]:
    return [h + t for h in heads for t in tails][:NAMES]


def lists(locale: str) -> dict[str, list[str]]:
    """The first and last names of a locale, and their kana."""
    if locale == "ja":
        return {"first": _names(_GIVEN_HEADS, _GIVEN_TAILS), "last": _names(_KANJI_HEADS, _KANJI_TAILS), "first_kana": _names(_GIVEN_KANA_HEADS, _GIVEN_KANA_TAILS), "last_kana": _names(_KANA_HEADS, _KANA_TAILS)}
    return {"first": _names(_HEADS, _TAILS), "last": _names(_LAST_HEADS, _LAST_TAILS)}


def digest(seed: Column) -> Column:
    """Hex SHA-256 of the seed as text; null counts as the empty text."""
    return F.sha2(F.coalesce(seed.cast("string"), F.lit("")), 256)


def index(seed: Column, size: int) -> Column:
    """The first eight bytes of the digest, as a big-endian number, modulo the pool's size."""
    return index_of(digest(seed), size)


def index_of(hexed: Column, size: int) -> Column:
    """`index` of a digest: fifteen hex digits fit in a long, and the sixteenth is the place of its digit."""
    most = F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")
    last = F.instr(F.lit("123456789abcdef"), F.substring(hexed, 16, 1))
    return ((most % size * 16 + last) % size).cast("int")


def token(seed: Column) -> Column:
    """Bytes 8 to 15 of the digest, in hex."""
    return F.substring(digest(seed), 17, 16)


def pool_size(kind: str) -> int:
    return PERSONS if kind in PERSON_TYPES or kind in ("email", "username") else OTHERS


def _pick(values: list[str], at: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), at.cast("int"))


def _over(at: Column, n: int) -> Column:
    """The whole part of a quotient of counts, without a way over doubles."""
    return ((at - at % n) / n).cast("int")


def value(kind: str, seed: Column, locale: str = "en") -> Column:
    """The fake value of a type for a seed. For one seed the name types describe one person."""
    hexed = digest(seed)
    return value_at(kind, hexed, index_of(hexed, pool_size(kind)), locale)


def value_at(kind: str, hexed: Column, at: Column, locale: str = "en") -> Column:
    """The fake value of a type for a seed's digest and its index in the type's pool."""
    if kind not in TYPES or locale not in LOCALES or kind in KANA_TYPES and locale != "ja":
        raise ValueError(f"no fake data of type {kind!r} for locale {locale!r}")
    own, english = lists(locale), lists("en")
    if kind in PERSON_TYPES or kind in ("email", "username"):
        person = at
        # spread over both lists: every person is another pair
        first, last = person % NAMES, (_over(person, NAMES) + person) % NAMES
        kana = "_kana" if kind.endswith("_kana") else ""
        if kind.startswith("first_name"):
            return _pick(own["first" + kana], first)
        if kind.startswith("last_name"):
            return _pick(own["last" + kana], last)
        if kind.startswith("human_name"):
            names = _pick(own["first" + kana], first), _pick(own["last" + kana], last)
            return F.concat_ws(" ", *(reversed(names) if locale == "ja" else names))
        small = {k: [v.lower() for v in english[k]] for k in ("first", "last")}
        rest = (F.lit("." if kind == "email" else "_"), F.substring(hexed, 17, 16), *([F.lit("@example.com")] if kind == "email" else []))
        return F.concat(_pick(small["first"], first), F.lit("."), _pick(small["last"], last), *rest)
    if kind == "phone_number":
        return F.format_string("(555) %03d-%04d", (at % 900 + 100).cast("int"), (at * 7919 % 10000).cast("int"))
    if kind == "address":
        return F.concat((at % 999 + 1).cast("string"), F.lit(" "), _pick(english["last"], at % NAMES), F.lit(" "), _pick(_STREETS, at % len(_STREETS)), F.lit(", "), _pick(english["last"], F.floor(at / NAMES) % NAMES), F.lit("ton"))
    return F.concat(_pick(english["last"], at % NAMES), F.lit("-"), _pick(english["last"], F.floor(at / NAMES) % NAMES), F.lit(" "), _pick(_FORMS, at % len(_FORMS)))
