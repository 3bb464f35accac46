"""Personal data: keyed surrogates of the same type and form.

Detected entities are replaced by surrogates that a secret key derives from
the entity alone, so that the same entity gets the same surrogate everywhere
(coreference).  A person's given and family names are entities of their own,
so a name keeps its surrogate whatever stands before or beside it; letter case
and, in numbers, separators don't count.  Digits, letters and separators keep
their places, letter case and script; given names keep their gender.  Values
of one form go through a keyed permutation of that form, which cannot collide.
What remains is checked over the whole corpus: a surrogate that two entities
share, or that occurs as an original, is drawn again until none is left
(distinctness).  Where a form has too few values for that, late draws are
longer than the original.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructType

from .common import BROADCAST_ROWS, cut, fresh, map_slices, map_whole_rows, table

KEY = b"surrogates-1"
#: Rounds in which colliding surrogates are drawn again in the same form; in each later one they are longer by one more character.
ROUNDS = 4
#: Rounds after which a form that can't be longer is given up as full, with an error: more than some 10**8 addresses or numbers would have to be in use.
MOST_ROUNDS = 200

# Frequent given names by script and gender, and titles by gender.
GIVEN = {
    ("latin", "f"): "Alice Amelia Ana Anna Anne Barbara Camille Carmen Catherine Charlotte Claire Elena Elizabeth Emily Emma Hannah Isabella Jessica Julia Karen Laura Linda Lucia Margaret Maria María Marie Martina Mary Monica Nancy Olivia Patricia Rachel Rebecca Sandra Sarah Sofia Sophie Susan Teresa Victoria".split(),
    ("latin", "m"): "Alexander Andrew André Antonio Benjamin Carlos Charles Christopher Daniel David Edward Francisco François George Hans Henry Jacob James Jean John José Joseph Juan Jürgen Julian Klaus Louis Lucas Luis Manuel Mark Martin Matthew Michael Miguel Nicolas Oliver Patrick Paul Pedro Peter Philip Pierre René Richard Robert Samuel Stefan Thomas William Wolfgang".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Señorita Sra Госпожа".split(),
    "m": "Mr Sir Herr Monsieur Señor Sr Господин".split(),
    "": "Dr Prof".split(),
}
#: Words after which two capitalised words or more are a person's name, whatever they are.
_CONTEXT = ["my name is", "my name's", "full name:", "name:", "signed by", "contact person:", "attn:", "mein name ist", "ich heiße", "je m'appelle", "mon nom est", "me llamo", "mi nombre es", "nombre:", "nom:"]
#: Closings of a letter, before a line that is a name; and words that no person's name has there.
_CLOSINGS = ["best regards", "kind regards", "warm regards", "regards", "sincerely", "yours sincerely", "yours truly", "yours faithfully", "best wishes", "mit freundlichen grüßen", "viele grüße", "cordialement", "bien à vous", "atentamente", "saludos cordiales", "un saludo"]
_NO_PERSON = "The|Your|Our|All|Team|Customer|Support|Service|Services|Sales|Office|Department|Desk|Help|News|Group|Company|Press|From|To|Cc|Contact|Email|Mail|Write"
_CALLED = ["call", "phone", "tel", "telephone", "fax", "mobile", "cell", "dial", "telefon", "téléphone", "teléfono", "llame al", "appelez le"]
#: Letters that replace one another, by script and sound: a letter's class keeps the sound of a word.
_CLASSES = ["bcdfghjklmnpqrstvwxz", "aeiouy", "àáâãäåèéêëìíîïòóôõöøùúûüæ", "çñðþ", "бвгджзклмнпрстфхцчшщ", "аеёиоуыэюя"]
#: Country codes of two digits; 1 and 7 have one, all others three.
_COUNTRIES = {*"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}

_UP, _LOW = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
_SURNAME = rf"[{_UP}][{_LOW}]+(?:[-'’][{_UP}][{_LOW}]+)*"
_CAPITALS = rf"[{_UP}]{{2,}}(?:[-'’][{_UP}]{{2,}})*"
_GAP = "[ \\t]{1,3}"
_GIVEN_GENDER = {n: g for (_, g), names in GIVEN.items() for n in names}
_TITLE_GENDER = {t: g for g, titles in TITLES.items() for t in titles}

#: What may stand between the groups of a phone number, marks that litter a text included.
_BETWEEN = r"[ .\-#*$%&|!]{0,5}"
#: Kinds with their patterns, in order of precedence, and a cheap test that must hold for a pattern to be tried.
PATTERNS = [
    ("secret", re.compile(r"(?i)\b(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|passwd|password)\b[\"']?\s*(?:(?:[:=]|\bis\b)\s*(?=[^\s\"']*\d)|[:=]\s*(?=[\"']))[\"']?(?P<v>[A-Za-z0-9_\-+/=.]{7,}[A-Za-z0-9_\-+/=])"), ("token", "key", "secret", "passw")),
    ("secret", re.compile(r"(?i)\bbearer\s+(?=[^\s]*\d)(?P<v>[A-Za-z0-9_\-+/=.]{15,}[A-Za-z0-9_\-+/=])"), ("bearer",)),
    ("secret", re.compile(r"\b(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,})"), ("akia", "asia", "gh", "sk-", "xox")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?P<v>[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])"), None),
    ("email", re.compile(r"(?P<v>[A-Za-z0-9À-ɏ](?:[A-Za-z0-9À-ɏ._%+\-]*[A-Za-z0-9À-ɏ_%+\-])?@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24})(?![A-Za-z0-9])"), ("@",)),
    ("ipv4", re.compile(r"(?<![\d.])(?P<v>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\d]|\.\d)"), None),
    ("ipv6", re.compile(r"(?<![\w:.])(?P<v>(?:[0-9A-Fa-f]{1,4}::?){2,7}[0-9A-Fa-f]{1,4})(?![\w:]|\.\d)"), None),
    ("id", re.compile(r"(?i:\b(?:passport|reisepass|passeport|pasaporte|driver'?s licen[cs]e|national id|tax id|identity card|personalausweis)\b[ \t]*(?:(?:number|no|nr|num|id|is)\b\.?[ \t]*){0,2}[:#]?[ \t]*)(?P<v>(?=[A-Z]*\d)[A-Z0-9]{6,14})(?![\w-])"), ("pass", "pasaporte", "licen", "national id", "tax id", "identity card", "ausweis")),
    ("iban", re.compile(r"\b(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)\b"), None),
    ("ssn", re.compile(r"(?<![\d-])(?P<v>\d{3}-\d{2}-\d{4})(?![\d-])"), None),
    ("phone", re.compile(r"(?<![\w+])(?P<v>\+\d{1,3}@(?:\(\d{1,4}\)@)?\d{2,4}(?:@\d{2,4}){1,4}|\(\d{3}\)@\d{3}[.\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\w])".replace("@", _BETWEEN)), None),
    ("card", re.compile(r"(?<![\d.\-])(?P<v>\d(?:[ \-]?\d){12,18})(?![\d\-]|\.\d)"), None),
    ("phone", re.compile(r"(?<![\w+.\-])(?P<v>0\d{1,4}[ \-]\d{3,4}[ \-]?\d{3,4})(?![\w\-]|\.\d)"), None),
    ("phone", re.compile(rf"(?i)\b(?:{'|'.join(_CALLED)})\b[.:]?\s*(?:(?:me|us|at|on|is|no|number|nummer|numéro|número|under|au)\b[.:]?\s*){{0,3}}(?P<v>\(?\d(?:[ .\-()]{{0,2}}\d){{6,13}})(?![\w\-]|\.\d)"), None),
    ("name", re.compile(rf"\b(?P<t>{'|'.join(_TITLE_GENDER)})\b\.?{_GAP}(?P<v>(?:{_SURNAME}|{_CAPITALS})(?:{_GAP}(?:{_SURNAME}|{_CAPITALS}))?)"), None),
    ("name", re.compile(rf"\b(?P<v>(?:{'|'.join(_GIVEN_GENDER)}){_GAP}{_SURNAME})\b"), None),
    ("name", re.compile(rf"\b(?P<v>(?:{'|'.join(n.upper() for n in _GIVEN_GENDER)}){_GAP}{_CAPITALS})\b"), None),
    ("name", re.compile(rf"(?i:^|(?<=\n))[ \t]*(?i:{'|'.join(_CLOSINGS)}),?[ \t]*\r?\n[ \t]*(?P<v>(?!(?:{_NO_PERSON})\b){_SURNAME}(?:{_GAP}(?!(?:{_NO_PERSON})\b){_SURNAME}){{1,2}})[ \t]*(?=[\r\n,]|$)"), tuple(_CLOSINGS)),
    ("name", re.compile(rf"(?<![\w-])(?P<v>(?!(?:{_NO_PERSON})\b){_SURNAME}(?:{_GAP}(?!(?:{_NO_PERSON})\b){_SURNAME}){{1,2}})(?=[ \t]*<\x00)"), ("@",)),
    ("name", re.compile(rf"\b(?i:{'|'.join(_CONTEXT)})\s*(?P<v>{_SURNAME}(?:{_GAP}{_SURNAME}){{1,2}})"), ("name", "nom", "signed by", "contact person", "attn", "heiße", "je m", "llamo")),
]
_DIGIT = re.compile(r"\d")
_LETTERS = re.compile(r"[^\W\d_]+")
_NAMED = {*_TITLE_GENDER, *_GIVEN_GENDER, *(n.upper() for n in _GIVEN_GENDER)}
_PART = re.compile(rf"{_SURNAME}|{_CAPITALS}")
_LONE = re.compile(rf"(?<![\w'’-])(?:{_SURNAME}|{_CAPITALS})(?![\w-]|['’][{_UP}])")


def _name_parts(value: str, start: int) -> list[tuple[int, int, str, str]]:
    """The given and family names of a full name, each an entity: kinds given-f, given-m and name."""
    out = []
    for m in _PART.finditer(value):
        gender = _GIVEN_GENDER.get(m[0].title())
        out.append((start + m.start(), start + m.end(), f"given-{gender}" if gender else "name", m[0]))
    return out


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """Non-overlapping (start, end, kind, value) of a whole text in order; a name gives an entity for each of its parts.

    A family name that a full name or a title has shown stands for the person
    in the rest of the text too, alone as well.
    """
    if not text:
        return []
    digits, low = bool(_DIGIT.search(text)), None
    names = not _NAMED.isdisjoint(_LETTERS.findall(text))
    found: list[tuple[int, int, str, str]] = []
    family: set[str] = set()
    rest = text  # what earlier kinds have taken is blotted out, so that a later one ends there
    for kind, pattern, needs in PATTERNS:
        if needs is None:
            if not (names if kind == "name" else digits):
                continue
        else:
            low = text.lower() if low is None else low
            if not any(n in low for n in needs):
                continue
        here = []
        for m in pattern.finditer(rest):
            value = m["v"]
            if kind == "iban" and not _iban_ok(value):
                continue
            if kind == "ipv6" and not _ipv6_ok(value):
                continue
            if kind == "phone" and not 7 <= sum(c.isdigit() for c in value) <= 15:
                continue
            if kind == "name":
                parts = _name_parts(value, m.start("v"))
                family.update(p[3].title() for p in parts if p[2] == "name")
                here += parts
            else:
                here.append((*m.span("v"), kind, value))
        for x, y, *_ in here:
            rest = f"{rest[:x]}{chr(0) * (y - x)}{rest[y:]}"
        found += here
    if family:
        found += [(*m.span(), "name", m[0]) for m in _LONE.finditer(rest) if m[0].title() in family]
    return sorted(found)


def _hash(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), "sha256"), "big")


def permute(number: int, size: int, key: bytes, *tweak: object) -> int:
    """A keyed permutation of range(size): a balanced Feistel network, walked until it falls inside."""
    side = 1
    while side * side < size:
        side *= 2
    while True:
        left, right = divmod(number, side)
        for i in range(6):
            left, right = right, left ^ (_hash(key, i, right, side, *tweak) % side)
        number = left * side + right
        if number < size:
            return number


def _luhn(digits: str) -> int:
    """The digit that makes ``digits`` followed by it valid."""
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _iban_ok(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _ipv6_ok(value: str) -> bool:
    """An address with all groups, or with some left out and a digit in it (unlike scopes in program text)."""
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return "::" not in value or any(c.isdigit() for c in value)


def _groups(value: str, key: bytes, *tweak: object) -> str:
    """A compressed IPv6 address with other digits, compressed too: its first digit, zero groups and all lengths stay, by a keyed permutation of this form."""
    choice = [value[0]]
    for before, c in zip(value, value[1:], strict=False):
        choice.append(c if c == ":" or (before, c) == (":", "0") else "123456789abcdef" if before == ":" else "0123456789abcdef")
    number, size = 0, 1
    for c, x in zip(value, choice, strict=True):
        number, size = number * len(x) + x.index(c), size * len(x)
    form = "".join(x if len(x) == 1 else "x" if x[0] == "0" else "y" for x in choice)
    number, out = permute(number, size, key, form, *tweak), []
    for x in reversed(choice):
        number, r = divmod(number, len(x))
        out.append(x[r])
    return "".join(reversed(out))


def _refill(value: str, digits: str) -> str:
    """``value`` with its digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in value)


def _classes(names: bool) -> dict[str, str]:
    """The letters that may replace a letter: those of its sound in names, all of its script elsewhere."""
    groups = _CLASSES if names else ["abcdefghijklmnopqrstuvwxyz", *_CLASSES[2:4], _CLASSES[4] + _CLASSES[5]]
    return {c: g for g in groups for c in g}


_SOUNDS, _SCRIPTS = _classes(True), _classes(False)
_HEX = re.compile(r"(?=.*[a-f])(?=.*\d)[0-9a-f]{16,}|(?=.*[A-F])(?=.*\d)[0-9A-F]{16,}")


def _letters(value: str, key: bytes, *tweak: object, names: bool = False) -> str:
    """Letters and digits replaced by others of their class and case by a keyed permutation of all values of this form; the rest stays."""
    classes = _SOUNDS if names else _SCRIPTS
    if _HEX.fullmatch(value):
        digits = "0123456789abcdef" if value == value.lower() else "0123456789ABCDEF"
        form, choice = ["hex"] * len(value), [digits] * len(value)
    else:
        choice = ["0123456789" if c in "0123456789" else classes.get(c) or (classes[c.lower()].upper() if c.lower() in classes and len(classes[c.lower()].upper()) == len(classes[c.lower()]) else c) for c in value]
        form = [x[0] if len(x) > 1 else x for x in choice]
    number, size = 0, 1
    for c, x in zip(value, choice, strict=True):
        number, size = number * len(x) + x.index(c), size * len(x)
    if size == 1:
        return value
    number, out = permute(number, size, key, "".join(form), *tweak), []
    for x in reversed(choice):
        number, r = divmod(number, len(x))
        out.append(x[r])
    return "".join(reversed(out))


def _country(value: str) -> str:
    """The country code of a canonical number that has one."""
    if not value.startswith("+"):
        return ""
    return value[1 : 2 if value[1] in "17" else 3 if value[1:3] in _COUNTRIES else 4]


def _draw(kind: str, value: str, key: bytes, attempt: int) -> str:
    """The surrogate of a canonical value, canonical too."""
    digits = "".join(c for c in value if c.isdigit())
    more = max(attempt - ROUNDS, 0)
    if kind == "card":
        body = permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, kind, len(digits), attempt)
        text = str(body).zfill(len(digits) - 1)
        # a valid number stays valid, an invalid one as far from valid as before
        return text + str((_luhn(text) + int(digits[-1]) - _luhn(digits[:-1])) % 10)
    if kind == "phone":
        fixed = _country(value)
        rest = digits[len(fixed) :]
        n = len(rest) + more
        return ("+" if value.startswith("+") else "") + fixed + (str(permute(int(rest), 10**n, key, kind, fixed, len(rest), attempt)).zfill(n) if rest else "")
    if kind == "ssn":
        return str(permute(int(digits), 10 ** (9 + more), key, kind, attempt)).zfill(9 + more)
    if kind == "ipv4":
        number = int.from_bytes(bytes(map(int, value.split("."))), "big")
        plain = 2**24 <= number < 224 * 2**24  # unicast addresses stay unicast
        low, high = (2**24, 224 * 2**24) if plain else (0, 2**32)
        out = low + permute(number - low, high - low, key, kind, plain, attempt)
        while not plain and 2**24 <= out < 224 * 2**24:
            out = permute(out, 2**32, key, kind, plain, attempt)
        return ".".join(map(str, out.to_bytes(4, "big")))
    if kind == "ipv6":
        # where the forms are full, any global unicast address, spelt out
        return _groups(value, key, kind, attempt) if not more else ipaddress.IPv6Address(2**125 + _hash(key, kind, value, attempt) % 2**125).exploded
    if kind == "iban":
        body = _letters(value[4:], key, kind, value[:2], attempt)
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind == "email":
        local, _, domain = value.rpartition("@")
        *labels, top = domain.split(".")
        return f"{_letters(local + 'x' * more, key, kind, domain, more, attempt)}@{'.'.join(_letters(x, key, 'domain') for x in labels)}.{top}"
    if kind.startswith("given"):
        script = "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in value) else "latin"
        names = GIVEN[script, kind[6:]]
        out = names[permute(names.index(value), len(names), key, kind, script, attempt)]
        return out + ("-" + _letters("ба" * more if script == "cyrillic" else "ba" * more, key, kind, value, attempt, names=True).capitalize() if more else "")
    if kind == "name":
        low = _letters(value.lower() + ("ба" if re.search("[а-яё]", value.lower()) else "ba") * more, key, kind, more, attempt, names=True)
        return "".join(c.upper() if i < len(value) and value[i].isupper() else c for i, c in enumerate(low))
    return _letters(value + "x" * more, key, kind, more, attempt)


def _canonical(kind: str, value: str) -> str:
    """What makes two mentions the same entity: letter case of mail addresses and names, and separators of numbers, don't count."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "ssn", "phone"):
        return ("+" if value.startswith("+") else "") + "".join(c for c in value if c in "0123456789")
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(value).compressed
    if kind == "name" or kind.startswith("given"):
        return value.title() if value.isupper() else value
    return value


def _written(kind: str, value: str, made: str) -> str:
    """The canonical surrogate ``made`` in the spelling of the mention ``value``."""
    if kind in ("card", "ssn", "phone"):
        new = made.lstrip("+")
        return _refill(value, new) + new[sum(c in "0123456789" for c in value) :]
    if kind == "iban":
        it = iter(made)
        return "".join(c if c == " " else next(it) for c in value)
    if kind == "email" and len(made) == len(value):
        return "".join(c.upper() if o.isupper() else c for c, o in zip(made, value, strict=True))
    if kind == "ipv6":
        return made.upper() if value.isupper() else made
    if kind in ("email", "name") or kind.startswith("given"):
        return made.upper() if value.isupper() else made
    return made


def surrogate(kind: str, value: str, key: bytes = KEY, attempt: int = 0) -> str:
    """The surrogate of an entity: same kind, same form and spelling, derived from the key; ``attempt`` counts draws after collisions.

    Attempts above ``ROUNDS`` lengthen mail boxes, names, secrets, phone and
    social security numbers, whose forms may have few values.  The parts of a
    full name (kinds name-f, name-m, name-) are replaced one by one.
    """
    if kind.startswith("name-"):
        out = value
        for x, y, part, word in reversed(_name_parts(value, 0)):
            out = out[:x] + surrogate(part, word, key, attempt) + out[y:]
        return out
    return _written(kind, value, _draw(kind, _canonical(kind, value), key, attempt))


def found_entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, value) of all texts, reduced inside each task before the shuffle."""

    def make():
        def work(cols):
            rows = sorted({(kind, _canonical(kind, value)) for t in cols["text"] for _, _, kind, value in entities(t)})
            return {"kind": [r[0] for r in rows], "value": [r[1] for r in rows]}

        return work

    return map_slices(docs.select(F.col("text").cast("string")), make, "kind string, value string").distinct()


def collisions(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """Rows (kind, value, attempt) of the entities that need a later draw, attempt 1 or more; the others take attempt 0.

    In each round the least entity of those that share a surrogate keeps it;
    the rest, and any whose surrogate occurs as an original, draw again, until
    there are none.
    """

    def draw(df: DataFrame) -> DataFrame:
        def make():
            def work(cols):
                made = [surrogate(k, v, key, a) for k, v, a in zip(cols["kind"], cols["value"], cols["attempt"], strict=True)]
                return cols | {"made": made}

            return work

        return map_slices(df.select("kind", "value", "attempt"), make, "kind string, value string, attempt int, made string")

    originals = found.select(F.col("value").alias("made")).distinct()
    drawn = cut(draw(found.withColumn("attempt", F.lit(0))))
    for _ in range(MOST_ROUNDS):
        first = drawn.groupBy("made").agg(F.min(F.struct("attempt", "kind", "value")).alias("first"), F.count("*").alias("n"))
        shared = drawn.join(first.where("n > 1"), "made").where(F.struct("attempt", "kind", "value") != F.col("first")).select("kind", "value", "attempt")
        real = drawn.join(originals, "made", "left_semi").select("kind", "value", "attempt")
        again = cut(shared.union(real).distinct())
        if again.isEmpty():
            return drawn.where("attempt > 0").select("kind", "value", "attempt")
        stay = drawn.join(again.select("kind", "value"), ["kind", "value"], "left_anti")
        drawn = cut(stay.union(draw(again.withColumn("attempt", F.col("attempt") + 1))))
    raise RuntimeError(f"no distinct surrogates for {again.count()} entities, such as one of kind {again.first()['kind']}")


def _replace(text: str | None, later: dict, key: bytes, kept: dict) -> tuple[str | None, int]:
    spans = entities(text)
    if not spans:
        return text, 0
    out, at = [], 0
    for a, b, kind, value in spans:
        entity = (kind, _canonical(kind, value))
        if entity not in kept:
            if len(kept) > 100_000:
                kept.clear()
            kept[entity] = _draw(*entity, key, later.get(entity, 0))
        made = _written(kind, value, kept[entity])
        out += [text[at:a], made]
        at = b
    return "".join([*out, text[at:]]), len(spans)


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced by its surrogate, and ``n_entities`` (int) appended.

    Null texts stay null with 0 entities, empty ones empty; repeated rows get
    equal texts; other columns pass through, save one named ``n_entities``,
    which is replaced.  Later draws after collisions are rare: a checked number
    of them goes to every task.  Should there ever be more, documents that hold
    one are rewritten with their own list from a join by row.
    """
    found = cut(found_entities(docs))
    later = cut(collisions(found, key))
    rest = docs.drop("n_entities")
    own_list = fresh("_later", rest)
    few = later.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sent = None
    if few:
        sent = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["value"]): r["attempt"] for r in later.toLocalIterator()})
    else:
        row = fresh("_row", rest)
        rest = cut(rest.withColumn(row, F.monotonically_increasing_id()))
        mentions = rest.select(F.col(row).alias("row"), F.explode(_mentions()(F.col("text").cast("string"))).alias("e")).select("row", "e.kind", "e.value").distinct()
        listed = mentions.join(later, ["kind", "value"]).groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(own_list))
        rest = rest.join(listed, row, "left").drop(row)
    out = StructType([f for f in docs.schema if f.name != "n_entities"]).add("n_entities", IntegerType())
    arrow = to_arrow_schema(out)

    def make():
        kept: dict = {}

        def work(batch):
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = columns["text"].to_pylist()
            if few:
                rows = [_replace(t, sent.value, key, kept) for t in texts]
            else:
                rows = [_replace(t, {(x["kind"], x["value"]): x["attempt"] for x in own or []}, key, {}) for t, own in zip(texts, columns[own_list].to_pylist(), strict=True)]
            columns |= {"text": pa.array([r[0] for r in rows], arrow.field("text").type), "n_entities": pa.array([r[1] for r in rows], pa.int32())}
            return pa.RecordBatch.from_arrays([columns[f.name] for f in arrow], schema=arrow)

        return work

    return map_whole_rows(rest, make, out)


@cache
def _mentions():
    @F.pandas_udf("array<struct<kind:string,value:string>>")
    def mentions(texts):
        return texts.map(lambda t: [{"kind": k, "value": _canonical(k, v)} for _, _, k, v in entities(t)])

    return mentions


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data: doc_id, text, n_entities."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
