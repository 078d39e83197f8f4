"""Personal data and secrets replaced by keyed surrogates of the same type and format.

Entities are found by their form: e-mail, IPv4 and IPv6 addresses (shortened ones too), phone, card (undelimited digits
only where their Luhn sum is right), social security and IBAN numbers, cloud access keys, values assigned to words such as
password or token. Names of persons are found by a listed given name before a capitalised word, a title before one, or a
phrase that introduces a person before two or three capitalised words; every other place where a part of a name found in
a text stands alone in the same text is that person too. Nothing else tells a name from other capitalised words, so a
name that no text introduces in one of these ways stays.

A surrogate is a keyed permutation of the strings of the same form (format-preserving Feistel rounds, walked on until
the kind holds too), so different entities of a form get different surrogates, and an entity gets the same one in every
document. Letters keep their case and script, vowels stay vowels; e-mails keep their top-level domain, phones their
country code, IBANs their country and whether they are valid, cards their Luhn validity, IPv4 addresses whether they are
private; given names keep gender and script; surnames are made of syllables of their script and keep an ending that tells
gender or origin. A person's given name and surname are replaced apart, so "Anna Berg" and "Ms Berg" stay one person.

Collisions are checked over the whole corpus: a surrogate that is itself an entity of any document, or that a second
entity got, is drawn again under another tweak until none is left (after ``TRIES`` draws, for forms with too few strings,
a keyed suffix makes it unique; should even that fail, the job does). A null text stays null; texts without entities are
passed on as they are. Rows repeat freely; other columns stay, whatever their names. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.llm.common import discard, map_batches, own_names, plain_names, written

KEY, TRIES = "vantage-surrogates", 16

#: Given names that are found, and those that replace them, by gender and script; titles by gender.
FOUND = {
    "f latin": "Alice Anna Barbara Carmen Charlotte Claire Elena Elisabeth Emma Hannah Helen Ingrid Isabel Jennifer Julia Karen Laura Linda Lucia Margaret Maria Marie Martha Mary Monika Nancy Olivia Patricia Petra Sabine Sandra Sarah Sofia Sophie Susan Teresa Ursula".split(),
    "m latin": "Albert Alexander Andreas Anthony Antonio Carlos Charles Daniel David Diego Edward François Fernando George Henri Heinrich James Javier Jean Johann John Joseph Jürgen Karl Klaus Louis Manuel Michael Miguel Paul Peter Philippe Pierre Richard Robert Stefan Thomas William Wolfgang".split(),
    "f cyrillic": "Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    "m cyrillic": "Александр Алексей Андрей Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
}
GIVEN = {
    "f latin": "Adele Agatha Beatrix Bianca Camilla Cecilia Clara Daphne Delia Edith Eleonora Estelle Flora Frieda Gisela Greta Harriet Hedwig Ida Josephine Judith Katarina Leonie Lydia Mathilda Minerva Nadine Noemi Ottilie Paulina Philippa Regina Rosalind Sidonie Tabea Valentina Wilhelmina".split(),
    "m latin": "Adrian Alfred Anselm Benedikt Bernard Bruno Casimir Clemens Conrad Cornelius Dominik Edgar Emil Ernest Fabian Florian Gilbert Gustav Hector Hubert Ignatius Jasper Julius Kaspar Lambert Leopold Lorenz Magnus Marius Maurice Norbert Oswald Quentin Raphael Rupert Sebastian Theodor Tobias Valentin".split(),
    "f cyrillic": "Алиса Вера Дарья Евгения Зоя Кира Лидия Марина Нина Полина".split(),
    "m cyrillic": "Антон Борис Виктор Глеб Денис Егор Игорь Кирилл Максим Роман".split(),
}
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra"), "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr"), "x": ("Dr", "Prof")}
#: Phrases after which two or three capitalised words are a person's name.
PHRASES = ("name is", "Name:", "name:", "named", "Dear", "contact", "Contact", "Attn:", "signed by", "Signed by", "written by", "Written by", "hi to", "hello to", "spoke to", "talked to", "regards,", "Regards,", "Sincerely,", "heiße", "Name ist", "m'appelle", "me llamo", "зовут", "Уважаемый", "Уважаемая")
#: Endings of surnames that tell gender or origin and stay, by script; the syllables that others are made of.
ENDINGS = {
    "latin": ("mann", "stein", "berg", "sson", "son", "sen", "ová", "ova", "eva", "ski", "ska", "sky", "ez", "ov", "ev", "ini", "elli", "etti", "eau", "er"),
    "cyrillic": ("ская", "цкая", "ский", "цкий", "ова", "ева", "ёва", "ина", "ына", "ов", "ев", "ёв", "ин", "ын", "енко", "чук"),
}
SYLLABLES = {
    "latin": ("b br d dr f fr g gr h k kl l m n p pr r s st t tr v w".split(), "a e i o u".split(), "l m n r s t nd rk".split()),
    "cyrillic": ("б бр в г гр д др ж з к кл л м н п пр р с ст т тр ф".split(), "а е и о у".split(), "л м н р с т й в".split()),
}
SECRETS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DIGITS = re.compile(r"[0-9]+")
_NUMBER = re.compile(
    r"""(?P<phone>\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]{3}([ .-])[0-9]{3}\2[0-9]{4}(?![0-9-]))
    |(?P<ipv4>(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9]))
    |(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
    |(?P<card>[0-9]{4}([ -])[0-9]{4}\6[0-9]{4}\6[0-9]{4}(?![0-9])|[0-9]{13,19}(?![0-9]))""".replace("\n    ", ""),
)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:(?=:)|(?<=:):){2,7}(?:[0-9A-Fa-f]{1,4}|(?<=::))(?![\w:])")
_CLOUD = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
_VALUE = re.compile(r"""["']?\s{0,3}[=:]\s{0,3}["']?([^\s"'`,;<>]{8,})""")
_CAPITAL = r"(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)?|[А-ЯЁ][а-яё]+)"
_PERSON = re.compile(rf"[:,]?[ \n]({_CAPITAL}) ({_CAPITAL})(?: ({_CAPITAL}))?(?!\w)")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_SURNAME = re.compile(r"\.? ([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)?|[А-ЯЁ][а-яё]+)(?!\w)")


@lru_cache(maxsize=1)
def _words():
    """An automaton of the literal strings that may begin an entity."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for sort, names in FOUND.items():
        for n in names:
            a.add_word(n, ("given", sort, n))
    for gender, titles in TITLES.items():
        for t in titles:
            a.add_word(t, ("title", gender, t))
    for w in PHRASES:
        a.add_word(w, ("phrase", "", w))
    for w in SECRETS:
        for form in {w, w.upper(), w.capitalize()}:
            a.add_word(form, ("secret", "", form))
    a.add_word("AKIA", ("cloud", "", "AKIA"))
    a.add_word("@", ("email", "", "@"))
    a.make_automaton()
    return a


Span = tuple[int, int, str, str]


def detect(text: str | None) -> list[Span]:
    """(start, end, type, value) of the entities of a text, in order and not overlapping; the longer of two that overlap."""
    if not text:
        return []
    found: list[Span] = []

    def add(m_start: int, m_end: int, kind: str) -> None:
        found.append((m_start, m_end, kind, text[m_start:m_end]))

    for last, (what, sort, word) in _words().iter(text):
        at = last + 1 - len(word)
        if what == "email":
            if m := _DOMAIN.match(text, at):
                left = max(0, at - 64)
                local = _LOCAL.search(text[left:at]).group().lstrip(".")
                if local:
                    add(at - len(local), m.end(), "email")
            continue
        if at and text[at - 1].isalnum() and what != "secret":
            continue
        if what == "cloud":
            if m := _CLOUD.match(text, at):
                add(at, m.end(), "cloud")
        elif what == "secret":
            if m := _VALUE.match(text, last + 1):
                add(m.start(1), m.end(1), "secret")
        elif what == "phrase":
            if m := _PERSON.match(text, last + 1):
                for k in range(1, 4):
                    if m.group(k) and m.group(k) not in _title_words() and not (k == 1 and m.group(1) in _given_names()):
                        add(m.start(k), m.end(k), "surname")
        elif m := _SURNAME.match(text, last + 1):
            if what == "given" and text[last + 1] == " ":
                add(at, last + 1, f"given {sort}")
                add(m.start(1), m.end(1), "surname")
            elif what == "title" and m.group(1) not in _given_names():
                add(m.start(1), m.end(1), "surname")
    persons = {v: k for _, _, k, v in found if k == "surname" or k.startswith("given ")}
    if persons:  # the same person, by one part of the name
        taken = {s for s, _, _, _ in found}
        for m in _WORD.finditer(text):
            if m.start() not in taken and (kind := persons.get(m.group())):
                add(m.start(), m.end(), kind)
    done = 0
    for d in _DIGITS.finditer(text):
        s, e = d.span()
        if s < done:
            continue
        if s > 1 and text[s - 2 : s].isalpha() and text[s - 2 : s].isupper() and e == s + 2 or e > s + 12 and s > 1:
            if (s < 3 or not text[s - 3].isalnum()) and (m := _IBAN.match(text, s - 2)):
                add(s - 2, m.end(), "iban")
                done = m.end()
                continue
        for at in (s - 2, s - 1, s):  # an opening bracket or plus may come before
            if at < 0 or at < s and not set(text[at:s]) <= {"+", "("} or at and (text[at - 1].isalnum() or text[at - 1] in "+_"):
                continue
            if at > 1 and text[at - 1] in ".-" and text[at - 2].isdigit():
                continue
            if m := _NUMBER.match(text, at):
                if m.group("card") and m.group("card").isdigit() and not luhn(m.group("card")):
                    done = m.end()  # any other long number
                    break
                add(at, m.end(), m.lastgroup if m.lastgroup in ("phone", "ipv4", "ssn", "card") else next(k for k in ("phone", "ipv4", "ssn", "card") if m.group(k)))
                done = m.end()
                break
    if "::" in text or text.count(":") >= 7:
        for m in _IPV6.finditer(text):
            if _is_ipv6(m.group()):
                add(m.start(), m.end(), "ipv6")
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[Span] = []
    for x in found:
        if out and x[0] < out[-1][1]:
            if x[1] - x[0] > out[-1][1] - out[-1][0]:
                out[-1] = x
        else:
            out.append(x)
    return out


def _is_ipv6(value: str) -> bool:
    """Three groups or more, as even shortened addresses of hosts have, and a digit."""
    if len([x for x in value.split(":") if x]) < 3 or not any(c.isdigit() for c in value):
        return False
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return True


@lru_cache(maxsize=1)
def _title_words() -> frozenset[str]:
    return frozenset(t for titles in TITLES.values() for t in titles)


@lru_cache(maxsize=1)
def _given_names() -> frozenset[str]:
    return frozenset(n for names in FOUND.values() for n in names)


# -- keyed permutations of the strings of a form

_CLASSES = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "äöüéèêàáíóúñç", "ÄÖÜÉÈÊÀÁÍÓÚÑÇ")
_CLASS_OF = {c: x for x in _CLASSES for c in x}


def _number(value: int, size: int, key: str, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1: Feistel rounds on two unequal halves, walked on while outside."""
    if size < 2:
        return value
    a = isqrt(size - 1) + 1
    b = -(-size // a)

    def mix(k: int, x: int, mod: int) -> int:
        h = hashlib.blake2b(f"{tweak}|{size}|{k}|{x}".encode("utf-8", "surrogatepass"), key=key.encode()[:64], digest_size=32 + mod.bit_length() // 8)
        return int.from_bytes(h.digest(), "big") % mod if mod.bit_length() < 220 else int.from_bytes(hashlib.shake_256(h.digest()).digest(mod.bit_length() // 8 + 16), "big") % mod

    while True:
        left, right = divmod(value, b)
        for k in range(4):
            left = (left + mix(2 * k, right, a)) % a
            right = (right + mix(2 * k + 1, left, b)) % b
        value = left * b + right
        if value < size:
            return value


def _string(value: str, key: str, tweak: str, alphabets: list[str] | None = None) -> str:
    """A keyed permutation of the strings with the same class of character at each place."""
    alphabets = alphabets or [_CLASS_OF.get(c, c) for c in value]
    out = []
    for at in range(0, len(value), 64):  # long strings by parts that are chained by the tweak
        part, sets = value[at : at + 64], alphabets[at : at + 64]
        n, size = 0, 1
        for c, x in zip(part, sets, strict=True):
            n, size = n * len(x) + x.index(c), size * len(x)
        n = _number(n, size, key, f"{tweak}|{at}|{'' if not at else value[:at]}|{','.join(sets)}")
        made = []
        for x in reversed(sets):
            n, k = divmod(n, len(x))
            made.append(x[k])
        out += reversed(made)
    return "".join(out)


def luhn(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def iban_valid(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _ip_class(n: int) -> str:
    for name, first, bits in (("ten", 10 << 24, 8), ("private", 172 << 24 | 16 << 16, 12), ("private16", 192 << 24 | 168 << 16, 16), ("loopback", 127 << 24, 8), ("link", 169 << 24 | 254 << 16, 16)):
        if n >> (32 - bits) == first >> (32 - bits):
            return name
    return "multicast" if n >> 28 >= 14 else "zero" if n >> 24 == 0 else "public"


def _surname(value: str, key: str, tweak: str, longer: int) -> str:
    """A surname of syllables, with the ending that the value's last part has; ``longer`` adds syllables."""
    made = []
    for k, part in enumerate(value.split("-")):
        script = "cyrillic" if "а" <= part[0].lower() <= "я" or part[0].lower() == "ё" else "latin"
        ending = next((e for e in ENDINGS[script] if part.endswith(e) and len(part) > len(e) + 1), "")
        stem = part[: len(part) - len(ending)]
        n = max(2, len(re.findall(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿаеёиоуыэюя]+", stem.lower()))) - bool(ending) + longer
        onsets, vowels, codas = SYLLABLES[script]
        x = int.from_bytes(hashlib.blake2b(f"{tweak}|{k}|{part}".encode("utf-8", "surrogatepass"), key=key.encode()[:64], digest_size=32).digest(), "big")
        letters = []
        for at in range(n):
            x, a = divmod(x, len(onsets))
            x, b = divmod(x, len(vowels))
            letters += [onsets[a], vowels[b]]
            if at == n - 1:
                x, c = divmod(x, len(codas))
                letters.append(codas[c])
        made.append("".join(letters).capitalize() + ending)
    return "-".join(made)


def surrogate(kind: str, value: str, attempt: int = 0, key: str = KEY) -> str:
    """The replacement of an entity; other attempts permute otherwise."""
    tweak = f"{kind}|{attempt}"
    if kind.startswith("given "):
        found, given = FOUND[kind[6:]], GIVEN[kind[6:]]
        return given[_number(found.index(value), len(given), key, kind)]
    if kind == "email":
        cut = value.rindex(".")
        return _string(value[:cut], key, tweak) + value[cut:]
    if kind == "ipv4":
        n = 0
        for x in value.split("."):
            n = n << 8 | int(x)
        own = _ip_class(n)
        m = _number(n, 1 << 32, key, tweak)
        while _ip_class(m) != own:
            m = _number(m, 1 << 32, key, tweak)
        return ".".join(str(m >> s & 255) for s in (24, 16, 8, 0))
    if kind == "surname":
        return _surname(value, key, tweak, attempt // 3)
    if kind == "ipv6":
        mixed = value not in (value.lower(), value.upper())
        letters = lambda x: ("0123456789" if x.isdigit() else "ABCDEF" if x.isupper() else "abcdef") if mixed else "0123456789ABCDEF" if value.isupper() else "0123456789abcdef"
        made = _string(value, key, tweak, [x if x == ":" else letters(x) for x in value])
        while not _is_ipv6(made):  # all letters by chance
            made = _string(made, key, tweak, [x if x == ":" else letters(x) for x in value])
        return made
    if kind == "card":
        valid, made = luhn(value), _string(value, key, tweak)
        while luhn(made) != valid:
            made = _string(made, key, tweak)
        return made
    if kind == "iban":
        valid, made = iban_valid(value), value[4:]
        if valid:
            made = _string(made, key, tweak)
            rest = int("".join(str(int(c, 36)) for c in made + value[:2] + "00")) % 97
            return f"{value[:2]}{98 - rest:02d}{made}"
        made = value[:2] + _string(value[2:], key, tweak)
        while iban_valid(made):
            made = value[:2] + _string(made[2:], key, tweak)
        return made
    if kind == "phone" and value[0] == "+":
        cut = re.match(r"\+[0-9]{1,3}", value).end()
        return value[:cut] + _string(value[cut:], key, tweak)
    if kind == "cloud":
        return value[:4] + _string(value[4:], key, tweak)
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+", value):
        return _string(value, key, tweak, ["0123456789abcdef"] * len(value))
    if kind == "secret" and re.fullmatch(r"[0-9A-F]+", value):
        return _string(value, key, tweak, ["0123456789ABCDEF"] * len(value))
    return _string(value, key, tweak)


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(type, value, surrogate) of distinct (type, value), without collisions. Nothing but a row count reaches the driver."""
    entities = written(entities.select("type", "value").distinct(), "entities")
    values = entities.select(F.col("value").alias("surrogate")).distinct()
    pending, settled, attempt, used = entities, None, 0, [entities]

    def draw(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [surrogate(k, v, n, key) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                if n >= TRIES:
                    made = [f"{s}-{hashlib.blake2b(f'{k}|{v}'.encode(), key=key.encode()[:64], digest_size=8).hexdigest()}" for s, k, v in zip(made, b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string())], ["type", "value", "surrogate"])

        return run

    while True:
        drawn = written(pending.mapInArrow(draw(attempt), "type string, value string, surrogate string"), "drawn")
        taken = values if settled is None else values.unionByName(settled.select("surrogate"))
        # given names have lists of their own, which no entity is on; a person's parts may be words that also occur
        loose = F.col("type").startswith("given ")
        first = drawn.groupBy("surrogate").agg(F.min(F.struct("type", "value")).alias("first"))
        marked = drawn.join(first, "surrogate").join(taken.select(F.col("surrogate").alias("taken")).distinct(), F.col("surrogate") == F.col("taken"), "left")
        good = loose | (F.col("taken").isNull() & (F.col("first") == F.struct("type", "value")))
        marked = written(marked.select("type", "value", "surrogate", good.alias("good")), "marked")
        discard(drawn)
        used.append(marked)
        own = marked.where("good").select("type", "value", "surrogate")
        settled = own if settled is None else settled.unionByName(own)
        pending, attempt = marked.where("not good").select("type", "value"), attempt + 1
        if pending.isEmpty():
            out = written(settled, "surrogates")
            discard(*used)
            return out
        if attempt > TRIES + 1:
            raise RuntimeError("surrogates still collide after the last draw")


_SPANS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]))
_SPANS_ARROW = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("type", pa.string()), ("value", pa.string())]))
_ADDED = ("n_entities", "entity_types")


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """All rows and columns of ``docs`` with entities of ``text`` replaced, n_entities and entity_types (sorted, joined by commas).

    Texts with entities are written once to the shared folder with what was found; the others are only read again.
    """
    docs = docs.drop(*_ADDED)
    own = plain_names(docs)
    names = own.columns
    at = docs.columns.index("text")
    with_spans = T.StructType([*own.schema.fields, T.StructField("spans", _SPANS)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [detect(x) for x in b.column(at).to_pylist()]
            has = [bool(x) for x in spans]
            kept = b.filter(pa.array(has, pa.bool_()))
            some = [[{"s": s, "e": e, "type": k, "value": v} for s, e, k, v in x] for x in spans if x]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(some, _SPANS_ARROW)], [*b.schema.names, "spans"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not detect(x) for x in b.column(at).to_pylist()], pa.bool_()))

    dirty = written(map_batches(own, find, with_spans).withColumn("row", F.monotonically_increasing_id()), "pii")
    spans = dirty.select("row", F.explode("spans").alias("x")).select("row", "x.*")
    table = surrogates(spans.select("type", "value"), key)
    # an entity that most documents hold is one row of the table: adaptive execution splits its rows, or broadcasts the table
    placed = spans.join(table, ["type", "value"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "e", "surrogate"))).alias("new"), F.count("*").alias("n_entities"), F.array_join(F.array_sort(F.collect_set(F.split("type", " ")[0])), ",").alias("entity_types"))
    joined = dirty.drop("spans").join(placed, "row").select(*names, "n_entities", "entity_types", "new")
    out_schema = T.StructType([*own.schema.fields, T.StructField("n_entities", T.LongType()), T.StructField("entity_types", T.StringType())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, new in zip(b.column(at).to_pylist(), b.column(len(names) + 2).to_pylist(), strict=True):
                parts, end = [], 0
                for x in new:
                    parts += [text[end : x["s"]], x["surrogate"]]
                    end = x["e"]
                texts.append("".join(parts) + text[end:])
            cols = list(b.columns[: len(names) + 2])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, [*names, *_ADDED])

    none = map_batches(own, clean, own.schema).withColumn("n_entities", F.lit(0).cast("long")).withColumn("entity_types", F.lit(""))
    return none.unionByName(map_batches(joined, put, out_schema)).select(*own_names(docs), *_ADDED)
