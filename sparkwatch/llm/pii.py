"""Personal data: detection, and surrogates that keep type and format.

A surrogate is the entity under a keyed permutation of all entities of its format: the entity is read as a number in the
mixed radix of its characters (digits, letters of one script, octets, listed names), a Feistel network permutes those
numbers, and the result is written in the same format, separators and case. A permutation gives different entities
different surrogates and one entity the same one wherever and however it is written, and here it leaves none as it was.
Names fall into listed given names, permuted within their gender and script, and all others, whose consonants and vowels are
permuted apart so that they can be spoken; the walk leaves out listed names, so the two never meet. A join over all
entities of the corpus checks that none collide before anything is replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Given names by gender and script, and titles by gender. A surrogate name comes from its own list.
GIVEN = {
    ("male", "latin"): "James Robert John Michael David William Richard Thomas Daniel Matthew Anthony Mark Steven Paul Andrew Joshua Kevin Brian George Edward Pierre Louis Hans Klaus Jürgen Carlos Miguel José Luis Antonio".split(),
    ("female", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Sandra Emily Donna Michelle Laura Helen Amy Anna Marie Camille Sophie Ursula Sabine Heike Carmen Lucía María Isabel".split(),
    ("male", "cyrillic"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("female", "cyrillic"): "Александра Анна Валентина Галина Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
}
TITLES = {"male": "Mr Herr Monsieur Señor Don".split(), "female": "Mrs Ms Miss Frau Madame Señora Doña".split()}
#: Endings that tell a Russian surname's gender stay.
ENDINGS = re.compile(r"(?:[оеё]ва?|ина?|ск(?:ий|ая)|[нц]к(?:ий|ая))$")


def _lower_letters(first: int, end: int) -> str:
    """The lower-case letters of a range whose upper case is one letter and leads back."""
    return "".join(c for c in map(chr, range(first, end)) if c.islower() and len(c.upper()) == 1 and c.upper().lower() == c)


ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", _lower_letters(0xDF, 0x100) + "ß", *(_lower_letters(*r) for r in ((0x100, 0x250), (0x370, 0x3AD), (0x3AD, 0x3CA), (0x3CA, 0x400), (0x430, 0x450), (0x450, 0x530), (0x530, 0x590))))
_VOWELS = frozenset("aeiouàáâãäåæèéêëìíîïòóôõöøùúûüýÿœаеиоуыэюяёαεηιουωάέήίόύώ")
_SPOKEN = tuple(part for a in ALPHABETS for part in ("".join(c for c in a if c in _VOWELS), "".join(c for c in a if c not in _VOWELS)) if part)


def _classes(alphabets: tuple[str, ...]) -> dict[str, tuple[int, int]]:
    return {c: (k, i) for k, a in enumerate(alphabets) for i, c in enumerate(a)}


_CLASS, _SPOKEN_CLASS = _classes(ALPHABETS), _classes(_SPOKEN)
_GIVEN_OF = {n.lower(): (k, i) for k, names in GIVEN.items() for i, n in enumerate(names)}
_LISTED = tuple(n for names in GIVEN.values() for n in names)

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_LOCAL, _DOMAIN = r"[\w.%+-]", r"@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}"
#: Where an address ends another may begin at once; elsewhere one begins where a run of its characters does, so no run is read twice.
_NEXT_EMAIL = re.compile(rf"{_LOCAL}++{_DOMAIN}")
_NAME = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
_titles = "|".join(t for v in TITLES.values() for t in v)
#: Kinds in the order in which they claim text, with what a text must hold for a search to be worth it.
PATTERNS: list[tuple[str, re.Pattern, Callable[[str], bool]]] = [
    ("email", re.compile(rf"(?<!{_LOCAL}){_LOCAL}++{_DOMAIN}"), lambda t: "@" in t),
    ("secret", re.compile(r"(?i)(?:token|api[_-]?key|secret|passw(?:or)?d)\s*[=:]\s*[\"']?([A-Za-z0-9_\-/+]{8,})"), lambda t: "=" in t or ":" in t),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])"), lambda t: True),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"), lambda t: True),
    ("ip", re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"), lambda t: "." in t),
    ("card", re.compile(r"(?<![\d.+-])(?:\d{13,19}|\d{4}(?:([ -])\d{4})(?:\1\d{4}){2}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{5})(?!-?\d)"), lambda t: True),
    ("phone", re.compile(r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?!\d)"), lambda t: True),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), lambda t: "-" in t),
]
_DIGIT = re.compile(r"\d")
_GAP = r"(?:[^\S\r\n]+|[^\S\r\n]*\r?\n[^\S\r\n]*)"  # blanks, or one line end
_PERSON = re.compile(rf"\b(?:(?P<title>{_titles})\.?{_GAP})(?P<a>{_NAME})(?:{_GAP}(?P<b>{_NAME}))?|\b(?P<given>{'|'.join(_LISTED)}){_GAP}(?P<last>{_NAME})")
_MENTION = re.compile(rf"(?<![^\W_]){_NAME}(?![^\W_])")
_PART = re.compile(r"[^\W\d_]+")
_TAIL = re.compile(r"(?:['’]s|['’-]+)$")  # a genitive or a mark after a name, not part of it
#: Capitalized at the start of a line or sentence, but nobody's name: not taken over a line end, and not searched for again.
_FUNCTION_WORDS = frozenset(
    "The This That These Those And But Or He She It They We You His Her Its Their Our My In On At By For From To Of With As If When Then There Here Is Was Are Were Not No So "
    "Der Die Das Ein Eine Und Aber Er Sie Es Wir Ich Le La Les Un Une Et Il Elle Ils Elles Nous Vous El Los Las Una Y Pero Él Ella Ellos Он Она Они Мы Вы Это И Но В На".split()
)

_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace()]
_NAMED = tuple(f"{x}{c}" for x in (*(t + dot for v in TITLES.values() for t in v for dot in ("", ".")), *_LISTED) for c in _BLANKS)


@lru_cache
def _named() -> ahocorasick.Automaton:
    """Finds any title or listed name, which a text must hold for a search for people to be worth it."""
    automaton = ahocorasick.Automaton()
    for x in _NAMED:
        automaton.add_word(x, x)
    automaton.make_automaton()
    return automaton


class Cipher:
    """A keyed permutation of the numbers below n without fixed points (n > 1)."""

    def __init__(self, key: bytes) -> None:
        self._key = key

    def _round(self, label: bytes, i: int, x: int, m: int) -> int:
        size = (m.bit_length() + 71) // 8
        out = b""
        while len(out) < size:
            out += hmac.digest(self._key, b"%b|%d|%d|%d" % (label, i, x, len(out)), "sha256")
        return int.from_bytes(out[:size], "big") % m

    def _walk(self, label: bytes, n: int, x: int, rounds: range) -> int:
        a = isqrt(n - 1) + 1  # numbers below a*a as pairs; walk until back below n
        while True:
            hi, lo = divmod(x, a)
            for i in rounds:
                if rounds.step > 0:
                    hi, lo = lo, (hi + self._round(label, i, lo, a)) % a
                else:
                    hi, lo = (lo - self._round(label, i, hi, a)) % a, hi
            x = hi * a + lo
            if x < n:
                return x

    def permute(self, label: str, n: int, x: int) -> int:
        if n < 2:
            return x
        name = label.encode()
        there = self._walk(name, n, x, range(8))
        return self._walk(name, n, (there + 1) % n, range(7, -1, -1))  # a step on the cipher's own circle: nothing stays


#: Letters permuted at once; a longer entity is permuted in blocks, each under the blocks before it.
BLOCK = 64


def _chained(label: str, done: str) -> str:
    """A block's label: that of a first block is the label itself."""
    return f"{label}|{done}" if done else label


def _after(done: str, block: str) -> str:
    """What tells all the blocks so far from others."""
    return hashlib.sha256((done + block).encode()).hexdigest()


def _hex(cipher: Cipher, c: str) -> str:
    """Permutes hexadecimal digits in blocks."""
    out, done = [], ""
    for i in range(0, len(c), BLOCK):
        part = c[i : i + BLOCK]
        out.append(f"{cipher.permute(_chained(f'hex{len(c)}', done), 16 ** len(part), int(part, 16)):0{len(part)}x}")
        done = _after(done, out[-1])
    return "".join(out)


def _letters(cipher: Cipher, label: str, text: str, fixed: int = 0, names: bool = False, taken: Callable[[str], bool] = lambda t: False) -> str:
    """Permutes the letters and digits of a lower-case text, but the first `fixed` of them, each within its own alphabet.

    With `names` consonants stay consonants and vowels vowels. What is `taken` (the text itself must not be) is walked past,
    so that what remains is permuted within itself.
    """
    alphabets, of = (_SPOKEN, _SPOKEN_CLASS) if names else (ALPHABETS, _CLASS)
    at = [(i, *of[c]) for i, c in enumerate(text) if c in of][fixed:]
    shape = "".join(str(of[c][0]) if c in of else c for c in text)
    head = "".join(c for c in text if c in of)[:fixed]
    name = f"{label}|{shape}|{head}"
    if len(at) > BLOCK:
        name = hashlib.sha256(name.encode()).hexdigest()
    out = list(text)
    while True:
        done = ""
        for b in range(0, len(at), BLOCK):
            block = at[b : b + BLOCK]
            n, x = 1, 0
            for i, k, _v in block:
                n *= len(alphabets[k])
                x = x * len(alphabets[k]) + of[out[i]][1]
            x = cipher.permute(_chained(name, done), n, x)
            for i, k, _v in reversed(block):
                x, v = divmod(x, len(alphabets[k]))
                out[i] = alphabets[k][v]
            done = _after(done, "".join(out[i] for i, *_ in block))
        if not taken(new := "".join(out)):
            return new


def _like(pattern: str, letters: str) -> str:
    """The letters of a surrogate, one after the other, in place of the letters of the original and in their case."""
    out, k = [], 0
    for c in pattern:
        if c.lower() in _CLASS:
            new = letters[k]
            out.append(new.upper() if c.isupper() and len(new.upper()) == 1 else new)
            k += 1
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _iban_check(body: str, country: str) -> int:
    """The check digits, less two, that make an IBAN of this body valid."""
    return 96 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


def _lower(text: str) -> str:
    """Lower case, letter by letter (never longer than the text, and blind to where in a word a letter is)."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def canonical(kind: str, found: str) -> str:
    """What all spellings of an entity share."""
    if kind == "ip":
        return ".".join(str(int(x)) for x in found.split("."))
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", found)
    if kind == "phone":
        digits = re.sub(r"\D", "", found)
        return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    return _lower(found.replace(" ", "") if kind == "iban" else found)


def surrogate(cipher: Cipher, kind: str, found: str) -> str:
    """What stands for an entity, in the spelling in which it was found."""
    c = canonical(kind, found)
    if kind == "ip":
        x = cipher.permute("ip", 256**4, int.from_bytes(bytes(map(int, c.split("."))), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "card":  # the first digit stays, and the distance from a valid check digit too
        off = (int(c[-1]) - _luhn(c[:-1])) % 10
        body = _letters(cipher, f"card{off}", c[:-1], 1)
        return _like(found, body + str((_luhn(body) + off) % 10))
    if kind == "phone":
        body = _letters(cipher, "phone", c) if len(c) == 10 else _letters(cipher, "phone", c, min(2, len(c) - 7))
        extra = re.sub(r"\D", "", found)[: len(re.sub(r"\D", "", found)) - len(c)]
        return _like(found, extra + body)
    if kind == "email":
        local, _, domain = c.rpartition("@")
        host, _, tld = domain.rpartition(".")
        new = _letters(cipher, f"email.{tld}", f"{local}@{host}")
        return _like(found, "".join(x for x in f"{new}.{tld}" if x in _CLASS))
    if kind == "secret" and _is_hex(c):
        new = _hex(cipher, c)
        return new.upper() if found != c else new
    if kind == "iban":  # the country stays, and the distance from valid check digits too
        country, digits, body = c[:2], int(c[2:4]), c[4:]
        if not 2 <= digits <= 98:
            return _like(found, f"{country}{c[2:4]}{_letters(cipher, f'iban{country}{digits}', body)}")
        off = (digits - 2 - _iban_check(body, country)) % 97
        new = _letters(cipher, f"iban{country}off{off}", body)
        return _like(found, f"{country}{(_iban_check(new, country) + off) % 97 + 2:02d}{new}")
    taken = _is_hex if kind == "secret" else lambda t: False
    return _like(found, "".join(x for x in _letters(cipher, kind, c, taken=taken) if x in _CLASS))


def _is_hex(text: str) -> bool:
    return re.fullmatch(r"[0-9a-f]+", text) is not None


def _person(cipher: Cipher, name: str) -> str:
    """A listed given name's surrogate is listed for the same gender and script; any other name keeps its script, length, ending and case."""
    c = canonical("name", name)
    if c in _GIVEN_OF:
        group, i = _GIVEN_OF[c]
        new = GIVEN[group][cipher.permute("|".join(group), len(GIVEN[group]), i)]
        return new.upper() if name.isupper() else new.lower() if name.islower() else new
    ending = m[0] if (m := ENDINGS.search(c)) and m.start() >= 2 else ""
    stem = c[: len(c) - len(ending)]
    new = _letters(cipher, f"name|{ending}", stem, names=True, taken=lambda t: t + ending in _GIVEN_OF or not ending and (m := ENDINGS.search(t)) is not None and m.start() >= 2)
    return _like(name, "".join(x for x in new + ending if x in _CLASS))


def _is_name(text: str, m: re.Match, part: str) -> bool:
    """Whether the match of a part begins in upper case and, over a line end, isn't a function word."""
    s = m.start(part)
    over = s > 0 and (gap := re.search(r"\s*$", text[max(0, s - 64) : s])) is not None and "\n" in gap[0]
    return text[s].isupper() and not (over and m[part] in _FUNCTION_WORDS)


def _overlaps(spans: list[tuple[int, int, str]], s: int, e: int) -> bool:
    """Whether one of these sorted spans, which are apart, overlaps [s, e)."""
    i = bisect_left(spans, (e,))
    return i > 0 and spans[i - 1][1] > s


def _matches(kind: str, pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    if kind != "email":
        yield from pattern.finditer(text)
        return
    end = 0
    while m := (_NEXT_EMAIL.match(text, end) if end else None) or pattern.search(text, end):
        yield m
        end = m.end()


def _blanked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with these spans, which are in order and apart, as NULs."""
    if not spans:
        return text
    out, last = [], 0
    for s, e in spans:
        out += [text[last:s], "\0" * (e - s)]
        last = e
    return "".join([*out, text[last:]])


def entities(text: str) -> list[tuple[int, int, str]]:
    """Spans of a text that are personal data, in order and apart, with their kinds. Where two kinds overlap the first of PATTERNS has it.

    People are found by a title or listed given name before their name, on one line or over a line end; then all their
    names are found wherever the text repeats them as whole words in the same case or (from four letters on) in capitals.
    """
    found: list[tuple[int, int, str]] = []
    digits = _DIGIT.search(text) is not None
    free = text  # claimed spans are blanked for the kinds that follow
    for kind, pattern, worth in PATTERNS:
        if (digits or kind in ("email", "secret")) and worth(text):  # all other kinds hold a digit
            spans = []
            for m in _matches(kind, pattern, free):
                s, e = m.span(1) if kind == "secret" and m.lastindex else m.span()
                if kind != "phone" or sum(c.isdigit() for c in m[0]) >= 7:
                    spans.append((s, e))
            found += [(s, e, kind) for s, e in spans]
            free = _blanked(free, spans)
    names: set[str] = set()
    people: list[tuple[int, int, str]] = []
    apart = sorted(found)
    for m in _PERSON.finditer(text) if next(_named().iter(text), None) else ():
        for part in ("a", "b", "given", "last"):
            s, e = m.span(part)
            if s < 0 or not _is_name(text, m, "last" if part == "given" else part):
                continue
            e -= len(tail[0]) if (tail := _TAIL.search(m[part])) else 0
            if not _overlaps(apart, s, e):
                people.append((s, e, "name"))
                names |= {text[s:e], text[s:e].upper()} if e - s > 3 else {text[s:e]}
    names -= _FUNCTION_WORDS
    if names:  # again for all who were named, wherever they stand without title or given name, in the same case or in capitals
        apart = sorted(found + people)
        for m in _MENTION.finditer(text):
            for s, e in [m.span()] if m[0] in names else [(m.start() + p.start(), m.start() + p.end()) for p in _PART.finditer(m[0])]:
                if text[s:e] in names and not _overlaps(apart, s, e):
                    people.append((s, e, "name"))
    found += people
    return sorted(found)


def replace(cipher: Cipher, text: str) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate) of each, as all spellings share them."""
    out, last, seen = [], 0, []
    for s, e, kind in entities(text):
        old = text[s:e]
        new = _person(cipher, old) if kind == "name" else surrogate(cipher, kind, old)
        out += [text[last:s], new]
        last = e
        seen.append((kind, canonical(kind, old), canonical(kind, new)))
    return "".join([*out, text[last:]]), seen


def _cipher(key: str, turn: int = 0) -> Cipher:
    return Cipher(hashlib.sha256(f"{key}|{turn}".encode() if turn else key.encode()).digest())


def entity_table(docs: DataFrame, key: str, turn: int = 0) -> DataFrame:
    """doc_id, kind, entity and surrogate (keyed hashes, so the table holds no personal data) of each entity found."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = _cipher(key, turn)
        hashed = lambda x: hmac.digest(cipher._key, x.encode(), "sha256")[:16]
        for b in batches:
            rows = [(i, k, hashed(f"{k}|{e}"), hashed(f"{k}|{s}")) for i, t in enumerate(b.column(1)) for k, e, s in replace(cipher, t.as_py() or "")[1]]
            of, kind, old, new = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(kind, pa.string()), pa.array(old, pa.binary()), pa.array(new, pa.binary())], ["doc_id", "kind", "entity", "surrogate"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, kind string, entity binary, surrogate binary")


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that stand for two entities, or entities with two surrogates (none, unless the permutation were broken)."""
    pairs = found.select("kind", "entity", "surrogate").distinct()
    many = lambda by, of: pairs.groupBy("kind", by).agg(F.count(of).alias("n")).filter("n > 1").select("kind", F.col(by).alias("what"), "n")
    return many("surrogate", "entity").unionByName(many("entity", "surrogate"))


def pseudonymize(docs: DataFrame, key: str, check: bool = True) -> DataFrame:
    """docs with surrogates in `text`, and n_entities and kinds (sorted, distinct) beside it.

    A null text stays null and an empty one empty, with no entities; texts without personal data stay as they are. A very
    long text is one task's, in time that grows with its length; entities of more than 64 letters are permuted in blocks. Other
    columns are kept, except that ones named n_entities or kinds are replaced. With `check` the corpus is searched once
    before; should surrogates collide, the next key that follows from `key` is taken (the permutations let none collide,
    so a fourth collision in a row is an error in them and raises).
    """
    turn = 0
    while check and (bad := collisions(entity_table(docs, key, turn)).first()):
        turn += 1
        if turn > 3:
            raise ValueError(f"surrogates collide: {bad}")

    @F.pandas_udf("text string, n_entities int, kinds array<string>")
    def redact(texts):  # type: ignore[no-untyped-def]
        import pandas as pd

        cipher = _cipher(key, turn)
        rows = [(None, []) if t is None else replace(cipher, t) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in rows], "n_entities": [len(s) for _, s in rows], "kinds": [sorted({k for k, _, _ in s}) for _, s in rows]})

    order = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    redacted = docs.select(*order, redact("text").alias("__redacted"))
    return redacted.select(*[F.col("__redacted.text").alias("text") if c == "text" else F.col(c) for c in order], "__redacted.n_entities", "__redacted.kinds")
