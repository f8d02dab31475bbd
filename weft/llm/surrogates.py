"""Finding personal data in a text, and keyed replacements of the same type and format.

Found are addresses, numbers and secrets by their format, and names by what is near them: after a title, or a listed given
name before a capitalised word, in Latin or Cyrillic script.  Once a name is known in a text, all its other mentions there
are found, by given name or surname alone, with a possessive ending or in capitals.  Not found are names that never follow
a title or a listed given name in their text, postal addresses and dates.  The time grows in proportion to the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

# Titles and common given names by gender and script, public knowledge.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Signor", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Signora", "Госпожа"],
    "n": ["Dr", "Prof", "Professor", "Доктор"],
}
GIVEN = {
    ("m", "latin"): (
        "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Paul Andrew Joshua Kenneth Kevin Brian "
        "George Timothy Ronald Edward Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Patrick "
        "Alexander Jack Dennis Jerry Peter Henry Martin Simon Lucas Hugo Felix Oscar Carlos Luis Jean Pierre Hans Karl"
    ).split(),
    ("f", "latin"): (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Sandra Margaret Ashley Kimberly Emily Donna Michelle Carol "
        "Amanda Melissa Deborah Stephanie Rebecca Sharon Laura Cynthia Kathleen Amy Angela Shirley Anna Brenda Pamela Emma Nicole Helen Samantha Katherine "
        "Christine Julia Rachel Carolyn Janet Maria Catherine Sophie Clara Alice Marta Nora Ana Marie Claire Ingrid Greta"
    ).split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Дмитрий Алексей Николай Павел Михаил Андрей Борис Владимир Александр Юрий Виктор Олег".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Вера Юлия Екатерина Людмила Галина Нина Оксана".split(),
}
# end of fixed values

SYLLABLES = {
    "latin": ("Bar Cal Dor Fen Gar Hal Kel Lor Mar Nor Pel Ros Sel Tor Var Wel".split(), "den ber lin mon ver ran sol tam".split(), "son ley man ton er ford well by".split()),
    "cyrillic": ("Бар Вол Гор Дем Кар Лав Мор Нов Пол Род Сол Тар".split(), "ан ен ов ир ол ум".split(), "ов ин ев ский".split()),
}

_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")
_CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w|[.-]\d)")
#: The layouts of cards as printed, which a neighbouring number can't lengthen.
_CARD_AS_PRINTED = re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5})(?!\w|[.-]\d)")
_PHONE = re.compile(r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])(?<!\d )(?:1[ .-])?\d{3}([ .-])\d{3}\1\d{4}(?![\w-]|[ .]\d)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_KEY = re.compile(r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)")
_SECRET = re.compile(r"""(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b(?: ?[=:] ?)(["']?)([^\s"']{6,})\1""")
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_NAME = re.compile(rf"\b({_TITLE})\.? ((?:[^\W\d_a-z][\w'’-]+ ){{0,2}}[^\W\d_a-z][\w'’-]+)")
#: A capitalised word before another one, perhaps with an initial between them.
_PAIR = re.compile(r"(?<!\w)([A-ZА-ЯЁ][a-zа-яё]+)(?= (?:[A-ZА-ЯЁ]\. )?([A-ZА-ЯЁ][\w'’-]+))")
_WORD = re.compile(r"[^\W\d_](?:[\w'’-]*[^\W_])?")
_POSSESSIVE = re.compile(r"['’]s?$")
_HINT = re.compile(r"[0-9@=:]")
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_KNOWN = {n: g for (g, _), ns in GIVEN.items() for n in ns}


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[::-1]]
    return sum(odd[::2] + [d * 2 - 9 * (d > 4) for d in odd[1::2]]) % 10 == 0


def _iban_rest(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def script(word: str) -> str:
    kind = unicodedata.name(word[0], "LATIN").split()[0].lower()
    return kind if kind in SYLLABLES else "latin" if kind == "latin" else f"other {kind}"


def _given(word: str, gender: str) -> str:
    return f"given {_KNOWN.get(word.capitalize(), gender)} {script(word)}"


def _bare(word: str) -> str:
    return _POSSESSIVE.sub("", word)


def _titled(m: re.Match) -> Iterator[tuple[int, int, str, str]]:
    at = m.start(2)
    words = m[2].split(" ")
    for k, w in enumerate(words):
        w, step = _bare(w), len(w) + 1
        last = k == len(words) - 1 and (len(words) > 1 or w.capitalize() not in _KNOWN)
        yield at, at + len(w), f"surname {script(w)}" if last else _given(w, _GENDER[m[1]]), w.capitalize()
        at += step


def _paired(m: re.Match) -> Iterator[tuple[int, int, str, str]]:
    if m[1] in _KNOWN:
        yield *m.span(1), _given(m[1], "n"), m[1]
        w = _bare(m[2])
        yield m.start(2), m.start(2) + len(w), f"surname {script(w)}", w.capitalize()


def _mentions(text: str, known: dict[str, str]) -> Iterator[tuple[int, int, str, str]]:
    """Words that are known names: whole words, or their parts between hyphens and apostrophes."""
    for m in _WORD.finditer(text):
        w = _bare(m[0])
        if w.capitalize() in known:
            parts = [(m.start(), w)]
        elif "-" in w or "'" in w or "’" in w:
            parts = [(m.start() + p.start(), p[0]) for p in re.finditer(r"[^'’-]+", w)]
        else:
            continue
        for at, w in parts:
            kind = known.get(w.capitalize())
            if kind is not None and not w[0].islower():
                yield at, at + len(w), kind, w.capitalize()


def _accepted(pattern: re.Pattern, text: str, ok: Callable[[int, int], bool], cuts: str) -> Iterator[tuple[int, int]]:
    """The spans of a pattern that ``ok`` accepts.  One that it refuses is tried again up to each earlier character of
    ``cuts``, the longest first, and then from later starts."""
    at = 0
    while m := pattern.search(text, at):
        a, z = m.span()
        ends = [z, *(e for e in range(z - 1, a, -1) if text[e] in cuts and pattern.fullmatch(text, a, e))]
        end = next((e for e in ends if ok(a, e)), None)
        if end:
            yield a, end
        at = end or a + 1


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical value) of each entity, in order, without overlaps; earlier patterns win."""
    if not text:
        return []
    out: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))

    def free(a: int, z: int) -> bool:
        return taken.find(1, a, z) < 0

    def take(found: Iterable[tuple[int, int, str, str]]) -> None:
        for x in found:
            if free(*x[:2]):
                out.append(x)
                taken[x[0] : x[1]] = b"\1" * (x[1] - x[0])

    def digits(a: int, z: int) -> str:
        return re.sub(r"\D", "", text[a:z])

    def is_iban(a: int, z: int) -> bool:
        return free(a, z) and _iban_rest(text[a:z].replace(" ", "")) == 1

    def is_card(a: int, z: int) -> bool:
        return free(a, z) and luhn(digits(a, z))

    def is_phone(a: int, z: int) -> bool:
        return free(a, z) and len(digits(a, z)) <= 15  # no number is longer

    if _HINT.search(text):
        if "@" in text:
            take((*m.span(), "email", m[0].lower()) for m in _EMAIL.finditer(text))
        if "=" in text or ":" in text:
            take((*m.span(2), "secret", m[2]) for m in _SECRET.finditer(text))
        take((*m.span(), "key", m[0]) for m in _KEY.finditer(text))
        take((a, z, "iban", text[a:z].replace(" ", "")) for a, z in _accepted(_IBAN, text, is_iban, " "))
        take((*m.span(), "ip", m[0]) for m in _IP.finditer(text))
        take((a, z, "card", digits(a, z)) for a, z in _accepted(_CARD_AS_PRINTED, text, is_card, " "))
        take((*m.span(), "card", digits(*m.span())) for m in _CARD.finditer(text) if is_card(*m.span()))
        take((*m.span(), "ssn", digits(*m.span())) for m in _SSN.finditer(text))
        take((a, z, "phone", re.sub(r"[^\d+]", "", text[a:z])) for a, z in _accepted(_PHONE, text, is_phone, " .-"))
    others = len(out)
    if any(t in text for t in _GENDER):
        take(x for m in _NAME.finditer(text) for x in _titled(m))
    take(x for m in _PAIR.finditer(text) for x in _paired(m))
    if len(out) > others:
        known: dict[str, str] = {}
        for _, _, kind, value in out[others:]:
            known.setdefault(value, kind)
        take(_mentions(text, known))
    return sorted(out)


class Stream:
    """Endless keyed numbers for one entity."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int) -> None:
        self.seed, self.key = f"{kind}\0{value}\0{attempt}".encode("utf-8", "surrogatepass"), key
        self.buffer, self.block = 0, 0
        self._fill()

    def _fill(self) -> None:
        digest = hashlib.blake2b(self.seed + self.block.to_bytes(4, "big"), key=self.key, digest_size=64).digest()
        self.buffer, self.left, self.block = int.from_bytes(digest, "big"), 1 << 512, self.block + 1

    def below(self, n: int) -> int:
        if self.left < n << 64:
            self._fill()
        self.buffer, out = divmod(self.buffer, n)
        self.left //= n
        return out

    def like(self, value: str) -> str:
        """A digit for a digit, a letter for a letter of its case and alphabet, all else as it is."""
        hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) and len(value) > 8

        def one(c: str) -> str:
            if c.isdecimal():
                return ("0123456789abcdef"[self.below(16)] if c.isascii() and value.islower() else "0123456789ABCDEF"[self.below(16)]) if hexadecimal and not value.isdecimal() else chr(ord(c) - int(c) + self.below(10))
            if "a" <= c <= "z":
                return "0123456789abcdef"[self.below(16)] if hexadecimal else chr(97 + self.below(26))
            if "A" <= c <= "Z":
                return "0123456789ABCDEF"[self.below(16)] if hexadecimal else chr(65 + self.below(26))
            if c.isalpha():
                near = [d for d in map(chr, range(ord(c) & ~31, (ord(c) & ~31) + 32)) if unicodedata.category(d) == unicodedata.category(c)]
                return near[self.below(len(near))]
            return c

        return "".join(map(one, value))


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The canonical replacement of a canonical value; another one for each attempt."""
    s = Stream(key, kind, value, attempt)
    if kind == "email":
        local, _, host = value.rpartition("@")
        names = host.split(".")
        # the host alone decides its replacement, so addresses of one host stay together; .example is never a real one
        h = Stream(key, "host", host, 0)
        return f"{s.like(local)}@{'.'.join(h.like(n) for n in names[:-1])}.example"
    if kind == "ip":
        return f"{240 + s.below(15)}.{s.below(256)}.{s.below(256)}.{s.below(256)}"  # reserved, never routed
    if kind == "card":
        body = value[0] + "".join(str(s.below(10)) for _ in value[1:-1])
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "ssn":
        return f"9{s.below(10**8):08d}"  # never issued
    if kind == "phone":
        plus, digits = value[:1] == "+", value.lstrip("+")
        if len(digits) == 11 and digits[0] == "1" and plus or len(digits) == 10 and not plus:
            return f"{value[: len(value) - 10]}{2 + s.below(8)}{s.below(100):02d}555{s.below(10**4):04d}"  # a fictional exchange
        head = value[: 3 if plus else 1]
        return head + "".join(str(s.below(10)) for _ in value[len(head) :])
    if kind == "key":
        return value[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[s.below(32)] for _ in value[4:])
    if kind == "iban":
        body = s.like(value[4:])
        return f"{value[:2]}{98 - _iban_rest(value[:2] + '00' + body):02d}{body}"
    if kind.startswith(("given", "surname")):
        *what, alphabet = kind.split(" ", 2) if kind.startswith("given") else kind.split(" ", 1)
        if alphabet in SYLLABLES and what[0] == "given":
            names = GIVEN[what[1], alphabet] if what[1] != "n" else GIVEN["f", alphabet] + GIVEN["m", alphabet]
            picked = [names[s.below(len(names))] for _ in range(1 + attempt)]
            return "-".join(picked)
        if alphabet in SYLLABLES:
            first, middle, end = SYLLABLES[alphabet]
            return first[s.below(len(first))] + "".join(middle[s.below(len(middle))] for _ in range(1 + attempt)) + end[s.below(len(end))]
    return s.like(value)


def render(original: str, kind: str, value: str) -> str:
    """The canonical replacement in the format of what it replaces: its separators, and its case for names."""
    if kind in ("card", "ssn", "phone"):
        digits = iter(value.lstrip("+"))
        return "".join(next(digits) if c.isdecimal() else c for c in original)
    if kind == "iban":
        chars = iter(value)
        return "".join(c if c == " " else next(chars) for c in original)
    if kind.startswith(("given", "surname")):
        return value.upper() if original.isupper() else value
    if kind == "email" and original.isupper():
        return value.upper()
    return value
