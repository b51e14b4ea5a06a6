"""Surrogates for personal data and secrets.

Entities are found in whole texts: e-mail addresses, IPv4 and IPv6 addresses, international and national phone numbers,
social security numbers, IBANs, payment cards and other long numbers, secrets (assigned ones, tokens with a known prefix, signed
web tokens, private key blocks), and person names: after a form of address, after words that announce a name, or starting with a
known given name. Names found so are also found where the same text repeats them, whole or by their last word. Each entity
gets a replacement of its own type that a keyed permutation of all values of the same format yields:

* distinctness: a permutation gives different entities different surrogates, and none is left as it was (a keyed shift
  between the permutation and its inverse has no fixed point); where validity must be kept (card check digits, private
  addresses, the kind of an IPv6 address, prefixes of tokens, names that no list holds) the permutation is applied again until the check holds, which stays one-to-one;
* coreference: a surrogate depends on key, type and canonical value only, so it is the same in all documents and
  however a number is punctuated, an address cased or the zeros of an IPv6 address shortened;
* gender, script, format: known given names are permuted within their list of one gender and script; other names keep
  vowels, consonants, script, case and the last letter; digits stay digits and punctuation stays. Letters of other
  scripts move within those of their script, kind and 256 code points; secrets of punctuation alone get other punctuation.

Where no other value of a cycle of the permutation passes such a check, a value stays as it is (no case is known).

`collisions` checks the outcome over a whole corpus; op5 reports their number, which must be 0, in each row. A null text stays null with no entities; empty texts stay empty;
rows are independent, so repeated rows and shared ids are fine; extra columns pass through.
"""
from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
import sys
import unicodedata
from bisect import bisect
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.llm._common import free_name, give_back, slices, small_batches, table

GIVEN = {
    ("latin", "f"): "Anna Maria Emma Laura Julia Sofia Clara Elena Lucia Alice Sarah Hannah Marie Camille Ingrid Greta Carmen Isabel Claire Emily Olivia Amelia Charlotte Jessica Jennifer Elizabeth Susan Karen Margaret Nancy Katharina Sabine Petra Ursula Brigitte Monika Nathalie Sylvie Chantal Monique Pilar Dolores Teresa Rosa Ana Fatima Aisha Priya Yuki Mei".split(),
    ("latin", "m"): "John Peter Paul Thomas Michael David Daniel Martin Lukas Felix Hans Karl Jean Pierre Louis Carlos Diego Javier James Robert William Richard Joseph Charles Christopher Matthew Andrew Kevin Brian George Jürgen Klaus Wolfgang Stefan Andreas Uwe François Jacques Philippe Michel José Luis Miguel Pablo Juan Ahmed Mohammed Raj Hiroshi Wei".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ιωάννα".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος".split(),
}
_KNOWN = {name.casefold(): (group, i) for group, names in GIVEN.items() for i, name in enumerate(names)}
#: Letters that stand in for each other: vowels and consonants of each script, digits, hexadecimal digits.
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "аеёиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "0123456789"]
_CLASS = {c: k for k in CLASSES for c in k}
_MARKS = {c: "_+/=.-" for c in "_+/=.-"}
_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}
_DIGIT = {c: "0123456789" for c in "0123456789"}

_NAME = r"[^\W\d_a-zа-яёα-ωά-ώ][^\W\d_]+(?:-[^\W\d_]+)?"
_TITLES = "Mr Mrs Ms Miss Mx Dr Prof Herr Frau Monsieur Madame Mme Mlle Señora Señor Sra Sr Doña Don Г-н Г-жа Κύριος Κυρία".split()


def _one_of(words: list[str]) -> str:
    """A pattern of one of the words after no word character; it starts by a set of letters, for which a text is searched fast."""
    rest = defaultdict(list)
    for w in words:
        rest[w[0]].append(w[1:])
    return rf"[{''.join(rest)}](?<!\w.)(?:{'|'.join(f'(?<={c})(?:{"|".join(r)})' for c, r in rest.items())})"


#: Words that announce a name, in the languages of the corpus; a comma may follow them.
_CUES = [
    "my name is", "her name is", "his name is", "the name is", "signed by", "written by", "yours sincerely", "sincerely yours", "kind regards", "best regards", "mein name ist", "ich heiße", "er heißt", "sie heißt",
    "mit freundlichen grüßen", "je m'appelle", "mon nom est", "il s'appelle", "elle s'appelle", "cordialement", "me llamo", "mi nombre es", "se llama", "atentamente", "меня зовут", "με λένε",
]
#: Beginnings of tokens that name their issuer; a surrogate keeps them.
_PREFIX = re.compile(r"(?i)akia|asia|gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|sk-|[sr]k_(?:live|test)_|npm_|hf_|aiza|eyj")
_TOKEN = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}|AIza[\w-]{35}"
_SIGNED = r"eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}"
_ISSUERS = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk-", "k_live_", "k_test_", "npm_", "hf_", "AIza", "eyJ"]
#: A type, a test of (text, its lower case, whether it has a digit) without which nothing can be found, and a pattern.
_PATTERNS: list[tuple[str, Callable[[str, str, bool], bool], re.Pattern]] = [
    ("name", lambda t, low, d: any(c in low for c in _CUES), re.compile(rf"(?<!\w)(?:(?i:{'|'.join(_CUES)})),?\s{{1,3}}({_NAME}(?:[ ]{_NAME}){{0,2}})(?!\w)")),
    ("name", lambda t, low, d: any(c in low for c in ("name:", "nombre:", "nom:")), re.compile(rf"(?:(?<!\w)(?:[Ff]ull|[Ff]irst|[Ll]ast) [Nn]ame|^[ \t]*(?:Name|Nombre|Nom)):\s{{1,3}}({_NAME}(?:[ ]{_NAME}){{0,2}})(?!\w)", re.M)),
    ("name", lambda t, low, d: True, re.compile(rf"{_one_of(_TITLES)}\.?[ ]({_NAME}(?:[ ]{_NAME}){{0,2}})")),
    ("name", lambda t, low, d: True, re.compile(rf"({_one_of([n for names in GIVEN.values() for n in names])}[ ]{_NAME})(?!\w)")),
    ("secret", lambda t, low, d: "=" in t or ":" in t, re.compile(r"""(?i)(?<![a-z])(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer|key)["']?[ ]?[:=][ ]?["']?([A-Za-z0-9_+/=.-]{8,})""")),
    ("secret", lambda t, low, d: d and any(c in t for c in _ISSUERS), re.compile(rf"(?<![A-Za-z0-9])({_TOKEN}|{_SIGNED})(?![A-Za-z0-9])")),
    ("secret", lambda t, low, d: "PRIVATE KEY-----" in t, re.compile(r"-----BEGIN (?:[A-Z]{2,10} )?PRIVATE KEY-----\s([A-Za-z0-9+/=\s]{40,8000})\s-----END")),
    ("secret", lambda t, low, d: d, re.compile(r"(?<![A-Za-z0-9])((?=\d*[a-f])[0-9a-f]{32,128}|(?=\d*[A-F])[0-9A-F]{32,128})(?![A-Za-z0-9])")),
    ("iban", lambda t, low, d: d, re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
    ("ip", lambda t, low, d: d, re.compile(r"(?<![\w.])((?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d))(?!\w|\.\d)")),
    ("ip6", lambda t, low, d: d and t.count(":") > 1, re.compile(r"(?<![\w:.])((?=[0-9A-Fa-f:]*::|(?:[0-9A-Fa-f]{1,4}:){7})[0-9A-Fa-f:]{4,39})(?![\w:])")),
    ("ssn", lambda t, low, d: d, re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])")),
    ("phone", lambda t, low, d: d, re.compile(r"(?<![\w+])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)")),
    ("phone", lambda t, low, d: d, re.compile(r"(0(?<![\w+.,/-]0)(?=[1-9])(?=(?:[ /-]?\d){8,11}(?![ /-]?\d))(?!\d[ /-]\d\d[ /-]\d{4}(?!\d))\d{1,4}(?:[ /-]\d{2,8}){1,4})(?!\w|[.,:/-]\d)")),
    ("number", lambda t, low, d: d, re.compile(r"(?<![\w.-])(\d(?:[ -]?\d){11,18})(?![\w-]|\.\d)")),
]


@cache
def _all_classes() -> dict[str, str]:
    """_CLASS and a class of at least two for every other letter and digit of Unicode; each character is in one only."""
    rest = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and c not in _CLASS and c != "ς" and (c.lower() == c or len(c.lower()) > 1)]
    casing = lambda c: 0 if c.upper() == c else 1 if len(c.upper()) == 1 and c.upper().lower() == c else 2
    found = dict(_CLASS)
    for key in (lambda c: (unicodedata.name(c, "").split(" ")[0], unicodedata.category(c), casing(c), ord(c) >> 8), lambda c: (unicodedata.category(c), casing(c)), lambda c: 0):
        groups = defaultdict(list)
        for c in rest:
            groups[key(c)].append(c)
        found |= {c: k for g in groups.values() if len(g) > 1 for k in ["".join(g)] for c in g}
        rest = [g[0] for g in groups.values() if len(g) == 1]
    return found


_LOCAL = re.compile(r"[\w.%+-]{1,64}$")
_DOMAIN = re.compile(r"(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}")
_HAS_DIGIT = re.compile(r"\d")
_WORD = re.compile(rf"(?<!\w){_NAME}(?!\w)")
_TRUNK = re.compile(r"0[1-9]")
#: Kinds of IPv6 addresses by their first bits; the rest of the space is one kind more.
_KINDS = [ipaddress.IPv6Network(n) for n in ("fe80::/10", "fc00::/7", "ff00::/8", "2000::/3")]


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a whole text, in order and without overlap; the longer one wins."""
    found = []
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if local and domain:
            start = local.start() + len(local[0]) - len(local[0].lstrip(".-%+"))
            if start < at:
                found.append((start, domain.end(), "email"))
        at = text.find("@", at + 1)
    low, digits = text.lower(), bool(_HAS_DIGIT.search(text))
    for kind, possible, pattern in _PATTERNS:
        if not possible(text, low, digits):
            continue
        found += [(*m.span(1), kind) for m in pattern.finditer(text) if kind != "ip6" or _address(m[1])]
    found += _again(text, {text[a:b] for a, b, kind in found if kind == "name"})
    found.sort(key=lambda f: (f[0] - f[1], f[0]))
    kept: list[tuple[int, int, str]] = []
    for f in found:
        i = bisect(kept, (f[0], f[1]))  # by start: only the neighbours can overlap
        if (i == 0 or kept[i - 1][1] <= f[0]) and (i == len(kept) or f[1] <= kept[i][0]):
            kept.insert(i, f)
    return kept


def _address(value: str) -> ipaddress.IPv6Address | None:
    """The address, unless the text is none or one of the fixed ones, or looks like a slice (1::2) or words with colons between them."""
    if value.count(":") < 3 and not re.match("[0-9A-Fa-f]{4}:", value):
        return None
    try:
        found = ipaddress.IPv6Address(value)
    except ValueError:
        return None
    return found if _HAS_DIGIT.search(value) and int(found) > 1 else None


def _again(text: str, names: set[str]) -> list[tuple[int, int, str]]:
    """Where the text repeats names of two words or more, whole or by their last word (of four letters or more)."""
    many = [n.split(" ") for n in names if " " in n]
    if not many:
        return []
    by_first: dict[str, set[tuple[str, ...]]] = defaultdict(set)
    for words in many:
        by_first[words[0]].add(tuple(words))
        if len(words[-1]) > 3:
            by_first[words[-1]].add((words[-1],))
    found, words = [], list(_WORD.finditer(text))
    for i, m in enumerate(words):
        for name in sorted(by_first.get(m[0], ()), key=len, reverse=True):
            end = words[i + len(name) - 1].end() if i + len(name) <= len(words) else -1
            if end >= 0 and text[m.start() : end] == " ".join(name):
                found.append((m.start(), end, "name"))
                break
    return found


class Permuter:
    """A keyed permutation without fixed points of the numbers below n."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, r: int, x: int, width: int) -> int:
        h = hashlib.shake_256(b"|".join((self.key, tweak, str(r).encode(), str(x).encode()))).digest(width // 8 + 8)
        return int.from_bytes(h) & ((1 << width) - 1)

    def _feistel(self, x: int, n: int, tweak: bytes, rounds: range) -> int:
        half = max(1, -(-(n - 1).bit_length() // 2))
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for r in rounds:
                if rounds.step > 0:
                    a, b = b, a ^ self._round(tweak, r, b, half)
                else:
                    a, b = b ^ self._round(tweak, r, a, half), a
            x = a << half | b
            if x < n:
                return x

    def __call__(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        t = f"{tweak}|{n}".encode()
        shift = 1 + self._round(t, 99, 0, 256) % (n - 1)
        return self._feistel((self._feistel(x, n, t, range(0, 8)) + shift) % n, n, t, range(7, -1, -1))


class Surrogates:
    """Type-consistent replacements under one key."""

    def __init__(self, key: bytes):
        self.permute = Permuter(key)

    def _spelled(self, value: str, tweak: str, alphabets: dict[str, str], keep: Callable[[str], bool] = lambda s: True, fixed: int = 0) -> str:
        """value with each letter of an alphabet moved within it; case and everything else stay, the last `fixed` letters too."""
        low = value.lower()
        if len(low) != len(value):  # a dotted capital I becomes two characters: it stays one
            low = "".join(v if len(v.lower()) > 1 else v.lower() for v in value)
        if alphabets is _CLASS:
            if any(c not in _CLASS and c.isalnum() for c in low):
                alphabets = _all_classes()
            elif not any(c in _CLASS for c in low):
                alphabets = _MARKS
        places = [i for i, c in enumerate(low) if c in alphabets]
        places = places[: len(places) - fixed] or places
        if not places:  # only the separators of a name
            return value
        n = 1
        for i in places:
            n *= len(alphabets[low[i]])
        shape = "".join(alphabets[c][0] if i in set(places) else c for i, c in enumerate(low))
        letters = list(low)
        while True:
            x = 0
            for i in places:
                x = x * len(alphabets[letters[i]]) + alphabets[letters[i]].index(letters[i])
            x = self.permute(x, n, f"{tweak}|{shape}")
            for i in reversed(places):
                a = alphabets[letters[i]]
                x, k = divmod(x, len(a))
                letters[i] = a[k]
            made = "".join(letters)
            if made == low or keep(made):
                return "".join(_cased(c, k, v) for c, k, v in zip(made, low, value, strict=True))

    def _digits(self, value: str, tweak: str, skip: int = 0, keep: Callable[[str], bool] = lambda s: True) -> str:
        """The digits permuted as one number, whatever stands between them and in whatever script; the first `skip` digits stay."""
        digits = [str(unicodedata.decimal(c)) for c in value if c.isdecimal()]
        made = iter("".join(digits[:skip]) + self._spelled("".join(digits[skip:]), f"{tweak}|{''.join(digits[:skip])}", _DIGIT, lambda s: keep("".join(digits[:skip]) + s)))
        return "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(made))) if c.isdecimal() else c for c in value)

    def _name(self, value: str) -> str:
        out = []
        for i, word in enumerate(re.split(r"([ -])", value)):
            known = _KNOWN.get(word.casefold())
            if known and i == 0:
                group, k = known
                made = GIVEN[group][self.permute(k, len(GIVEN[group]), f"given|{group}")]
                out.append(made.upper() if word.isupper() and len(word) > 1 else made)
            else:
                out.append(self._spelled(word, "name", _CLASS, lambda s: s.casefold() not in _KNOWN, fixed=1 if len(word) > 3 else 0))
        return "".join(out)

    def _ip6(self, value: str) -> str:
        """An address of the same kind, written out or shortened and cased like the one it stands for."""
        x = int(ipaddress.IPv6Address(value))
        kind = next((n for n in _KINDS if ipaddress.IPv6Address(x) in n), None)
        while True:
            if kind is None:
                x = self.permute(x, 2**128, "ip6")
                good = x > 1 and not any(ipaddress.IPv6Address(x) in n for n in _KINDS)
            else:
                base, size = int(kind.network_address), kind.num_addresses
                x, good = base + self.permute(x - base, size, f"ip6|{kind}"), True
            if good:
                break
        made = ipaddress.IPv6Address(x)
        out = made.exploded if len(value) == 39 else str(made)
        return out.upper() if value.upper() == value and re.search("[A-F]", value) else out

    def make(self, value: str, kind: str) -> str:
        if kind == "email":
            local, _, domain = value.rpartition("@")
            host, _, top = domain.rpartition(".")
            return f"{self._spelled(f'{local}@{host}', f'email|{top.lower()}', _CLASS)}.{top}"
        if kind == "ip":
            parts = [int(p) for p in value.split(".")]
            private = _private(parts)
            while True:
                x = self.permute(int.from_bytes(bytes(parts)), 2**32, "ip")
                parts = list(x.to_bytes(4))
                if _private(parts) == private:
                    return ".".join(map(str, parts))
        if kind == "ip6":
            return self._ip6(value)
        if kind == "phone":
            code = re.match(r"\+(\d{1,3})(?=\D)", value)
            if code:
                return self._digits(value, "phone", len(code[1]))
            national = bool(_TRUNK.match(re.sub(r"\D", "", value)))
            return self._digits(value, "phone", keep=lambda s: bool(_TRUNK.match(s)) == national)
        if kind == "number":
            valid = _luhn(re.sub(r"\D", "", value))
            return self._digits(value, "number", keep=lambda s: _luhn(s) == valid)
        if kind == "ssn":
            return self._digits(value, "ssn")
        if kind == "iban":
            return value[:2] + self._spelled(value[2:], f"iban|{value[:2]}", _CLASS)
        if kind == "secret":
            hexes = re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", value)
            start = _PREFIX.match(value)
            if start and start.end() < len(value) and any(c in _CLASS for c in value[start.end() :].lower()):
                return start[0] + self._spelled(value[start.end() :], f"secret|{start[0].lower()}", _CLASS)
            return self._spelled(value, "secret", _HEX if hexes else _CLASS, lambda s: not _PREFIX.match(s))
        return self._name(value)

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str]], list[tuple[str, str, str]]]:
        """The new text, the entities' places in it with their types, and (type, entity, surrogate) for each; IPv6 addresses are shortened there."""
        out, at, shift, spans, pairs = [], 0, 0, [], []
        for start, end, kind in find(text):
            made = self.make(text[start:end], kind)
            out += [text[at:start], made]
            spans.append((start + shift, start + shift + len(made), kind))
            short = (lambda v: str(ipaddress.IPv6Address(v))) if kind == "ip6" else str
            pairs.append((kind, short(text[start:end]), short(made)))
            shift += len(made) - (end - start)
            at = end
        return ("".join([*out, text[at:]]) if out else text), spans, pairs


def _cased(c: str, low: str, v: str) -> str:
    """c, which replaces low, in the case of v, of which low is the lower case."""
    if c == low:
        return v
    up = c.upper()
    return up if v != low and v.isupper() and len(up) == 1 and up.lower() == c else c


def _private(p: list[int]) -> bool:
    return p[0] in (0, 10, 127) or p[0] >= 224 or (p[0] == 172 and 16 <= p[1] < 32) or (p[0] == 192 and p[1] == 168) or (p[0] == 169 and p[1] == 254)


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("type", T.StringType())]))
_PAIRS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("entity", T.StringType()), T.StructField("surrogate", T.StringType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))
_ARROW_PAIRS = pa.list_(pa.struct([("type", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())]))


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", spans: str | None = "pii_spans", pairs: str | None = None) -> DataFrame:
    """docs with the entities of a text column replaced; spans and pairs name the columns to add, if any."""
    names = [n for n in (spans, pairs) if n]
    free_name(docs, *names)
    small_batches(docs)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for batch in slices(batches, at):
            found = [(t, [], []) if t is None else made.replace(t) for t in batch.column(at).to_pylist()]
            cols = [*batch.columns]
            cols[at] = pa.array([f[0] for f in found], pa.string())
            if spans:
                cols.append(pa.array([[dict(zip(("start", "end", "type"), s, strict=True)) for s in f[1]] for f in found], _ARROW_SPANS))
            if pairs:
                cols.append(pa.array([[dict(zip(("type", "entity", "surrogate"), p, strict=True)) for p in f[2]] for f in found], _ARROW_PAIRS))
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *names])
        give_back()

    extra = [T.StructField(n, k) for n, k in ((spans, _SPANS), (pairs, _PAIRS)) if n]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def collisions(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """(type, surrogate, entities): surrogates that stand for more than one entity of the corpus; empty if all is well.

    Entities are compared by their canonical value: digits only for numbers, lower case for the rest.
    """
    found = pseudonymize(docs.select(text), key, text, None, "pairs").select(F.explode("pairs").alias("p")).select("p.*")
    canon = lambda c: F.when(F.col("type").isin("phone", "number", "ssn"), F.regexp_replace(c, r"\P{Nd}", "")).otherwise(F.lower(c))
    return found.select("type", canon("entity").alias("entity"), canon("surrogate").alias("surrogate")).groupBy("type", "surrogate").agg(F.min("entity").alias("a"), F.max("entity").alias("b")).filter("a <> b").select("type", "surrogate", F.array("a", "b").alias("entities"))


_made: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The key of `spark.calibra.pii.key`; without one a random key of this application, which no one can repeat."""
    found = spark.conf.get("spark.calibra.pii.key", None)
    return found.encode() if found else _made.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark)
    found = pseudonymize(docs, key).select("doc_id", F.size("pii_spans").cast("long").alias("n_entities"), "pii_spans", "text")
    return found.crossJoin(F.broadcast(collisions(docs, key).agg(F.count("*").alias("n_collisions"))))  # one row


QUERIES = {"op5_pii_surrogates": op5_pii_surrogates}
ORACLES: dict[str, str] = {}
