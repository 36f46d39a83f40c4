"""Personal data replaced by keyed surrogates of the same type and format.

Detected: e-mail addresses, telephone numbers, payment cards, IPv4 addresses, social
security numbers, IBANs, access keys, passwords and tokens after their label, and personal
names after a title or an introduction, with all later mentions of their parts in the text. A
surrogate is a keyed function of the entity's type and canonical form alone, so an entity has
the same one in every document and under every title (coreference). Formats of digits and
letters go through a keyed permutation of all strings of the same shape, so different entities
get different surrogates; names are drawn from syllables of the same script. A given name ends
as its gender asks: the one that titles tell anywhere in the corpus, or neither if they tell both.

The collision check runs over all distinct entities of the corpus: where two entities of a
type share a surrogate, or one is a form that the corpus holds, all but the first draw again, until
none is left; names get a syllable longer each time, so there is room for any number. Surrogates
that are another's real form are allowed after AVOID draws only (a private network may be full), ones
that two share or that are their own never: if such clashes remain after MAX_TRIES rounds, that
is an error. What drew again, or has a gender, is a table that is joined to the texts that hold it.

Defined results: null text stays null with no entities; empty text stays empty; text without
entities is unchanged; repeated rows get the same text; other columns never matter.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import cut, join_split, prepare, spool

KEY = b"linkloom surrogate key"
ROUNDS = 6
MAX_TRIES = 64
AVOID = 16  # draws that keep off the real forms of other entities
MAX_LONGER = 8  # syllables or characters added to what draws again
SAME_LENGTH = 8  # draws after which secrets and e-mail addresses get longer too


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str  # type of entity; with its shape, the domain of the permutation
    form: str  # canonical form
    text: str
    gender: str = ""  # of a given name: f or m, as its title tells


def _number(key: bytes, *parts: object) -> int:
    said = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(said, key=key, digest_size=16).digest(), "big")


def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(n): Feistel rounds over a square that holds it, walked until back in range."""
    if n < 2:
        return x
    side = isqrt(n - 1) + 1
    while True:
        left, right = divmod(x, side)
        for r in range(ROUNDS):
            left, right = right, (left + _number(key, tweak, n, r, right)) % side
        x = left * side + right
        if x < n:
            return x


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = "0123456789abcdef"


def _wheels(text: str, alphabets: tuple[str, ...]) -> list[str]:
    return [next((a for a in alphabets if c in a), "") for c in text]


PART = 48  # characters permuted as one number: half of its bits must be fewer than the 128 of _number, or the first characters stay


def reshape(text: str, key: bytes, tweak: str, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> str:
    """Another string of the same shape: each character stays in its alphabet, others stay as they are.

    A long one goes in parts, each by a permutation that depends on the original before it; so it stays a permutation.
    """
    if len(text) > PART:
        n, out, before = -(-len(text) // PART), [], tweak
        for i in range(n):
            part = text[len(text) * i // n : len(text) * (i + 1) // n]
            out.append(reshape(part, key, f"{tweak}{before}", alphabets))
            before = f"{i}-{_number(key, before, part):x}|"
        return "".join(out)
    wheels = _wheels(text, alphabets)
    n, x = 1, 0
    for c, wheel in zip(text, wheels, strict=True):
        if wheel:
            n, x = n * len(wheel), x * len(wheel) + wheel.index(c)
    shape = "".join(wheel[0] if wheel else c for c, wheel in zip(text, wheels, strict=True))
    x = permute(x, n, key, f"{tweak}|{shape}")
    out = []
    for c, wheel in zip(reversed(text), reversed(wheels), strict=True):
        if wheel:
            x, at = divmod(x, len(wheel))
            c = wheel[at]
        out.append(c)
    return "".join(reversed(out))


def luhn_digit(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _email(form: str, key: bytes, tweak: str) -> str:
    local, _, domain = form.partition("@")
    host, dot, tld = domain.rpartition(".")
    return f"{reshape(local, key, tweak + 'local')}@{reshape(host, key, tweak + 'host')}{dot}{tld}"


def _phone(form: str, key: bytes, tweak: str) -> str:
    """form: digits, after + the country code (none for 1). Ten national digits keep a valid area and exchange (first digit 2 to 9)."""
    head, national = (form[:-10], form[-10:]) if len(form) >= 10 else ("", form)
    if len(national) == 10 and national[0] >= "2" and national[3] >= "2":
        x = (int(national[:3]) - 200) * 800 * 10_000 + (int(national[3:6]) - 200) * 10_000 + int(national[6:])
        area, rest = divmod(permute(x, 800 * 800 * 10_000, key, tweak + head), 800 * 10_000)
        return f"{head}{area + 200}{rest // 10_000 + 200}{rest % 10_000:04d}"
    if len(national) == 10:
        while True:  # walks within the numbers of no valid area or exchange
            national = reshape(national, key, tweak + head + "other")
            if not (national[0] >= "2" and national[3] >= "2"):
                return head + national
    return head + reshape(national, key, tweak + head)


def _card(form: str, key: bytes, tweak: str) -> str:
    """The first digit and the state of the check digit stay."""
    body, off = form[1:-1], (int(form[-1]) - luhn_digit(form[:-1])) % 10
    first = form[0] + reshape(body, key, tweak + form[0])
    return first + str((luhn_digit(first) + off) % 10)


PRIVATE = ((10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24))


def _ip(form: str, key: bytes, tweak: str) -> str:
    """Private addresses stay in their range, public ones among the public."""
    a, b, c, d = map(int, form.split("."))
    x = a << 24 | b << 16 | c << 8 | d
    own = next(((base, bits) for base, bits in PRIVATE if x >> bits == base >> bits), None)
    if own:
        x = own[0] + permute(x - own[0], 1 << own[1], key, f"{tweak}{own[0]}")
    else:
        reserved = not 1 <= a <= 223
        while True:
            x = permute(x, 1 << 32, key, tweak + "public")
            if not any(x >> bits == base >> bits for base, bits in PRIVATE) and (not 1 <= x >> 24 <= 223) == reserved:
                break
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


AREAS = [a for a in range(1, 900) if a != 666]  # what a social security number may begin with


def _ssn(form: str, key: bytes, tweak: str) -> str:
    """Another valid number: a permutation of areas, groups of 1 to 99 and serials of 1 to 9999."""
    area, group, serial = int(form[:3]), int(form[3:5]), int(form[5:])
    x = permute((AREAS.index(area) * 99 + group - 1) * 9999 + serial - 1, len(AREAS) * 99 * 9999, key, tweak)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{AREAS[area]:03d}{group + 1:02d}{serial + 1:04d}"


def _iban(form: str, key: bytes, tweak: str) -> str:
    body = reshape(form[4:], key, tweak + form[:2])
    value = int("".join(str(int(c, 36)) for c in body + form[:2] + "00"))
    return f"{form[:2]}{98 - value % 97:02d}{body}"


#: Syllables and endings of made-up names by script: (syllables, ending of a woman's, of a man's, of a surname).
NAMES = {
    "latin": ("ba be bo da de di do fa fe ga go ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi".split(), "na", "ron", "ler"),
    "cyrillic": ("ба бе бо да де ди до га го ка ке ки ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то ва ве ви".split(), "на", "мир", "тов"),
    "greek": ("βα βε βο δα δε δι δο γα γο κα κε κι λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(), "να", "νος", "δης"),
}


def script_of(word: str) -> str:
    c = ord(next((x for x in word if x.isalpha()), "a"))
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin" if c < 0x250 else f"block{c >> 8}"


def _name(form: str, key: bytes, tweak: str, kind: str, tries: int, gender: str) -> str:
    """Each time it draws again the name is a syllable (or a letter) longer, so there is room for any number of names."""
    script = script_of(form)
    x = _number(key, tweak, kind, form)
    if script not in NAMES:  # letters of the same block of 256, as many
        letters = [chr(c) for c in range((ord(form[0]) >> 8) << 8, ((ord(form[0]) >> 8) + 1) << 8) if chr(c).isalpha() and chr(c).lower() == chr(c)]
        return "".join(letters[(x >> 8 * (i % 15)) % len(letters)] for i in range(len(form) + min(tries, MAX_LONGER)))
    syllables, woman, man, family = NAMES[script]
    ending = family if kind == "surname" else {"f": woman, "m": man}.get(gender, "")
    said = ""
    for _ in range((3 if kind == "surname" else 2) + min(tries, MAX_LONGER)):
        x, at = divmod(x, len(syllables))
        said += syllables[at]
    return said + ending


def _tail(form: str, key: bytes, tweak: str, tries: int) -> str:
    """Letters to add to a form whose shape has no place left."""
    x, said = _number(key, tweak, "tail", form), ""
    for _ in range(min(max(0, tries - SAME_LENGTH), MAX_LONGER)):
        x, at = divmod(x, len(LOWER))
        said += LOWER[at]
    return said


@lru_cache(maxsize=200_000)
def surrogate(kind: str, form: str, tries: int = 0, gender: str = "", key: bytes = KEY) -> str:
    """The canonical form of the entity's surrogate; tries counts how often it had to draw again."""
    tweak = f"{kind}#{tries}#"
    if kind == "email":
        return _tail(form, key, tweak, tries) + _email(form, key, tweak)
    if kind == "phone":
        return _phone(form, key, tweak)
    if kind == "card":
        return _card(form, key, tweak)
    if kind == "ip":
        return _ip(form, key, tweak)
    if kind == "iban":
        return _iban(form, key, tweak)
    if kind == "ssn" and len(form) == 9:
        return _ssn(form, key, tweak)
    if kind == "access_key":
        return form[:4] + reshape(form[4:], key, tweak)
    if kind in ("given", "surname"):
        return _name(form, key, tweak, kind, tries, gender)
    tail = _tail(form, key, tweak, tries) if kind == "secret" else ""
    if re.fullmatch("[0-9a-f]{16,}", form):
        return reshape(form, key, tweak, (HEX,)) + tail
    return reshape(form, key, tweak) + tail


def render(span: Span, form: str) -> str:
    """The surrogate form in the dress of the original text: separators, letter case."""
    old = span.text
    if span.kind in ("phone", "card", "ssn", "iban"):
        own = form.lstrip("+") if span.kind == "phone" else form
        more = sum(map(str.isalnum, old)) - len(own)  # digits of a country code that the form doesn't have
        fresh = iter([*filter(str.isalnum, old)][: max(0, more)] + [*own])
        return "".join(next(fresh, "") if c.isalnum() else c for c in old)
    if span.kind in ("given", "surname"):
        return form.upper() if old.isupper() and len(old) > 1 else form[:1].upper() + form[1:]
    if span.kind == "email":
        return form.upper() if old.isupper() else form
    return form


EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\d{1,4}(?:[ .-]\d{2,4}){2,4}|\d{8,12})|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w])")
#: Digits without separators are a card only with a right check digit.
CARD = re.compile(r"(?<![\w.-])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}([ -]?)\d{6}\2\d{5}|\d{13,19})(?![\w]|[.-]\d)")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
#: What stands before four numbers that are no address.
VERSION = re.compile(r"(?i)\b(?:v|ver|version|release|build|firmware|section|§)[ .:#]{0,3}\Z")
SSN = re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
ACCESS = re.compile(r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)")
#: What follows a label; words without a digit count only as the value of a password after an equals sign.
SECRET = re.compile(r"""(?i)\b(?:(?:password|passwd|pwd)\s{0,3}=|(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:](?=\s{0,3}["']?[A-Za-z_\-+/.]*+[0-9]))\s{0,3}["']?([A-Za-z0-9_\-+/.]{6,}+)""")
CAPITALS = "".join(chr(c) for c in range(0x41, 0x590) if chr(c).isupper())
CAP = rf"[{CAPITALS}][^\W\d_]+"
#: Names of scripts without capitals: Hebrew to Malayalam, Thai, kana, Han and Hangul, with their marks.
CASELESS = "[\u05d0-\u0dff\u0e01-\u0e4e\u3041-\u30ff\u3400-\u9fff\uac00-\ud7a3]{1,24}"
#: Titles and introductions that come before a name, by the gender they tell.
TITLES = {
    "f": "Mrs Ms Miss Mme Madame Mlle Frau Señora Sra Señorita Doña Madam Lady Signora г-жа госпожа Госпожа κυρία Κυρία".split(),
    "m": "Mr Mister Monsieur Herr Señor Sr Don Sir Lord Signor г-н господин Господин κύριος Κύριος".split(),
    "": "Dr Prof Professor Doctor".split(),
}
INTRODUCTIONS = ("my name is", "je m'appelle", "ich heiße", "mein name ist", "me llamo", "mi nombre es", "меня зовут", "με λένε")
GENDER = {t: g for g, own in TITLES.items() for t in own}
NAME = re.compile(
    rf"(?:\b({'|'.join(sorted(GENDER, key=len, reverse=True))})\.? (?:[{CAPITALS}]\. ?){{0,2}}|\b(?i:{'|'.join(INTRODUCTIONS)}) )"
    rf"({CAP}(?:[ -]{CAP}){{0,2}}|{CASELESS}(?:[ ·]{CASELESS}){{0,2}})(?!\w)"
)
NAME_WORD = re.compile(rf"(?<!\w)(?:{CAP}|{CASELESS})(?!\w)")


def _names(text: str) -> list[Span]:
    """Names after a title or introduction, then the other places where their parts stand as whole words of the text.

    A part is of one kind in the whole text, wherever it stands: what it is in a name of several parts counts first, then that
    somebody introduces himself by it alone; alone after a title it is a surname.
    """
    named: list[tuple[list[tuple[int, str]], str, bool]] = []
    for m in NAME.finditer(text):
        parts = [(x.start() + m.start(2), x[0]) for x in re.finditer(r"[^\s·-]+", m[2])]
        named.append((parts, GENDER.get(m[1] or "", ""), m[1] is None))
    kind_of: dict[str, str] = {}
    for parts, _, _ in named:
        if len(parts) > 1:
            for k, (_, word) in enumerate(parts):
                kind_of.setdefault(word.lower(), "surname" if k == len(parts) - 1 else "given")
    for lone, kind in ((True, "given"), (False, "surname")):
        for parts, _, introduced in named:
            if len(parts) == 1 and introduced is lone:
                kind_of.setdefault(parts[0][1].lower(), kind)
    found: list[Span] = []
    spellings: dict[str, str] = {}
    for parts, gender, _ in named:
        for at, word in parts:
            kind = kind_of[word.lower()]
            found.append(Span(at, at + len(word), kind, word.lower(), word, gender if kind == "given" else ""))
            for spelt in (word, word.upper(), word.capitalize()):
                spellings.setdefault(spelt, word.lower())
    if spellings:
        for m in NAME_WORD.finditer(text):
            if m[0] in spellings:
                form = spellings[m[0]]
                found.append(Span(m.start(), m.end(), kind_of[form], form, m[0]))
    return found


HAS_DIGIT = re.compile(r"\d")
RANK = ("email", "secret", "access_key", "iban", "ip", "card", "ssn", "phone", "given", "surname")


def find(text: str) -> list[Span]:
    """Entities that don't overlap, in their order; of overlapping ones the one of the earlier kind in RANK stays."""
    found: list[Span] = []
    add = lambda kind, m, form, g=0: found.append(Span(m.start(g), m.end(g), kind, form, m[g]))
    if "@" in text:
        for m in EMAIL.finditer(text):
            add("email", m, m[0].lower())
    if HAS_DIGIT.search(text):
        for m in IP.finditer(text) if "." in text else ():
            if not VERSION.search(text, max(0, m.start() - 16), m.start()):
                add("ip", m, ".".join(str(int(x)) for x in m[0].split(".")))
        for m in CARD.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if len(digits) < len(m[0]) or luhn_digit(digits[:-1]) == int(digits[-1]):
                add("card", m, digits)
        for m in PHONE.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            # With the country code 1 or without it a number is the same.
            add("phone", m, digits[1:] if m[0][:2] == "+1" and len(digits) == 11 else "+" * (m[0][0] == "+") + digits)
        for m in SSN.finditer(text):
            add("ssn", m, re.sub(r"\D", "", m[0]))
        for m in IBAN.finditer(text):
            form = m[0].replace(" ", "")
            if 15 <= len(form) <= 34 and int("".join(str(int(c, 36)) for c in form[4:] + form[:4])) % 97 == 1:
                add("iban", m, form)
    if "AKIA" in text or "ASIA" in text:
        for m in ACCESS.finditer(text):
            add("access_key", m, m[0])
    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            add("secret", m, m[1], 1)
    found += _names(text)
    # A name where it was introduced comes before mentions of its parts.
    found.sort(key=lambda s: min(RANK.index(s.kind), RANK.index("given")))
    kept: list[Span] = []
    taken = bytearray(len(text)) if found else b""
    for s in found:
        if not any(taken[s.start : s.end]):
            taken[s.start : s.end] = b"\x01" * (s.end - s.start)
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


#: What an entity needs besides its form: how often it drew again, and the gender of a given name.
Special = dict[tuple[str, str], tuple[int, str]]


def replace(text: str, spans: list[Span], special: Special, key: bytes = KEY) -> str:
    out, at = [], 0
    for s in spans:
        tries, gender = special.get((s.kind, s.form), (0, ""))
        out += [text[at : s.start], render(s, surrogate(s.kind, s.form, tries, gender, key))]
        at = s.end
    return "".join([*out, text[at:]])


ENTITY = "kind string, form string, gender string"


def held(texts: DataFrame) -> DataFrame:
    """The columns but ``text``, then kind, form and gender: each entity of a row's text once (per gender told)."""
    names = [c for c in texts.columns if c != "text"]
    schema = texts.select(*names).schema
    for part in ENTITY.split(", "):
        schema = schema.add(*part.split(" "))

    def run(batches):
        for batch in batches:
            at, own = [], []
            for i, t in enumerate(batch.column("text")):
                here = {(s.kind, s.form, s.gender) for s in find(t.as_py())} if t.is_valid else ()
                at += [i] * len(here)
                own += here
            cols = [pa.array([x[k] for x in own], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in names), *cols], names=[*names, "kind", "form", "gender"])

    return texts.mapInArrow(run, schema)


def distinct_entities(spans: DataFrame) -> DataFrame:
    """(kind, form, gender) of all entities; gender is empty where titles tell both or none."""
    told = [F.max(F.col("gender") == g).alias(g) for g in "fm"]
    gender = F.when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise("")
    return spans.groupBy("kind", "form").agg(*told).select("kind", "form", gender.alias("gender"))


def redraw(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, form, gender, tries) of the entities that have a gender, or whose first surrogate can't be theirs."""
    names = ["kind", "form", "gender", "tries"]

    def draw(batches):
        for batch in batches:
            fresh = [surrogate(k, f, t, g, key) for k, f, g, t in zip(*(batch.column(c).to_pylist() for c in names), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fresh, pa.string())], names=[*names, "fresh"])

    schema = f"{ENTITY}, tries int, fresh string"
    drawn = cut(found.withColumn("tries", F.lit(0)).select(*names).mapInArrow(draw, schema))
    real = drawn.select("kind", F.col("form").alias("fresh"), F.lit(True).alias("is_real"))
    for _ in range(MAX_TRIES):
        rank = F.row_number().over(Window.partitionBy("kind", "fresh").orderBy("tries", "form"))
        met = drawn.withColumn("r", rank).join(real, ["kind", "fresh"], "left")
        bad = (F.col("r") > 1) | (F.col("fresh") == F.col("form")) | (F.col("is_real") & (F.col("tries") < AVOID))
        clash = cut(met.where(bad).select(*names))
        if clash.isEmpty():
            return drawn.where("tries > 0 OR gender <> ''").select(*names)
        again = clash.withColumn("tries", F.col("tries") + 1).mapInArrow(draw, schema)
        drawn = cut(drawn.join(clash.select("kind", "form"), ["kind", "form"], "left_anti").unionByName(again))
    raise RuntimeError(f"surrogates still clash after {MAX_TRIES} draws")


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs with text replaced, and n_entities and kinds (sorted, comma-joined) added, in place of columns so named.

    Texts are met by a hash (of two texts with one hash each gets both's entities, which does no harm) and a part,
    so that a text that a large share of the rows has isn't one key. What is joined to them is a table of known
    size, which Spark sends to the texts if it is small.
    """
    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    hashable = [c for c in names if c != "text" and "map<" not in dict(docs.dtypes)[c] and "variant" not in dict(docs.dtypes)[c]]
    part = F.pmod(F.xxhash64(*hashable), F.lit(64)).cast("int") if hashable else F.lit(0)
    met = [F.xxhash64("text").alias("at"), part.alias("part")]
    spans = cut(held(docs.select(*met, "text")))
    special = spool(redraw(distinct_entities(spans), key), "surrogates")
    # Of an entity each text needs one row, whatever genders were told there.
    own = join_split(spans.select("at", "part", "kind", "form").distinct(), special, ["kind", "form"], ["at", "part"], "inner")
    own = spool(own.groupBy("at", "part").agg(F.collect_list(F.struct("kind", "form", "gender", "tries")).alias("own")), "surrogates-by-text")
    rows = docs.select(F.struct(*names).alias("doc"), *met).join(own, ["at", "part"], "left").select("doc", "own")

    def run(batches):
        for batch in batches:
            doc = batch.column("doc")
            cols = dict(zip(names, doc.flatten(), strict=True))
            texts, counts, kinds = [], [], []
            for t, mine in zip(cols["text"], batch.column("own"), strict=True):
                text = t.as_py()
                spans = find(text) if text else []
                table = {(x["kind"], x["form"]): (x["tries"], x["gender"]) for x in mine.as_py() or ()} if spans else {}
                texts.append(replace(text, spans, table, key) if spans else text)
                counts.append(len(spans))
                kinds.append(",".join(sorted({s.kind for s in spans})))
            cols["text"] = pa.array(texts, cols["text"].type)
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(counts, pa.int32()), pa.array(kinds, pa.string())], names=[*names, "n_entities", "kinds"])

    return rows.mapInArrow(run, docs.select(*names).schema.add("n_entities", "integer").add("kinds", "string"))
