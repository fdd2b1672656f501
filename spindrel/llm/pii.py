"""PII surrogates: detected entities give way to keyed, type-consistent replacements.

Detected are mail addresses, telephone numbers, IPv4 addresses, payment cards
(numbers with a right check digit), social security numbers, IBANs, secrets (access keys, hexadecimal
tokens, assigned tokens) and names behind a title.  A surrogate keeps its entity's format:

* digits become digits, letters letters of the same case and script, marks stay, by a
  keyed Feistel permutation over the entity's own mixed-radix number, so that equal
  entities get equal surrogates in every document (coreference) and different entities
  of a format different ones (distinctness) without any table of what was seen;
* fixed parts keep their meaning: mail goes to a reserved domain (a permuted local part, and
  a 128-bit keyed tag in place of the domain), card numbers and IBANs stay such by their
  check digits, each part of an address stays below 256, a country code stays;
* words of names are permuted within their script, vowels to vowels and consonants to
  consonants, whatever their case, so a family name has one surrogate behind any title and
  in any document; of two Latin words the given one becomes a known given name of the
  title's gender (of any behind a title without one) joined by a hyphen to the permuted word,
  as drawn names alone would coincide;
* a full or a family name that a title has told is replaced wherever it stands again in
  the same text without one.

Collisions are excluded by construction: a surrogate depends on its entity and the key
alone, never on its document, and the permutations are single cycles, so that no entity of a
format with two members or more is its own surrogate.  Spellings that differ in case only
(names, mail domains) or in the marks of a card number or an IBAN are one entity.

The key is a secret of the session (``spark.spindrel.pii.secret``): who has it can undo the
permutations.  Where none is set a random one is drawn for this application, so surrogates
agree within it and with no other.

Defined results: a null text stays null with no entities, an empty one stays empty;
overlapping detections go to the kind listed first and to the left, and numbers without the
check digits of a card or an IBAN are none; a very long text is read whole, line by line;
repeated rows get equal results; other columns are ignored; no rows give none.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrel.llm.common import byte_slices, table

SECRET = "spark.spindrel.pii.secret"
ROUNDS = 6
BATCH_BYTES = 1 << 20

_drawn: list[bytes] = []


def key_of(spark: SparkSession) -> bytes:
    """The configured key of the session, or one drawn at random for this application."""
    given = spark.conf.get(SECRET, None)
    if given:
        return hashlib.sha256(given.encode()).digest()
    if not _drawn:
        _drawn.append(secrets.token_bytes(32))
    return _drawn[0]


#: First names and titles by gender.
FEMALE = ("Alice", "Clara", "Edith", "Grace", "Irene", "Karin", "Maria", "Nadia", "Olivia", "Paula", "Ruth", "Sonia", "Teresa", "Ursula", "Vera", "Wanda")
MALE = ("Albert", "Bruno", "Carlos", "David", "Edgar", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Louis", "Martin", "Oscar", "Peter", "Victor")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Sra", "Srta", "Madame")
TITLES_M = ("Mr", "Herr", "Mister", "Sr", "Monsieur")
TITLES_N = ("Dr", "Prof")

_titles = "|".join(sorted((*TITLES_F, *TITLES_M, *TITLES_N), key=len, reverse=True))
_capital = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я](?:[\w-]|'(?!s\b)\w)+"
KINDS: tuple[tuple[str, str], ...] = (
    ("email", r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"\bA[KS]IA[A-Z2-7][A-Z0-9]{15}\b|\bgh[pousr]_[A-Za-z0-9]{30,}\b|\bsk-[A-Za-z0-9_-]{20,}|(?<![A-Za-z0-9])(?=[0-9A-Fa-f]{0,39}[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])|(?<=token = \")[^\"\s]{8,}(?=\")|(?<=TOKEN = \")[^\"\s]{8,}(?=\")"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b(?<=\d)"),
    ("ipv4", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    ("card", r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"),
    ("name", rf"\b(?:{_titles})\.? {_capital}(?: {_capital})?"),
)
FINDER = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in KINDS))
#: A line without any of these holds no entity; no entity spans lines.  Secrets of letters alone count too.
HINT = re.compile(rf"[@\d]|\bA[KS]IA|\bgh[pousr]_|\bsk-|token = \"|TOKEN = \"|(?<!\w)[{''.join(sorted({t[0] for t in (*TITLES_F, *TITLES_M, *TITLES_N)}))}][a-z]+\.? {_capital}")
#: Sets that letters of names, in lower case, are permuted within; other letters stay in their block of 128.
NAME_SETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûü", "çðñþýÿ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ", "ς", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ", "ъь")
LETTERS = {"A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a": "abcdefghijklmnopqrstuvwxyz", "0": "0123456789", "f": "0123456789abcdef", "F": "0123456789ABCDEF"}


def permute(number: int, size: int, key: bytes) -> int:
    """A keyed permutation of range(size) that is one cycle: no number stays, if there are two.

    The next number in the order of a balanced Feistel network with cycle walking.
    """
    if size < 2:
        return number
    return _feistel((_feistel(number, size, key, range(ROUNDS)) + 1) % size, size, key, range(ROUNDS - 1, -1, -1))


def _feistel(number: int, size: int, key: bytes, rounds: range) -> int:
    """The network's permutation of range(size), or its inverse by descending rounds."""
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    width = -(-half // 8)
    back = rounds.step < 0
    while True:
        left, right = number >> half, number & mask
        if back:
            left, right = right, left
        for r in rounds:
            digest = hmac.digest(key, bytes([r]) + right.to_bytes(width, "big"), "sha256")
            stream = digest if width <= 32 else hashlib.shake_256(digest).digest(width)
            left, right = right, left ^ (int.from_bytes(stream[:width], "big") & mask)
        if back:
            left, right = right, left
        number = left << half | right
        if number < size:
            return number


def _alphabets(text: str, base16: bool) -> list[str | None]:
    """The set that each character is drawn from; None where it stays."""
    if base16:
        return [LETTERS["F" if text.upper() == text else "f"]] * len(text)
    return [LETTERS["0"] if c in LETTERS["0"] else LETTERS["a"] if c in LETTERS["a"] else LETTERS["A"] if c in LETTERS["A"] else None for c in text]


def reshape(text: str, key: bytes, base16: bool = False) -> str:
    """Permute the characters that have an alphabet, as one number."""
    return _permuted(text, _alphabets(text, base16), key)


def _permuted(text: str, sets: list[str | None], key: bytes) -> str:
    number, size = 0, 1
    for c, s in zip(text, sets, strict=True):
        if s:
            number, size = number * len(s) + s.index(c), size * len(s)
    pattern = "".join(s[0] if s else c for c, s in zip(text, sets, strict=True)).encode()
    number = permute(number, size, hmac.digest(key, pattern, "sha256"))
    out = []
    for c, s in zip(reversed(text), reversed(sets), strict=True):
        if s:
            number, at = divmod(number, len(s))
            out.append(s[at])
        else:
            out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> str:
    """The check digit that belongs behind ``digits``."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _email(text: str, key: bytes) -> str:
    local, _, domain = text.partition("@")
    upper = local.upper() == local and local.lower() != local
    tag = hmac.digest(key, domain.lower().encode(), "sha256").hex()[:32]
    moved = reshape("".join(c if c.isascii() else "x" for c in local), key)
    if not local.isascii():  # letters outside the alphabets: told apart by a tag
        moved += hmac.digest(key, local.encode(), "sha256").hex()[:32]
    new = f"{moved}@{'m' if local.isascii() else 'u'}{tag}.example.org"
    return new.upper() if upper else new


def _is_card(text: str) -> bool:
    """Other long numbers are not payment cards and stay."""
    digits = re.sub(r"\D", "", text)
    return luhn(digits[:-1]) == digits[-1]


def _card(text: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", text)
    new = digits[0] + reshape(digits[1:-1], key + digits[:1].encode())
    fresh = iter(new + luhn(new))
    return "".join(next(fresh) if c.isdigit() else c for c in text)


def _ipv4(text: str, key: bytes) -> str:
    number = 0
    for part in text.split("."):
        number = number * 256 + int(part)
    moved = permute(number, 1 << 32, hmac.digest(key, b"ipv4", "sha256"))
    return ".".join(str(moved >> s & 255) for s in (24, 16, 8, 0))


def _phone(text: str, key: bytes) -> str:
    country = re.match(r"\+\d{1,3}(?=[ .(-])|", text)[0]
    return country + reshape(text[len(country) :], key)


def _secret(text: str, key: bytes) -> str:
    prefix = re.match(r"A[KS]IA|gh[pousr]_|sk-|", text)[0]
    rest = text[len(prefix) :]
    base16 = bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", rest)) and not prefix
    return prefix + reshape(rest, key, base16)


def iban_check(country: str, rest: str) -> str:
    """The two check digits that belong between the country and the rest."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country) + '00') % 97:02}"


def _is_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return iban_check(plain[:2], plain[4:]) == plain[2:4]


def _iban(text: str, key: bytes) -> str:
    plain = text.replace(" ", "")
    rest = reshape(plain[4:], key + plain[:2].encode())
    fresh = iter(plain[:2] + iban_check(plain[:2], rest) + rest)
    return "".join(c if c == " " else next(fresh) for c in text)


def _caseless(c: str) -> bool:
    """Whether a lower-case letter has a capital that leads back to it."""
    return len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c


@lru_cache(maxsize=4096)
def _name_set(c: str) -> str | None:
    """The letters that ``c``, in lower case if it has one, is drawn from."""
    for s in (*NAME_SETS, LETTERS["0"]):
        if c in s:
            return s
    if not c.isalnum():
        return None
    like = lambda x: (unicodedata.category(x), _caseless(x))
    block = ord(c) & ~127
    return "".join(x for x in map(chr, range(block, block + 128)) if like(x) == like(c) and not any(x in s for s in NAME_SETS))


def _word(text: str, key: bytes) -> str:
    """A word of a name, permuted in lower case; its capitals come back."""
    upper = [c != c.lower() and len(c.lower()) == 1 and _caseless(c.lower()) and c.lower().upper() == c for c in text]
    low = "".join(c.lower() if u else c for c, u in zip(text, upper, strict=True))
    new = _permuted(low, [_name_set(c) for c in low], key)
    return "".join(c.upper() if u else c for c, u in zip(new, upper, strict=True))


def _name(text: str, key: bytes) -> str:
    title, _, rest = text.partition(" ")
    return f"{title} {_untitled(title.rstrip('.'), rest, key)}"


def _untitled(title: str, rest: str, key: bytes) -> str:
    words = [_word(w, key) for w in rest.split(" ")]
    if len(words) > 1 and not re.search("[Ͱ-Ͽ]|[Ѐ-ӿ]", rest):
        draw = int.from_bytes(hmac.digest(key, rest.partition(" ")[0].lower().encode(), "sha256")[:8], "big")
        first = FEMALE if title in TITLES_F else MALE if title in TITLES_M else FEMALE + MALE
        words[0] = f"{first[draw % len(first)]}-{words[0]}"
    return " ".join(words)


def _mentions(names: list[str], key: bytes) -> tuple[re.Pattern, dict[str, str]]:
    """Where full and family names stand without their titles, and what becomes of them."""
    given: dict[str, str] = {}
    for name in names:
        title, _, rest = name.partition(" ")
        family = rest.rpartition(" ")[2]
        given.setdefault(rest, _untitled(title.rstrip("."), rest, key))
        if len(family) > 2:
            given.setdefault(family, _word(family, key))
    known = "|".join(map(re.escape, sorted(given, key=lambda n: (-len(n), n))))
    return re.compile(rf"(?<![\w'-])(?:{known})(?![\w-]|'(?!s\b))"), given


REPLACE: dict[str, Callable[[str, bytes], str]] = {
    "email": _email, "secret": _secret, "iban": _iban, "ipv4": _ipv4, "card": _card, "ssn": reshape, "phone": _phone, "name": _name,
}


#: Kinds that hold only what has the right check digits.
CHECKS: dict[str, Callable[[str], bool]] = {"card": _is_card, "iban": _is_iban}


def surrogates(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str]]]:
    """(text with surrogates, [(kind, entity, surrogate)] for each distinct entity)."""
    matches, at = [], 0
    while hint := HINT.search(text, at):
        start, end = text.rfind("\n", 0, hint.start()) + 1, text.find("\n", hint.start())
        at = len(text) if end < 0 else end
        matches += [m for m in FINDER.finditer(text, start, at) if CHECKS.get(m.lastgroup, bool)(m[0])]
    if not matches:
        return text, []
    found: dict[str, str] = {}
    for m in matches:
        found.setdefault(m[0], m.lastgroup)
    given: dict[str, str] = {}
    for entity, kind in found.items():
        new = REPLACE[kind](entity, hmac.digest(key, kind.encode(), "sha256"))
        given[entity] = new if new != entity else new + "x"  # a format with one member
    names = [entity for entity, kind in found.items() if kind == "name"]
    if names:
        bare, known = _mentions(names, hmac.digest(key, b"name", "sha256"))
        between = lambda piece: bare.sub(lambda m: known[m[0]], piece)
    else:
        between = str
    out, at = [], 0
    for m in matches:
        out += [between(text[at : m.start()]), given[m[0]]]
        at = m.end()
    return "".join(out) + between(text[at:]), [(kind, entity, given[entity]) for entity, kind in found.items()]


def replace_pii(docs: DataFrame, key: bytes, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, the new text, and the distinct entities found, by kind.

    ``entities`` maps a kind to the number of distinct entities of that kind.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([*source.schema.fields, T.StructField("entities", T.MapType(T.StringType(), T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in byte_slices(b, 1, BATCH_BYTES)):
            texts, counts = [], []
            for value in batch.column(1):
                old = value.as_py()
                new, found = surrogates(old, key) if old is not None else (None, [])
                texts.append(new)
                tally: dict[str, int] = {}
                for kind, _, _ in found:
                    tally[kind] = tally.get(kind, 0) + 1
                counts.append(sorted(tally.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.map_(pa.string(), pa.int64()))], names=["doc_id", "text", "entities"]
            )

    return source.mapInArrow(run, schema)


def rewrite(docs: DataFrame, key: bytes, *, text_col="text", length_col="n_chars") -> DataFrame:
    """The rows with all their columns, entities replaced; a length column follows a changed text."""
    text_at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in byte_slices(b, text_at, BATCH_BYTES)):
            old = batch.column(text_at)
            new = pa.array([None if (t := value.as_py()) is None else surrogates(t, key)[0] for value in old], old.type)
            columns = batch.columns
            columns[text_at] = new
            if length_at is not None:
                kind = columns[length_at].type
                same = pc.fill_null(pc.equal(old, new), True)
                columns[length_at] = pc.if_else(same, columns[length_at], pc.utf8_length(new).cast(kind))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, and the number of distinct entities of each kind."""
    found = replace_pii(table(spark, sf_dir, "documents"), key_of(spark))
    counts = [F.coalesce(F.try_element_at("entities", F.lit(kind)), F.lit(0)).alias(f"n_{kind}") for kind, _ in KINDS]
    return found.select("doc_id", "text", *counts)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its entities replaced; n_chars follows a changed text."""
    return rewrite(docs, key_of(docs.sparkSession))
