"""Personal data: keyed surrogates that keep type, gender, script and format.

Values with a format (addresses, numbers, secrets) are permuted within it: a
keyed Feistel permutation over all values of the same pattern, walked until
the result keeps what the value has (a valid check digit, no leading zero).
So distinct values get distinct surrogates, and one value the same one
everywhere, whatever its case or punctuation. Names are drawn by a keyed hash
from syllables of their script, with an ending of their gender.

A check over all distinct values then looks for surrogates that are equal, or
that are themselves a value of the table; those values are drawn again until
none is left. Only values drawn again need to be told to the workers. What is
written or shuffled for this check is sealed with the key.

Names are found after a title, with or without initials; further mentions of
them in the same text, and a listed given name before one, are found as well.
Numbers whose check digits are wrong get surrogates with wrong ones. Not found:
names that no title ever comes before in their text, postal addresses, birth
dates, and secrets of none of the formats below. Names in scripts other than
Latin, Greek and Cyrillic get Latin surrogates.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import drop_stash, extended, slices, stash, unused

#: Values drawn again that are sent to every worker; more are joined to the rows that hold them.
BROADCAST_REDRAWN = 50_000
#: Draws after which a surrogate gets longer than its value, so that a full format cannot stop the check.
ROOMIER = 6
MOST_ROUNDS = 40
ROUNDS = 8
#: Characters of a text that are permuted as one number; a longer one is permuted piece by piece.
PIECE = 64
#: Characters of a credential within which its first digit must stand.
CREDENTIAL_REACH = 256

#: Alphabets within which a character stays. Fixed values.
ALPHABETS = {
    "digit": "0123456789",
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "accented": "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß",
    "greek": "αβγδεζηθικλμνξοπρςστυφχψω",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюяё",
}
_class_of = {c: name for name, letters in ALPHABETS.items() for c in letters}
HEX, BASE36, BASE62 = "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Syllables and endings of drawn names, by script. Fixed values.
SYLLABLES = {
    "latin": "ba be bo da de di do fa fe fi ga go ha he ja jo ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi wa we za ze".split(),
    "cyrillic": "ба бо ва ве ви да де до ка ки ко ла ле ли ма ми мо на не ни ра ре ри ро са се си та те ти".split(),
    "greek": "βα βε γα δα δε δι κα κο λα λε λι μα με μι να νε νι ρα ρε ρι σα σε τα τε τι".split(),
}
ENDINGS = {
    "latin": {"f": ("na", "lia", "ra"), "m": ("ron", "to", "vin"), "n": ("len", "sel", "ris"), "surname": ("mann", "sen", "ley", "ard", "ini")},
    "cyrillic": {"f": ("на", "лия"), "m": ("мир", "ан"), "n": ("ен", "ис"), "surname": ("ов", "ин", "ский")},
    "greek": {"f": ("να", "λια"), "m": ("ρος", "νας"), "n": ("ις", "ες"), "surname": ("δης", "πουλος")},
}
#: Titles before a name and the gender they tell. Fixed values.
TITLES = {
    "m": ("Mr", "Herr", "Señor", "Sr", "г-н", "Monsieur"),
    "f": ("Mrs", "Ms", "Mme", "Mlle", "Frau", "Señora", "Sra", "г-жа", "Madame"),
    "n": ("Dr", "Prof"),
}
_gender = {t: g for g, ts in TITLES.items() for t in ts}
#: Given names that tell a gender where the title does not. Fixed values.
GIVEN = {
    "f": "anna maria julia sophie laura emma sarah claire marta elena lucia carmen anja petra katrin olga мария анна елена ольга".split(),
    "m": "john peter paul michael thomas david pierre jean luc hans karl jose juan carlos pablo ivan иван пётр сергей алексей".split(),
}
_given = {n: g for g, ns in GIVEN.items() for n in ns}

#: Country codes of two digits; 1 and 7 have one, all others three. Fixed values of the public numbering plan.
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

_titles = "|".join(re.escape(t) for t in sorted(_gender, key=len, reverse=True))
_name = r"[^\W\d_a-zà-öø-ÿα-ωа-яё](?:[^\W\d_]+|(?=[’'-]))(?:[’'-](?!s\b)[^\W\d_]+)*"
_octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: The patterns, in the order in which they claim a place. None starts within a run of letters and digits, and none looks back over one, so the time is in proportion to the text.
PATTERN = re.compile(
    r"(?<![^\W_])(?:"
    + "|".join(
        (
            rf"(?P<credential>(?i:(?:password|passwd|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth)\b[\"']?[ \t]*[=:][ \t]*[\"']?)(?P<value>(?=[^\s\"']{{0,{CREDENTIAL_REACH}}}\d)[^\s\"']{{5,}}\w))",
            r"(?P<email>(?<![\w.%+-])[\w.%+-]++@[\w-]++(?:\.[\w-]+)*\.[^\W\d_]{2,})",
            rf"(?P<ip>(?<![\w.]){_octet}(?:\.{_octet}){{3}}(?![\w]|\.\d))",
            r"(?P<phone>(?<!\w)(?:"
            r"(?<!\+)\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)"  # with a country code
            r"|(?<![.(+-])(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]|\.\d)"  # three, three and four digits
            r"|(?<![.(+-])0\d(?P<gap>[ .-]?)\d{2}(?:(?P=gap)\d{2}){3}(?![\w-]|[ .]?\d)"  # five pairs from 0
            r"|(?<![.(+-])0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,5}(?![\w-]|[ .]?\d)"  # a dialling code from 0 and a number
            r"))",
            r"(?P<called>(?i:t[eé]l(?:[eé]phone|[eé]fono|efon)?|phone|fax|mobile|m[oó]vil|portable|handy)(?:\.?:?[ \t]+|:)(?P<national>\(?\d(?:[ ./-]?\d){1,4}\)?(?:[ ./-]{0,2}\d){4,11})(?![\w-]))",
            r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
            r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))",
            r"(?P<aws>(?<!\w)A(?:KIA|SIA)[A-Z0-9]{16}(?!\w))",
            r"(?P<token>(?<!\w)(?:ghp_|gho_|sk-|xox[abp]-)[A-Za-z0-9]{16,}+(?!\w))",
            r"(?P<number>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))",
            r"(?P<secret>(?<!\w)[0-9a-fA-F]{32,128}(?!\w))",
            rf"(?P<person>(?<!\w)(?P<title>{_titles})\.?[ \t]+(?:(?:{_titles})\.?[ \t]+)*(?:[^\W\d_]\.[ \t]*){{0,3}}(?P<names>{_name}(?:[ \t]+(?:[^\W\d_]\.[ \t]+)?{_name}){{0,2}}))",
        )
    )
    + ")"
)
#: No pattern matches a text without one of these.
_trigger = re.compile(rf"@|\d[^\w]{{0,2}}\d|(?<!\w)(?:{_titles})\.?[ \t]|[0-9a-fA-F]{{32}}|A[KS]IA|ghp_|gho_|sk-|xox|(?i:password|passwd|passphrase|pwd|secret|token|key|auth)")
_mention = re.compile(rf"(?<![\w’'-]){_name}")


_hex = re.compile(r"[0-9a-f]{8,}|[0-9A-F]{8,}")


def luhn(digits: str) -> bool:
    """The check digit of a card number is right."""
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def iban_valid(value: str) -> bool:
    """The check digits of an account number are right."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


class Keyed:
    """Permutations and draws under one key."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.sha256(key).digest()

    def draw(self, *parts: str) -> int:
        """A number of 256 bits from the key and the parts."""
        return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), key=self.key, digest_size=32).digest(), "big")

    def permute(self, value: int, size: int, tweak: str, fits: Callable[[int], bool] = lambda _: True) -> int:
        """The place of value in a permutation of those numbers below size that fit; value must fit."""
        half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
        mask, n_bytes, start = (1 << half) - 1, (half + 7) // 8, self.key + tweak.encode("utf-8", "surrogatepass") + size.to_bytes((size.bit_length() + 7) // 8, "big")
        while True:
            left, right = value >> half, value & mask
            for r in range(ROUNDS):
                mixed = hashlib.shake_256(start + bytes([r]) + right.to_bytes(n_bytes, "big")).digest(n_bytes)
                left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
            value = left << half | right
            if value < size and fits(value):
                return value

    def letters(self, text: str, tweak: str, fits: Callable[[str], bool] = lambda _: True) -> str:
        """A permutation of all lower-case texts of the same pattern that fit; characters of no alphabet stay. Beyond PIECE characters, of each piece in its place."""
        if len(text) > PIECE:
            return "".join(self.letters(text[i : i + PIECE], f"{tweak}|{i}") for i in range(0, len(text), PIECE))
        classes = [_class_of.get(c) for c in text]
        value, size = 0, 1
        for c, name in zip(text, classes, strict=True):
            if name:
                value, size = value * len(ALPHABETS[name]) + ALPHABETS[name].index(c), size * len(ALPHABETS[name])
        if size == 1:
            return text
        pattern = "".join(f"<{name}>" if name else c for c, name in zip(text, classes, strict=True))

        def read(value: int) -> str:
            out = []
            for c, name in zip(reversed(text), reversed(classes), strict=True):
                if name:
                    value, k = divmod(value, len(ALPHABETS[name]))
                    c = ALPHABETS[name][k]
                out.append(c)
            return "".join(reversed(out))

        return read(self.permute(value, size, f"{tweak}|{pattern}", lambda v: fits(read(v))))

    def seal(self, kind: str, value: str) -> bytes:
        """A value in a form that shows nothing of it without the key; equal ones are equal."""
        data = value.encode("utf-8", "surrogatepass")
        mark = hashlib.blake2b(kind.encode() + b"\0" + data, key=self.key, digest_size=16).digest()
        return mark + self._masked(mark, data)

    def unseal(self, sealed: bytes) -> str:
        """The value that was sealed."""
        return self._masked(sealed[:16], sealed[16:]).decode("utf-8", "surrogatepass")

    def _masked(self, mark: bytes, data: bytes) -> bytes:
        mask = hashlib.shake_256(self.key + b"seal" + mark).digest(len(data))
        return (int.from_bytes(data, "big") ^ int.from_bytes(mask, "big")).to_bytes(len(data), "big")

    def over(self, text: str, alphabet: str, tweak: str, fits: Callable[[str], bool] = lambda _: True) -> str:
        """A permutation of the texts of this length over an alphabet that fit. Beyond PIECE characters, of each piece in its place."""
        if len(text) > PIECE:
            return "".join(self.over(text[i : i + PIECE], alphabet, f"{tweak}|{i}") for i in range(0, len(text), PIECE))
        base, n = len(alphabet), len(text)

        def read(value: int) -> str:
            out = []
            for _ in range(n):
                value, k = divmod(value, base)
                out.append(alphabet[k])
            return "".join(reversed(out))

        value = 0
        for c in text:
            value = value * base + alphabet.index(c)
        return read(self.permute(value, base**n, f"{tweak}|{base}|{n}", lambda v: fits(read(v))))


def script_of(word: str) -> str:
    """Script of a name's first letter of a known alphabet, else latin."""
    return next((s for c in word.lower() if (s := _class_of.get(c)) in SYLLABLES), "latin")


def _lower(text: str) -> str:
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def _cased(text: str, like: str) -> str:
    """text with capitals where like has them; beyond its end as at its end."""
    shape = like + like[-1:] * max(0, len(text) - len(like))
    return "".join(up if s.isupper() and len(up := c.upper()) == 1 else c for c, s in zip(text, shape, strict=False))


def spans(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, canonical value, surface) of each value in a text, in order, without overlap; a person gives one for each name.

    The canonical value is what two mentions of one thing share.
    """
    out: list[tuple[int, int, str, str, str]] = []
    if not _trigger.search(text):
        return out
    people: dict[str, tuple[str, str]] = {}  # a name in lower case: its kind and canonical value
    for m in PATTERN.finditer(text):
        kind, s = m.lastgroup, m.group()
        if kind == "credential":
            s = m["value"]
            canon, kind = (s.lower(), "secret") if _hex.fullmatch(s) else (s, "credential")
            out.append((m.start("value"), m.end("value"), kind, canon, s))
            continue
        if kind == "called":
            out.append((m.start("national"), m.end("national"), "phone", _phone(m["national"]), m["national"]))
            continue
        if kind == "person":
            names = [(n.start() + m.start("names"), n.group()) for n in re.finditer(r"\S{2,}(?<!\.)", m["names"])]
            gender = _gender[m["title"]]
            for k, (at, name) in enumerate(names):
                low = _lower(name)
                if k == len(names) - 1:
                    own = "surname", f"{script_of(name)}|{low}"
                else:
                    own = "given", f"{gender if gender != 'n' else _given.get(low, 'n')}|{script_of(name)}|{low}"
                people.setdefault(low, own)
                out.append((at, at + len(name), *own, name))
            continue
        if kind == "email":
            canon = _lower(s)
        elif kind == "phone":
            canon = _phone(s)
        elif kind in ("ssn", "number"):
            canon = re.sub(r"\D", "", s)
        elif kind == "iban":
            canon = s.replace(" ", "")
            if not iban_valid(canon) and sum(map(str.isdigit, canon[4:])) < 8:
                continue
        elif kind == "ip":
            canon = ".".join(str(int(x)) for x in s.split("."))
        elif kind == "secret":
            canon = s.lower()
        else:
            canon = s
        out.append((m.start(), m.end(), kind, canon, s))
    return _with_mentions(text, out, people) if people else out


def _with_mentions(text: str, found: list[tuple[int, int, str, str, str]], people: dict[str, tuple[str, str]]) -> list[tuple[int, int, str, str, str]]:
    """found and, between its spans, every further mention of the people's names, and of a listed given name right before one of them."""
    more, k = [], 0
    before: tuple[int, int, str] | None = None  # a listed given name that the next word may make a person's
    for m in _mention.finditer(text):
        start, end, name = m.start(), m.end(), m.group()
        while k < len(found) and found[k][1] <= start:
            k += 1
        free = k == len(found) or found[k][0] >= end
        low = _lower(name)
        own = people.get(low)
        if own and before and text[before[1] : start].isspace():
            first = _lower(before[2])
            more.append((before[0], before[1], "given", f"{_given[first]}|{script_of(first)}|{first}", before[2]))
        before = None
        if own and free:
            more.append((start, end, *own, name))
        elif free and low in _given:
            before = (start, end, name)
    return sorted(found + more) if more else found


def _phone(surface: str) -> str:
    """Country code, a bar, and the national digits."""
    digits = re.sub(r"\D", "", surface)
    if not surface.startswith("+"):
        return "|" + digits
    n = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3
    return f"{digits[:n]}|{digits[n:]}"


def surrogate(keyed: Keyed, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value; attempt: how often it was drawn before."""
    tweak, more = f"{kind}|{attempt}", attempt >= ROOMIER
    if kind in ("given", "surname"):
        *gender, where, _ = canon.split("|", 2 if kind == "given" else 1)
        n, parts = keyed.draw(tweak, canon), []
        for _ in range(2 + (attempt + 1) // 2):
            n, k = divmod(n, len(SYLLABLES[where]))
            parts.append(SYLLABLES[where][k])
        ends = ENDINGS[where][gender[0] if gender else "surname"]
        return "|".join([*gender, where, "".join(parts) + ends[n % len(ends)]])
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        *labels, top = domain.split(".")
        if more:
            local += "x"
        return keyed.letters(local, f"{tweak}|local") + "@" + ".".join(keyed.letters(x, f"{tweak}|label") for x in labels) + "." + top
    if kind == "phone":
        country, national = canon.split("|")
        zero = national.startswith("0")
        return country + "|" + keyed.over(national + "0" * more, ALPHABETS["digit"], f"{tweak}|{country}|{zero}", lambda x: x.startswith("0") == zero)
    if kind in ("ssn", "number"):
        zero, valid = canon.startswith("0"), luhn(canon) and kind == "number"
        padded = next(canon + d for d in "0123456789" if not more or luhn(canon + d) == valid) if more else canon
        return keyed.over(padded, ALPHABETS["digit"], f"{tweak}|{zero}|{valid}", lambda x: x.startswith("0") == zero and (kind == "ssn" or luhn(x) == valid))
    if kind == "ip":
        a = [int(x) for x in canon.split(".")]
        value, usual = int.from_bytes(bytes(a), "big"), 0 < a[0] < 255
        new = keyed.permute(value, 1 << 32, f"{tweak}|{usual}", lambda v: (0 < v >> 24 < 255) == usual)
        return ".".join(map(str, new.to_bytes(4, "big")))
    if kind == "iban" and not iban_valid(canon):
        return canon[:2] + keyed.letters(canon[2:].lower(), f"{tweak}|{canon[:2]}|wrong", lambda x: not iban_valid(canon[:2] + x.upper())).upper()
    if kind == "iban":
        land, rest = canon[:2], canon[4:]
        shape = "".join("9" if c.isdigit() else "A" for c in rest)
        new = keyed.letters(rest.lower(), f"{tweak}|{land}|{shape}").upper()
        check = 98 - int("".join(str(int(c, 36)) for c in new + land + "00")) % 97
        return f"{land}{check:02d}{new}"
    if kind == "secret":
        return keyed.over(canon + "0" * more, HEX, tweak)
    if kind == "credential":
        case = "".join("u" if c.isupper() else "l" for c in canon)
        low = _lower(canon) + "0" * more
        return _cased(keyed.letters(low, f"{tweak}|{hashlib.sha256(case.encode()).hexdigest()}"), canon + "0" * more)
    if kind == "aws":
        return canon[:4] + keyed.over(canon[4:] + "0" * more, BASE36, tweak)
    head = re.match(r"(?:ghp_|gho_|sk-|xox[abp]-)", canon).group()
    return head + keyed.over(canon[len(head) :] + "0" * more, BASE62, f"{tweak}|{head}")


def written(kind: str, surface: str, new: str) -> str:
    """A canonical surrogate in the dress of the surface it replaces: its case, blanks, brackets and dashes."""
    if kind in ("given", "surname"):
        name = new.rpartition("|")[2]
        return name.upper() if surface.isupper() and len(surface) > 1 else name.capitalize()
    if kind == "email":
        return _cased(new, surface)
    if kind == "secret":
        return new.upper() if any(c.isupper() for c in surface) else new
    if kind in ("ip", "aws", "token", "credential"):
        return new
    signs = iter(new.replace("|", ""))
    dressed = "".join(next(signs) if c.isalnum() else c for c in surface)
    return dressed + "".join(signs)


def replace(text: str, keyed: Keyed, redrawn: dict[tuple[str, bytes], int]) -> tuple[str, int]:
    """The text with a surrogate for every value, and how many there were. redrawn: (kind, sealed value) to attempt."""
    found, out, at = spans(text), [], 0
    for start, end, kind, canon, surface in found:
        attempt = redrawn.get((kind, keyed.seal(kind, canon)), 0) if redrawn else 0
        out += [text[at:start], written(kind, surface, surrogate(keyed, kind, canon, attempt))]
        at = end
    return "".join([*out, text[at:]]) if found else text, len(found)


def entities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, start, end, kind, canon, surface) of every value; offsets in code points."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                rows = [(i, *s) for i, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True) for s in spans(t or "")]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (piece.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)],
                        ["doc_id", "start", "end", "kind", "canon", "surface"],
                    )

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, start long, end long, kind string, canon string, surface string")


def _values(docs: DataFrame, keyed: Keyed) -> DataFrame:
    """Rows (mark, kind, sealed) of the values in docs (mark, text), each once for each piece of a batch and mark; nothing leaves a task in clear."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found = {(i, kind, canon) for i, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True) for _, _, kind, canon, _ in spans(t or "")}
                rows = [(i, kind, keyed.seal(kind, canon)) for i, kind, canon in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.binary(), pa.string(), pa.binary()), strict=True)], ["mark", "kind", "sealed"])

    return docs.select("mark", F.col("text").cast("string").alias("text")).mapInArrow(run, "mark binary, kind string, sealed binary")


def _drawn(values: DataFrame, keyed: Keyed) -> DataFrame:
    """Rows (kind, sealed, attempt) with the sealed surrogate of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [keyed.seal(kind, surrogate(keyed, kind, keyed.unseal(sealed), attempt)) for kind, sealed, attempt in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.binary())], ["kind", "sealed", "attempt", "new"])

    return values.select("kind", "sealed", "attempt").mapInArrow(run, "kind string, sealed binary, attempt int, new binary")


def redrawn_values(docs: DataFrame, keyed: Keyed, text: str = "text") -> DataFrame:
    """Rows (kind, sealed, attempt), attempt > 0, of the values whose first surrogate is another's or is itself a value; written.

    Of values with one surrogate one keeps it. Each round joins the distinct
    values to their surrogates; nothing comes to the driver but whether any
    was drawn again. A RuntimeError after MOST_ROUNDS rounds: each makes a
    full format roomier, so that is a fault of the formats, not of the data.
    """
    found = _values(docs.select(F.lit(None).cast("binary").alias("mark"), F.col(text).alias("text")), keyed)
    now = stash(_drawn(found.select("kind", "sealed").distinct().withColumn("attempt", F.lit(0)), keyed), "surrogates")
    for _ in range(MOST_ROUNDS):
        shared = now.groupBy("kind", "new").agg(F.count(F.lit(1)).alias("n"), F.min("sealed").alias("least")).filter("n > 1").select("kind", "new", "least")
        taken = now.select("kind", F.col("sealed").alias("new")).withColumn("taken", F.lit(True))
        marked = now.join(shared, ["kind", "new"], "left").join(taken, ["kind", "new"], "left")
        again = stash(marked.filter((F.col("least").isNotNull() & (F.col("sealed") != F.col("least"))) | F.col("taken")).select("kind", "sealed", (F.col("attempt") + 1).alias("attempt")), "drawn-again")
        if again.isEmpty():
            redrawn = stash(now.filter("attempt > 0").select("kind", "sealed", "attempt"), "redrawn")
            drop_stash(now)
            return redrawn
        after = stash(now.join(again, ["kind", "sealed"], "left_anti").unionByName(_drawn(again, keyed)), "surrogates")
        drop_stash(now)
        drop_stash(again)
        now = after
    raise RuntimeError(f"surrogates still collide after {MOST_ROUNDS} draws")


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", count_out: str | None = None) -> DataFrame:
    """docs, with its columns and order of columns, text holding surrogates; count_out: a further column with the number of values replaced.

    A null text stays null (0 values), an empty one empty. Repeated rows get
    the same text. Two passes over the texts and no shuffle of them, unless
    more than BROADCAST_REDRAWN values had to be drawn again. An empty table
    gives no rows. An error if surrogates cannot be told apart, see
    ``redrawn_values``.
    """
    keyed = Keyed(key)
    redrawn = redrawn_values(docs, keyed, text)
    kept = docs.drop(count_out) if count_out else docs
    told: dict[tuple[str, bytes], int] = {}
    few = redrawn.count() <= BROADCAST_REDRAWN
    columns = kept.columns
    if few:
        told = {(r.kind, bytes(r.sealed)): r.attempt for r in redrawn.collect()}
        drop_stash(redrawn)
    else:  # each row brings the draws of its own values, found by a digest of the text
        own_mark, draws = unused("__mark", columns), unused("__draws", columns)
        mark = F.unhex(F.sha2(F.col(text).cast("string"), 256))
        held = _values(docs.select(mark.alias("mark"), F.col(text).alias("text")), keyed).distinct()
        own = held.join(redrawn, ["kind", "sealed"]).groupBy("mark").agg(F.collect_list(F.struct("kind", "sealed", "attempt")).alias(draws))
        kept = kept.withColumn(own_mark, mark).join(own.withColumnRenamed("mark", own_mark), own_mark, "left").select(*columns, draws)
    at, draws_at = columns.index(text), None if few else len(columns)
    fields = kept.select(*columns).schema
    result = extended(fields, **{count_out: "long"}) if count_out else fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                new, counts = [], []
                brought = piece.column(draws_at).to_pylist() if draws_at is not None else [None] * piece.num_rows
                for t, own in zip(piece.column(at).to_pylist(), brought, strict=True):
                    t, n = (t, 0) if t is None else replace(t, keyed, told if own is None else {(d["kind"], d["sealed"]): d["attempt"] for d in own})
                    new.append(t)
                    counts.append(n)
                out = [pa.array(new, pa.string()) if k == at else c for k, c in enumerate(piece.columns) if k != draws_at]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(counts, pa.int64())] if count_out else []), result.names)

    return kept.mapInArrow(run, result)
