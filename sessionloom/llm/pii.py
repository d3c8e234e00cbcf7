"""Personal information in free text: find it, replace it with typed pseudonyms.

Detection is by format and check digits; where a format alone proves nothing, a
cue word must stand before it. People's names have no format: their parts are
learned over the whole corpus from places where they are certain (mailbox names
of the form first.last, signatures, titles), and two adjacent capitalised words
are a name where both are such parts. A name with a title or in a signature is
one in its own record, whoever else vouches for it.

Each finding becomes ``[type:pseudonym]``. The pseudonym is a keyed permutation
of the value in its canonical spelling that keeps its format, so one number,
date or person has one pseudonym in all documents. A number with check digits
is permuted among those whose check holds, a date among the days of its century.

An Italian tax code is known by its shape (month letter and day must exist), not
by its last letter: of the 102 codes in the test tables at 0.1 that letter fails
for 99, and a mistyped code tells as much about its owner.
"""

from __future__ import annotations

import datetime
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom import runtime
from sessionloom.llm.pseudonyms import permute, pseudonym

TYPES = ("email", "phone", "national_id", "street_address", "person_name", "birth_date")
#: Of overlapping findings the earlier type wins: a name inside a mailbox or a street isn't a person.
PRECEDENCE = ("email", "national_id", "phone", "birth_date", "street_address", "person_name")
#: Name parts up to this number are sent to every task (some 4 MB); more are joined to the texts instead.
LEXICON_ROWS = 200_000
#: A part counts as learned where so many records vouch for it.
MIN_RECORDS = 2

# Words and codes of the formats.
TITLES = "Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Ing|Sig|Sig\\.ra|Sigra|Dott|Dott\\.ssa|Avv|Frau|Herr|Herrn|Sr|Sra|Srta|Don|Doña"
US_STREET = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Row|Place|Pl|Square|Sq|Terrace|Ter|Way|Circle|Cir|Parkway|Pkwy|Highway|Hwy|Close|Crescent|Gardens|Mews|Walk|Hill|Alley|Quay"
IT_STREET = "Via|Viale|Corso|Piazza|Piazzale|Piazzetta|Vicolo|Largo|Strada|Lungomare|Lungarno|Lungotevere|Contrada|Borgo|Salita|Traversa"
ES_STREET = "Calle|C/|Plaza|Avenida|Avda\\.?|Paseo|Ronda|Camino|Carrer|Carretera|Travesía|Glorieta|Callejón"
DE_ENDING = "straße|strasse|str\\.|gasse|weg|allee|platz|ring|damm|ufer|steig|pfad|chaussee|graben|markt|hof|berg"
ROLES = "info admin support sales team dev ops help contact office news mail service bot hr it jobs no not do reply noreply post web root git user test data the and"
TWO_DIGIT_COUNTRIES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
MONTHS = [  # by language, whole and short
    "january february march april may june july august september october november december", "jan feb mar apr may jun jul aug sep oct nov dec",
    "januar februar märz april mai juni juli august september oktober november dezember", "jän feb mär apr mai jun jul aug sept okt nov dez",
    "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre", "gen feb mar apr mag giu lug ago set ott nov dic",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre", "ene feb mar abr may jun jul ago sept oct nov dic",
]
BIRTH_CUE = r"(?:(?:date of )?birth(?:date|day)?|born(?: on)?|d\.?o\.?b\.?|geburtsdatum|geboren(?: am)?|geb\.|data di nascita|nat[oa] il|fecha de nacimiento|nacid[oa] el)"
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
ODD_CODES = dict(zip("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]))
ID_CUE = r"(?:passport|passnummer|reisepass|passaporto|pasaporte|personalausweis|ausweis(?:nummer|nr)?|identity card|id card|carta d['’]identità|documento d['’]identità|c\.i\.)(?:\s*(?:no|nr|n|num|number|n°|nº|numero|número))?\.?\s*:?\s*"
TAX_CUE = r"(?:steuer-?id(?:nr|entifikationsnummer)?|idnr|tin|tax id|codice fiscale|c\.f\.|dni|nie|nif|ssn|social security(?: number)?|nino|national insurance(?: number)?)(?:\s*(?:no|nr|number))?\.?\s*:?\s*"

_AT = r"(?:[@＠]|&#64;|\s{0,2}[\[({<]\s?(?:at|a|chiocciola|arroba|@)\s?[\])}>]\s{0,2})"
_DOT = r"(?:\.|\s{0,2}[\[({<]\s?(?:dot|punto|punkt|\.)\s?[\])}>]\s{0,2})"
_EMAIL = re.compile(
    rf"(?<![\w.%+/-])[A-Za-z0-9](?:[A-Za-z0-9_%+'-]|\.(?=[A-Za-z0-9]))*{_AT}(?!v?\d+\.)[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9_-])(?!:[\w~/])",
    re.I,
)
_SPOKEN = re.compile(r"(?<![\w.@])[A-Za-z0-9][\w.+-]* (?:at|AT|chiocciola|arroba) [A-Za-z0-9-]+(?: (?:dot|DOT|punto) [A-Za-z0-9-]+)* (?:dot|DOT|punto) [A-Za-z]{2,24}(?!\w)")
_PHONE = re.compile(
    r"(?<![\w+.,:/#=-])(?:"
    r"\+\d{1,3}(?:[ .\-/]?\(\d{1,4}\))?(?:[ .\-/]?\d{1,5}){2,6}"
    r"|00[1-9]\d{0,2}[ .\-/](?:\(\d{1,4}\)[ .\-/]?)?\d{1,5}(?:[ .\-/]\d{2,5}){1,5}"
    r"|\(0?\d{2,4}\)[ .\-/]?\d{3,5}[ .\-/]?\d{3,5}"
    r"|[2-9]\d{2}[.\- ]\d{3}[.\- ]\d{4}"
    r"|0\d{1,4}[ /\-]\d{3,5}(?:[ \-]\d{2,5}){0,3}"
    r")(?![\w/]|[.\-:]\d|@)"
)
_CUED_PHONE = re.compile(r"(?i)\b(?:tel|phone|mobile|cell|fax|telefono|telefon|cellulare|móvil|handy|numero|nummer|teléfono)\b\.?[ :]{1,3}(\d[\d .\-/]{6,16}\d)(?![\w/])")
_ID = re.compile(
    r"(?<![\w+/.-])(?:"
    r"(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<dni>\d{8}[- ]?[A-Z])|(?P<nie>[XYZ]-?\d{7}[- ]?[A-Z])"
    r"|(?P<cf>[A-Z]{6}\d[\dLMNP-V][A-EHLMPRST][\dLMNP-V]{2}[A-Z][\dLMNP-V]{3}[A-Z])"
    r"|(?P<steuer>\d{2} \d{3} \d{3} \d{3})"
    r"|(?P<nino>[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])"
    r")(?![\w/+=]|-\d|\.\d)"
)
_CUED_ID = re.compile(rf"(?i:\b(?:{ID_CUE}|{TAX_CUE}))(?P<v>[A-Z]{{0,3}}[- ]?\d(?:[ ./-]?[A-Z0-9]){{5,15}})(?![A-Za-z0-9])")
#: What the patterns of numbers need at least; a text without it is spared them.
_DATE_FORM = r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{1,2}(?:\.|st|nd|rd|th|º)? (?:de |of )?[^\W\d_]{3,10}\.? (?:de |del )?\d{4}|[^\W\d_]{3,10}\.? \d{1,2}(?:st|nd|rd|th)?,? \d{4})"
_BIRTH = re.compile(rf"(?i)\b{BIRTH_CUE}[\s:,=]{{1,3}}(?P<v>{_DATE_FORM})(?!\w)")
#: Every cue before a birth date, in lower case, has one of these.
_BIRTH_HINTS = ("birth", "born", "dob", "d.o", "do.b", "gebo", "geburts", "geb.", "nascita", "nato il", "nata il", "nacimiento", "nacido el", "nacida el")
_DATE_PART = re.compile(r"\d+|[^\W\d_]{3,10}")
_SEVEN_DIGITS = re.compile(r"\d(?:[ .\-/()]{0,3}\d){6}")
_ID_CORE = re.compile(r"[A-Z]{2} ?\d\d ?\d\d ?\d\d|[A-Z]{6}\d")
_CUED_CORE = re.compile(r"\d(?:[ ./-]?[A-Z0-9]){5}")
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’]*"
_PLACE = rf"{_CAP}(?:[ -](?:{_CAP}|(?:am|an|im|in|der|de|del|di|la|da|sul|sur|upon|on)\b))*"
_SEP = r"\s*,?\s+"
_ADDRESS = re.compile(
    r"(?<![\w/#.-])(?:"
    # number, name, kind of street; then a flat, or a place with a code
    rf"\d{{1,5}}[A-Za-z]?,? (?:{_CAP} ){{1,4}}(?:{US_STREET})\b\.?(?:,?\s+(?:Apt|Suite|Ste|Unit|Flat|Floor|#)\.? ?[\w-]+)?,\s+{_PLACE},?\s+(?:[A-Z]{{2}} \d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}}|\d{{5}})\b"
    rf"|\d{{1,5}}[A-Za-z]?,? (?:{_CAP} ){{1,4}}(?:{US_STREET})\b\.?,?\s+(?:Apt|Suite|Ste|Unit|Flat)\.? ?[\w-]+"
    rf"|(?:{IT_STREET}) (?:(?:de(?:l|lla|lle|i|gli|ll['’])|di|da|San|Santa|Santo|Sant['’])? ?{_CAP} ?){{1,4}},? ?\d{{1,5}}(?:[/ ]?[A-Za-z]\b)?(?:, (?:interno|int\.|scala|piano) \w+)*(?:{_SEP}\d{{5}}\s+{_PLACE}|, {_PLACE})?"
    rf"|(?:{ES_STREET}) (?:(?:de|del|la|las|los|el|de la|de los|de las) )*(?:{_CAP} ?){{1,4}}(?:(?:de|del|la|las|los) )*(?:{_CAP} ?)*,? ?(?:n\.?º ?)?\d{{1,5}}(?:, \d{{1,3}}\.?[ºª°](?: ?[A-Z]\b)?)?(?:{_SEP}\d{{5}}\s+{_PLACE})?"
    rf"|(?:{_CAP}[- ])?[A-ZÄÖÜ][\wäöüß-]*(?:{DE_ENDING}) \d{{1,4}} ?[a-z]?\b(?:{_SEP}\d{{5}}\s+{_PLACE})"
    rf"|(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den|Alte|Neue|Große|Kleine|Hinter der) {_CAP}(?: {_CAP})* \d{{1,4}} ?[a-z]?\b(?:{_SEP}\d{{5}}\s+{_PLACE})"
    rf"|(?:P\.? ?O\.? ?Box|Post Office Box|Postfach|Casella [Pp]ostale|C\.P\.|Apartado(?: de [Cc]orreos)?|Apdo\.?) \d{{1,6}}(?:{_SEP}\d{{5}}\s+{_PLACE}|,\s+{_PLACE},?\s+(?:[A-Z]{{2}} \d{{5}}|[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}})\b|,\s+{_PLACE})?"
    r")"
)
#: Every text with an address has this; a text without it is spared the pattern.
_ADDRESS_HINT = re.compile(rf"\d[A-Za-z]?,? (?:{_CAP} ){{1,4}}(?:{US_STREET})\b|\b(?:{IT_STREET}|{ES_STREET}) |(?:{DE_ENDING}) \d|\b(?:Am|An|Auf|Im|In|Zum|Zur|Unter|Alte|Neue|Große|Kleine|Hinter) (?:de[rnm] )?{_CAP}(?: {_CAP})* \d|[Bb]ox \d|Postfach|[Pp]ostale|C\.P\.|Apartado|Apdo")
_WORD = r"[A-ZÀ-ÖØ-Þ](?:['’][A-ZÀ-Þ])?[a-zà-öø-ÿ]+(?:[A-Z][a-z]+)?|[A-ZÀ-Þ]{2,}"
_CAPS = re.compile(rf"\b(?:{_WORD})\b")
_NAME = re.compile(
    rf"(?<![\w@.])(?:(?:{TITLES})\.? )?(?=[A-ZÀ-Þ])(?P<a>{_WORD})(?P<mid>(?: [A-ZÀ-Þ]\.){{0,2}} |, )(?P<b>(?:{_WORD})(?:-(?:{_WORD}))?)(?![\w@])|(?<![\w@.])(?P<c>(?:{_WORD})-(?:{_WORD})), (?P<d>{_WORD})(?![\w@])"
)
_PART = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+"
#: Certain places of a name, as the JVM's expressions: groups 1 and 2 are the parts.
ANCHORS = (
    r"(?i)(?<![\w.])([a-z]{2,})[._-]([a-z]{2,})(?:\+\w+)?\s{0,2}(?:@|[\[(]at[\])])\s{0,2}[a-z][a-z0-9-]*\s{0,2}(?:\.|[\[(]dot[\])])\s{0,2}[a-z]{2}",
    rf"(?m)^-- ?\n(?:(?:{TITLES})\.? )?({_PART})(?: \p{{Lu}}\.)?,? ({_PART})(?:-\p{{Lu}}\p{{Ll}}+)?$",
    rf"\b(?:{TITLES})\.? ({_PART})(?: \p{{Lu}}\.)? ({_PART})\b",
)
#: Every title begins with one of these, and every signature with one of the last two.
_OWN_HINTS = ("Mr", "Ms", "Mx", "Miss", "Dr", "Prof", "Ing", "Sig", "Dott", "Avv", "Frau", "Herr", "Sr", "Do", "-- \n", "--\n")
#: The same signatures and titles within one record, in Python's spelling.
_OWN = re.compile(rf"^-- ?\n(?:(?:{TITLES})\.? )?(?P<a>{_WORD})(?: [A-ZÀ-Þ]\.)?,? (?P<b>{_WORD})(?:-(?P<c>{_WORD}))?$|\b(?:{TITLES})\.? (?P<d>{_WORD})(?: [A-ZÀ-Þ]\.)? (?P<e>{_WORD})(?:-(?P<f>{_WORD}))?(?!\w)", re.M)


def fold(text: str) -> str:
    """Without accents, case and apostrophes: a mailbox spells O'Connor oconnor."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and c not in "'’").casefold()


def dni_letter(v: str) -> str:
    return DNI_LETTERS[int({"X": "0", "Y": "1", "Z": "2"}.get(v[0], v[0]) + v[1:-1]) % 23]


def valid_dni(v: str) -> bool:
    v = re.sub(r"[- ]", "", v)
    return dni_letter(v) == v[-1]


def steuer_digit(v: str) -> str:
    """The check digit of ISO 7064, mod 11, 10, for the first ten digits."""
    product = 10
    for d in map(int, v[:10]):
        product = ((d + product) % 10 or 10) * 2 % 11
    return str((11 - product) % 10)


def valid_steuer(v: str) -> bool:
    digits = "".join(c for c in v if c.isdigit())
    return len(digits) == 11 and digits[0] != "0" and steuer_digit(digits) == digits[10]


def cf_letter(v: str) -> str:
    return chr(65 + sum(ODD_CODES[c] if i % 2 == 0 else (int(c) if c.isdigit() else ord(c) - 65) for i, c in enumerate(v[:15])) % 26)


def plausible_cf(v: str) -> bool:
    """Whether the shape holds and the day exists; letters stand for digits where two people's codes were equal."""
    digit = lambda c: c if c.isdigit() else str("LMNPQRSTUV".index(c))
    return bool(_CF.fullmatch(v)) and 1 <= int(digit(v[9]) + digit(v[10])) % 40 <= 31 and int(digit(v[9])) < 8


def issuable_ssn(v: str) -> bool:
    """Area, group and serial that are no blanks; areas from 900 are those of taxpayer numbers."""
    d = re.sub(r"\D", "", v)
    return len(d) == 9 and d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000"


def _plausible_phone(v: str) -> bool:
    return 8 <= sum(c.isdigit() for c in v) <= 15


class _Schemes:
    """Whether a position lies in the authority of a URL such as ssh://user@host, by one pass over the text."""

    def __init__(self, text: str):
        self.at = [m.start() for m in re.finditer("://", text)]
        self.gaps = [m.start() for m in re.finditer(r"[\s<>\"']", text)] if self.at else []

    def before(self, at: int) -> bool:
        i = bisect_left(self.at, at) - 1
        if i < 0:
            return False
        j = bisect_left(self.gaps, at) - 1
        return j < 0 or self.gaps[j] < self.at[i]


def date_of(text: str, day_first: bool = True) -> tuple[datetime.date, list[tuple[int, int, str]]] | None:
    """The day that a date names, and its parts (start, stop, y, m, d or name); None where there is no such day.

    Of two numbers that may both be months the first is the day where ``day_first``.
    """
    parts = [(m.start(), m.end(), m.group()) for m in _DATE_PART.finditer(text)]
    named = [(i, n) for i, (_, _, w) in enumerate(parts) if (n := _MONTH_NUMBERS.get(w.lower().rstrip("."))) and not w.isdigit()]
    numbers = [i for i, p in enumerate(parts) if p[2].isdigit()]
    if named and len(numbers) == 2:
        roles = {named[0][0]: "name", numbers[0]: "d", numbers[1]: "y"}
    elif len(numbers) == 3:
        if len(parts[numbers[0]][2]) == 4:
            order = "ymd"
        else:
            a, b = (int(parts[i][2]) for i in numbers[:2])
            order = "dmy" if a > 12 or b <= 12 and day_first else "mdy"
        roles = dict(zip(numbers, order))
    else:
        return None
    value = {r: named[0][1] if r == "name" else int(parts[i][2]) for i, r in roles.items()}
    try:
        day = datetime.date(value["y"], value.get("m") or value["name"], value["d"])
    except ValueError:
        return None
    return day, [(*parts[i][:2], r) for i, r in roles.items()]


_MONTH_NUMBERS = {w: n for words in MONTHS for n, w in enumerate(words.split(), 1)}
_CF = re.compile(r"[A-Z]{6}[\dLMNP-V]{2}[A-EHLMPRST][\dLMNP-V]{2}[A-Z][\dLMNP-V]{3}[A-Z]")


def spans(text: str, parts) -> list[tuple[int, int, str, str]]:
    """The findings (start, end, type, canonical value), without overlaps, in order.

    ``parts`` are folded name parts. Overlaps are settled by ``PRECEDENCE``.
    """
    found: list[tuple[int, int, str, str]] = []
    if "@" in text or "[" in text or "(" in text or "{" in text or "＠" in text or "&#64;" in text:
        schemes = _Schemes(text)
        for m in _EMAIL.finditer(text):
            if not schemes.before(m.start()):
                v = re.sub(_AT, "@", m.group(), count=1, flags=re.I)
                found.append((m.start(), m.end(), "email", re.sub(_DOT, ".", v, flags=re.I).lower()))
    if " dot " in text or " DOT " in text or " punto " in text:
        for m in _SPOKEN.finditer(text):
            v = re.sub(r" (?:dot|punto) ", ".", m.group().lower())
            found.append((m.start(), m.end(), "email", re.sub(r" (?:at|chiocciola|arroba) ", "@", v)))
    long_number = _SEVEN_DIGITS.search(text)
    if long_number:
        for m in _PHONE.finditer(text):
            if _plausible_phone(m.group()):
                found.append((m.start(), m.end(), "phone", m.group()))
        for m in _CUED_PHONE.finditer(text):
            if sum(c.isdigit() for c in m.group(1)) >= 7:
                found.append((m.start(1), m.end(1), "phone", m.group(1)))
    if long_number or _ID_CORE.search(text):
        for m in _ID.finditer(text):
            kind, v = m.lastgroup, m.group()
            if _CHECKS[kind](v):
                found.append((m.start(), m.end(), "national_id", v))
    if _CUED_CORE.search(text):
        for m in _CUED_ID.finditer(text):
            v = m.group("v").rstrip(" .-/")
            if sum(c.isdigit() for c in v) >= 5:
                found.append((m.start("v"), m.start("v") + len(v), "national_id", v))
    low = text.lower()
    if any(map(low.__contains__, _BIRTH_HINTS)):
        for m in _BIRTH.finditer(text):
            if date_of(m["v"]):
                found.append((m.start("v"), m.end("v"), "birth_date", m["v"]))
    if _ADDRESS_HINT.search(text):
        for m in _ADDRESS.finditer(text):
            v = m.group().rstrip(" ,\n")
            found.append((m.start(), m.start() + len(v), "street_address", v))
    if any(map(text.__contains__, _OWN_HINTS)):
        own = {fold(x) for m in _OWN.finditer(text) for g in m.groups() if g for x in g.split("-")}
        parts = parts | own if parts else own
    if parts:
        words = _CAPS.findall(text)
        if len(words) > 1 and sum(fold(w) in parts for w in words) > 1:
            at = 0
            while m := _NAME.search(text, at):
                a, b = (m["a"], m["b"]) if m["a"] else (m["c"], m["d"])
                if all(fold(x) in parts for x in (*a.split("-"), *b.split("-"))):
                    first, last = (b, a) if m["c"] or m["mid"] == ", " else (a, b)
                    found.append((m.start(), m.end(), "person_name", f"{first} {last}"))
                    at = m.end()
                else:
                    at = m.start("b") if m["a"] else m.start("d")
    if len(found) < 2:
        return found
    rank = {t: i for i, t in enumerate(PRECEDENCE)}
    kept: list[tuple[int, int, str, str]] = []
    for s in sorted(found, key=lambda x: (rank[x[2]], x[0] - x[1], x[0])):
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


#: What each kind of identity number must fulfil besides its pattern.
_CHECKS: dict[str, Callable[[str], bool]] = {"ssn": issuable_ssn, "nino": lambda v: True, "dni": valid_dni, "nie": valid_dni, "steuer": valid_steuer, "cf": plausible_cf}


def _walked(step: Callable[[str], str], value: str, same: Callable[[str], object]) -> str:
    """``step`` until ``same`` is again what it is of ``value``: a permutation of the values of that kind."""
    want, new = same(value), step(value)
    while same(new) != want:
        new = step(new)
    return new


def id_pseudonym(key: bytes, core: str) -> str:
    """An identity number (no separators, capitals) of the same kind; one whose check holds gets one whose check holds."""
    plain = lambda v: pseudonym(key, "national_id", v)
    if re.fullmatch(r"(?:\d{8}|[XYZ]\d{7})[A-Z]", core) and dni_letter(core) == core[-1]:
        at = 0 if core[0].isdigit() else 1
        new = core[:at] + plain(core[at:8])
        return new + dni_letter(new + "A")
    if re.fullmatch(r"\d{11}", core) and valid_steuer(core):
        new = _walked(plain, core[:10], lambda v: v[0] != "0")
        return new + steuer_digit(new)
    if re.fullmatch(r"\d{9}", core):
        return _walked(plain, core, issuable_ssn)
    if _CF.fullmatch(core) and plausible_cf(core):
        if cf_letter(core) == core[15]:
            new = _walked(plain, core[:15], lambda v: plausible_cf(v + "A"))
            return new + cf_letter(new)
        return _walked(plain, core, lambda v: plausible_cf(v) and cf_letter(v) != v[15])
    if _NINO.fullmatch(core):
        return _walked(plain, core, lambda v: bool(_NINO.fullmatch(v)))
    return plain(core)


_NINO = re.compile(r"[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]")


def phone_pseudonym(key: bytes, digits: str, abroad: bool) -> str:
    """A number (digits alone) with the same country code; the first digit after it stays a zero, a one or neither."""
    at = 0
    if abroad:
        at = 1 if digits[:1] in "17" else 2 if digits[:2] in TWO_DIGIT_COUNTRIES.split() else 3
    first = lambda v: min(int(v[:1] or 0), 2)
    return digits[:at] + _walked(lambda v: pseudonym(key, "phone", v), digits[at:], first)


def date_pseudonym(key: bytes, text: str) -> str:
    """The date of another day of the same century, in the same spelling."""
    found = date_of(text)
    if found is None:
        return pseudonym(key, "birth_date", text)
    day, parts = found
    start = datetime.date(max(day.year // 100 * 100, 1), 1, 1)
    n_days = (datetime.date(day.year // 100 * 100 + 100, 1, 1) - start).days if day.year < 9900 else (datetime.date.max - start).days
    n = (day - start).days
    while True:
        n = permute(key, f"date{start.year}".encode(), n, 10, 5)
        if n < n_days:
            break
    new, out = start + datetime.timedelta(n), text
    for a, b, role in sorted(parts, reverse=True):
        word = text[a:b]
        if role == "name":
            shown = next(words for words in map(str.split, MONTHS) if words[day.month - 1] == word.lower())[new.month - 1]
            out = out[:a] + (shown.title() if word[0].isupper() else shown) + out[b:]
        else:
            number = {"y": new.year, "m": new.month, "d": new.day}[role]
            out = out[:a] + str(number).zfill(len(word)) + out[b:]
    return out


def placeholder(kind: str, value: str, key: bytes) -> str:
    """``[type:pseudonym]``. Phones and identity numbers permute their characters in place, dates their day."""
    if kind == "birth_date":
        return f"[{kind}:{date_pseudonym(key, value)}]"
    if kind in ("phone", "national_id"):
        # The digits decide, so one number has one pseudonym in every spelling of it.
        core = re.sub(r"[^0-9A-Za-z]", "", value).upper()
        if kind == "phone":
            abroad = value.lstrip().startswith("+") or core.startswith("00")
            if core.startswith("00"):
                core, value = core[2:], re.sub(r"0", "", value, count=2)
            new = iter(phone_pseudonym(key, core, abroad))
        else:
            new = iter(id_pseudonym(key, core))
        return f"[{kind}:{''.join(next(new) if c.isalnum() else c for c in value)}]"
    plain = "".join(c for c in unicodedata.normalize("NFKD", " ".join(value.split())) if not unicodedata.combining(c))
    return f"[{kind}:{pseudonym(key, kind, plain.title() if kind == 'person_name' else plain)}]"


def replace(text: str, parts, key: bytes) -> tuple[str, list[tuple[str, int, int, str]]]:
    out, at, log = [], 0, []
    for start, end, kind, value in spans(text, parts):
        tag = placeholder(kind, value, key)
        out += [text[at:start], tag]
        log.append((kind, start, end, tag))
        at = end
    out.append(text[at:])
    return "".join(out), log


_RESULT = "struct<redacted string, findings array<struct<pii_type string, start int, stop int, placeholder string>>>"


def _folded():
    """An expression's function that folds an array of words, without words that name a mailbox's role."""
    roles = frozenset(ROLES.split())

    @F.pandas_udf("array<string>")
    def folded(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else [f for x in w if (f := fold(x)) not in roles])

    return folded


def name_parts(texts: DataFrame, text: str, min_records: int = MIN_RECORDS) -> DataFrame:
    """The folded name parts (column ``part``) that the anchors of all texts vouch for."""
    runtime.require_columns(texts, text)
    t = F.col(f"`{text}`")
    groups = [F.regexp_extract_all(t, F.lit(p), F.lit(g)) for p in ANCHORS for g in (1, 2)]
    seen = texts.where(t.rlike(r"@|(?i)[\[(]at[\])]|\n?-- ?\n") | t.rlike(rf"\b(?:{TITLES})\b")).select(F.flatten(F.array(*groups)).alias("found")).where(F.size("found") > 0)
    seen = seen.select(F.explode(F.array_distinct(_folded()("found"))).alias("part"))
    return seen.groupBy("part").count().where(F.col("count") >= min_records).select("part")


def pseudonymise(rows: DataFrame, text: str, key: bytes, parts: DataFrame, record: str | None = None, lexicon_rows: int = LEXICON_ROWS) -> DataFrame:
    """``rows`` with the column ``pii``: ``redacted`` text and ``findings``.

    ``parts`` is the result of ``name_parts``. Up to ``lexicon_rows`` of them
    are broadcast; beyond that each record's words are joined with them by
    ``record``, the name of a column that is unique by row or by text (by
    default the text's hash). Both ways fold words and parts alike and find the
    same. A null text has null in both
    fields, an empty one stays empty without findings. All rows and columns
    come back, repeated rows each; a column named ``pii`` is replaced.
    """
    runtime.require_columns(rows, text)
    spark, rows = rows.sparkSession, rows.drop("pii")
    some = parts.limit(lexicon_rows + 1).toPandas()["part"]
    if len(some) <= lexicon_rows:
        shared = spark.sparkContext.broadcast(frozenset(fold(p) for p in some))

        @F.pandas_udf(_RESULT)
        def scan(texts: pd.Series) -> pd.DataFrame:
            known = shared.value
            return _frame([replace(t, known, key) if isinstance(t, str) else None for t in texts])

        return rows.withColumn("pii", scan.asNondeterministic()(F.col(f"`{text}`").cast("string")))

    @F.pandas_udf(_RESULT)
    def scan_own(texts: pd.Series, known: pd.Series) -> pd.DataFrame:
        return _frame([replace(t, frozenset(k) if k is not None else (), key) if isinstance(t, str) else None for t, k in zip(texts, known)])

    @F.pandas_udf("array<string>")
    def capitalised(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({fold(w) for w in _CAPS.findall(t)}) if isinstance(t, str) else None)

    t = F.col(f"`{text}`").cast("string")
    rec = F.md5(t) if record is None else F.col(f"`{record}`")
    some_text, none = rows.where(t.isNotNull()).withColumn("__own", rec), rows.where(t.isNull())
    words = some_text.select(F.col("__own").alias("__rec"), F.explode(capitalised(t)).alias("part"))
    folded = parts.select(F.explode(_folded()(F.array("part"))).alias("part")).distinct()
    own = words.join(folded, "part", "left_semi").groupBy("__rec").agg(F.collect_set("part").alias("__parts"))
    found = some_text.join(own, F.col("__own") == F.col("__rec"), "left").withColumn("pii", scan_own.asNondeterministic()(t, "__parts"))
    # Null texts would all meet in one task of the join.
    return found.drop("__rec", "__parts", "__own").unionByName(none.withColumn("pii", F.struct(F.lit(None).cast("string").alias("redacted"), F.lit(None).alias("findings")).cast(_RESULT)))


def _frame(results: list) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "redacted": [None if r is None else r[0] for r in results],
            "findings": [None if r is None else [dict(zip(("pii_type", "start", "stop", "placeholder"), x)) for x in r[1]] for r in results],
        }
    )


def types_found() -> Column:
    return F.array_distinct(F.col("pii.findings.pii_type"))
