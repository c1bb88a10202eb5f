"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans beside them.

The patterns give emails, internet addresses, card numbers and international phone numbers. The field reads the whole text
and adds local phone numbers, bank account numbers, identity numbers, names, street addresses and credentials. It scores
candidate segments of up to LONGEST tokens (a token is a run of letters and digits, or a sign) by features of the whole span:
its shape, groups of digits, check digits, known words, the words before it. A dynamic program over segments chooses
boundaries and types jointly. Each type has a form (``forms``) that its spans must have, so that a text falls into regions
outside of which no candidate lies; these are all scored, whole. Spans of the patterns are kept as they are, and no added span overlaps them.

The weights are fitted by maximum likelihood (forward and backward sums over segmentations) on generated sentences, half of
them look-alikes without personal data, as no labelled spans are given; the generator is seeded, so that every fit is the same.

Edge cases: null text counts as empty; empty text has no spans; texts are scanned whole. A region of any length is
taken in windows of WINDOW tokens, each decided up to where all segmentations agree, so memory doesn't grow with it and the
result is that of the whole. Ties between segmentations go to the one found first (shorter segments, earlier types).
A span of the field lies on one line. Extra columns don't take part; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.common import doc_columns, ship, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "iban", "id_number", "name", "address", "credential")
KINDS = BASE + ADDED
RANK = {k: i for i, k in enumerate(KINDS)}
LONGEST = 12
WINDOW = 2048

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
TITLES = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "monsieur", "madame", "señor", "señora")
STREETS = ("street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "drive", "boulevard", "blvd", "court", "square", "way", "rue", "calle", "plaza", "via", "platz", "weg", "allee", "gasse")
STREET_ENDS = ("strasse", "straße", "str", "weg", "gasse", "platz", "allee")
PARTICLES = ("de", "la", "del", "du", "des", "von", "van", "der", "den", "di", "da", "le", "el", "al", "bin", "bint", "ibn", "dos", "das", "do", "ter", "zu", "af", "av")
CUES = {
    "phone": ("call", "phone", "tel", "telephone", "mobile", "fax", "cell", "dial", "text"),
    "id": ("ssn", "passport", "social", "security", "licence", "license", "taxpayer", "identity"),
    "account": ("account", "iban", "bank", "transfer", "konto", "cuenta", "compte"),
    "name": ("by", "with", "from", "and", "to", "for", "von", "por", "par"),
    "person": ("name", "names", "called", "named", "contact", "dear", "signed", "author", "patient", "regards", "sincerely", "ask", "surname", "employee", "colleague", "nurse", "doctor", "attn", "cc", "hello", "hi", "told", "met", "nombre", "nom", "heißt", "heiße", "llamo", "appelle"),
    "place": ("at", "address", "lives", "live", "in", "visit", "ship", "wohnt", "home"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "key", "pin", "passphrase", "apikey", "auth", "credential"),
    "other": ("version", "release", "isbn", "commit", "sha256", "sha1", "md5", "checksum", "digest", "hash", "uuid", "order", "invoice", "page", "chapter", "section", "figure", "table", "revision", "build", "serial", "model", "room", "the", "of"),
}
CUE_OF = {w: k for k, words in CUES.items() for w in words}
#: Given names (without accents) that are a feature of names; a name needs none of them.
GIVEN = frozenset("james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul steven andrew peter george edward brian kevin henry simon adam alan oscar martin mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret sandra emily emma olivia laura alice julia anna clara eva rosa maria carmen lucia elena sofia pablo pedro juan carlos luis miguel jorge diego marta ana pierre jean jacques louis michel claire sophie camille julien antoine marie hans klaus jurgen wolfgang stefan andreas thomas sabine petra ursula greta heidi ingrid lena jonas felix max otto karl".split())
UPPER = r"[^\W\d_a-zß-öø-ÿ]"
WORD = UPPER + r"[^\W\d_]*(?:['’-]" + UPPER + r"[^\W\d_]*)?"
PART = "(?:" + "|".join(PARTICLES) + ")"
#: Where a candidate of some type can lie: digits or capitalised words in a row, with what may stand between them.
REGION = re.compile(
    rf"(?:(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*+[0-9])[A-Za-z0-9+/_.=-]{{8,}}|(?<![^\W_])(?:\(?[0-9][^\W_]*|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]*|[^\W_]*[0-9][^\W_]*|{WORD}(?=\.? (?:{PART} )*[^\W_a-zß-öø-ÿ])|(?<=[ '\":=]){WORD}))"
    rf"(?:[ .,()/'’_:+=&-]{{1,3}}(?:{PART} )*(?:[0-9][^\W_]*|{WORD}\.?|[^\W_]*[0-9][^\W_]*))*+"
)
DIGITS = re.compile(r"\(?[0-9]+(?:[ ()./-]{1,2}[0-9]+)+|[0-9]{6,15}")
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}")
NAMES = re.compile(rf"{WORD}(?:(?:\.? {PART}){{0,2}}\.? {WORD}){{0,3}}")
ADDRESS = re.compile(rf"[0-9]{{1,5}}[A-Za-z]?,? (?:{PART} )*{WORD}(?: (?:{PART} )*{WORD}){{0,6}}|{WORD}(?: (?:{PART} )*{WORD}){{0,5}} [0-9]{{1,5}}[A-Za-z]?")
CREDENTIAL = re.compile(r"(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{8,}+")
IDENTITY = re.compile(r"(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{7,12}")
NUMERALS = str.maketrans("0123456789", "9999999999")
#: Forms and features of spans of digits alone, by what they follow from; emptied when full.
SHAPES: dict[tuple, tuple] = {}


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The spans of the fixed patterns as (start, end, kind), by start, then kind."""
    out: list[tuple[int, int, str]] = []
    at, done = text.find("@"), 0
    while at >= 0:  # every match holds exactly one such sign, so they are gone through in order
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        if "." in text:
            for m in IP.finditer(text):
                if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
                    out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], RANK[s[2]]))


def forms(s: str) -> tuple[int, ...]:
    """The types (places in Field.TYPES) whose form a span has."""
    out = []
    if DIGITS.fullmatch(s) and 6 <= sum("0" <= c <= "9" for c in s) <= 15:
        out += [1, 3]
    if ACCOUNT.fullmatch(s):
        out.append(2)
    if NAMES.fullmatch(s):
        out.append(4)
    if ADDRESS.fullmatch(s):
        out.append(5)
    if CREDENTIAL.fullmatch(s):
        out.append(6)
    if IDENTITY.fullmatch(s):
        out.insert(0, 3)
    return tuple(out)


def kept(key: tuple, make: Callable[[], tuple]) -> tuple:
    """make(), once for each key as long as there is room."""
    found = SHAPES.get(key)
    if found is None:
        if len(SHAPES) > 50_000:
            SHAPES.clear()
        SHAPES[key] = found = make()
    return found


def plain_name(w: str) -> str:
    """A word in lower case without accents."""
    low = w.lower()
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))


def mod97(s: str) -> bool:
    """Whether the check digits of an account number hold."""
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Tokens:
    """Tokens of a stretch of text with offsets. What stands before a token is looked up in the text, so windows have no edges."""

    def __init__(self, text: str, begin: int = 0, end: int | None = None, most: int | None = None):
        self.text, self.words, self.start, self.end = text, [], [], []
        for m in TOKEN.finditer(text, begin, len(text) if end is None else end):
            self.words.append(m.group())
            self.start.append(m.start())
            self.end.append(m.end())
            if len(self.words) == most:
                break

    def __len__(self) -> int:
        return len(self.words)


def introduced(before: list[str]) -> bool:
    """Whether a title or an introduction comes right before; a name of one word needs it."""
    return bool(before) and (before[-1] in TITLES or (before[-1] == "." and len(before) > 1 and before[-2] in TITLES) or any(w in ("name", "named", "called", "nombre", "nom", "llamo", "appelle", "heißt", "heiße") for w in before))


def before_of(text: str, at: int) -> list[str]:
    """Up to three tokens before a place, in lower case; no cue is longer than what is looked at."""
    return [w.lower() for w in TOKEN.findall(text, max(0, at - 60), at)[-3:]]


def span_features(text: str, start: int, end: int, before: list[str]) -> list[str]:
    """Features of a whole candidate span; before: the tokens before it."""
    s = text[start:end]
    words = TOKEN.findall(s)
    low = [w.lower() for w in words]
    letters = [w for w in words if w[0].isalpha()]
    groups = "-".join(str(len(g)) for g in re.findall("[0-9]+", s))
    digits = sum("0" <= c <= "9" for c in s)
    out = ["one", f"n{min(len(letters), 6)}", f"d{digits}" if digits else "no digit", "shape " + re.sub(r"[A-Z]+", "A", re.sub(r"[^\W\d_A-Z]+", "a", re.sub(r"\d+", "9", s)))]
    cues = {CUE_OF[w] for w in before if w in CUE_OF}
    out += [f"cue {c}" for c in sorted(cues)] or ["no cue"]
    sign = "".join(sorted({c for c in s if not c.isalnum()}))
    if digits:
        out += [f"groups {groups} {sign}"]
        if cues:
            out += [f"groups {groups} {c}" for c in sorted(cues)]
        if re.fullmatch(r"(?:19|20)[0-9]{2}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2(?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2} ?[-/] ?(?:19|20)?[0-9]{2}", s):
            out.append("date")
        if ACCOUNT.fullmatch(s):
            out.append("checked" if mod97(s) else "unchecked")
    if text[start - 1 : start] in ("$", "€", "£", "#", "-", "/", ".", ":", "+", "_", "~", "=") and start:
        out.append("glued " + ("=" if text[start - 1] == "=" else "x"))
    if re.match(r"[-/:_+=%€@]|\.[^\W_]", text[end : end + 2]):
        out.append("goes on")
    if letters and not digits or ADDRESS.fullmatch(s):
        title = bool(before) and (before[-1] in TITLES or (before[-1] == "." and len(before) > 1 and before[-2] in TITLES))
        out.append("title" if title else "no title")
        given = [plain_name(w) in GIVEN for w in words]
        out.append("given" if given[0] else "given later" if any(given) else "none given")
        if letters and not digits:
            # a pair of names and who or what stands before it say more together than the names themselves
            out += [f"{min(len(letters), 4)} names {c}{':' if before and before[-1] == ':' else ''}" for c in sorted(cues & {"name", "person"})] or [f"{min(len(letters), 4)} names"]
        if low[0] in TITLES:
            out.append("starts with title")
        if any(w in CUE_OF for w in low):
            out.append("holds a cue")
        street = [w for w in low if w in STREETS or w.endswith(STREET_ENDS)]
        out.append("street" if street else "no street")
        out.append("sentence" if not start or re.search(r"[.!?:;\n|]\s*$", text[max(0, start - 4) : start]) else "within")
        if any(w.isupper() and len(w) > 1 for w in letters):
            out.append("capitals")
        if len(set(low)) < len(low) and len(letters) > 1:
            out.append("twice")
        more = re.match(rf",? {WORD}", text[end : end + 40])
        out.append("more names" if more else "ends")
        if re.search(rf"{WORD},? $", text[max(0, start - 40) : start]) and not title:
            out.append("names before")
    elif letters:
        kinds = ["9" if c.isdigit() else "A" if c.isupper() else "a" for c in s if c.isalnum()]
        changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
        out += [f"length {min(9, len(s) // 5)}", f"changes {min(5, 10 * changes // len(s))}"]
        if re.search(r"[=:]\s?[\"']?$", text[max(0, start - 4) : start]):
            out.append("assigned secret" if "secret" in cues else "assigned")
    return out


class Field:
    """The semi-Markov field: weights of span features by type, and of neighbouring types. Type 0 is no entity: one token long, without features."""

    TYPES = ("", *ADDED)

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weight = np.zeros((0, len(self.TYPES)))
        self.next = np.zeros((len(self.TYPES), len(self.TYPES)))

    def candidates(self, t: Tokens, closed: list[bool], grow: bool = False) -> list[list[tuple[int, tuple[int, ...], list[int]]]]:
        """For each end (token count) the spans that may end there: first token, types, numbers of features; shorter ones first."""
        text, out = t.text, [[] for _ in range(len(t) + 1)]
        for i in range(len(t)):
            c, start = t.words[i][0], t.start[i]
            if closed[i] or not (c.isalnum() and not c.islower() or c == "(" or DIGIT.search(t.words[i]) or CREDENTIAL.match(text, start)):
                continue
            # words before it, from the tokens at hand if they are all there
            before = [w.lower() for w in t.words[i - 3 : i]] if i > 2 and t.start[i - 3] >= start - 60 else before_of(text, start)
            digits, numeral = 0, True
            for j in range(i + 1, min(len(t), i + LONGEST) + 1):
                word = t.words[j - 1]
                if closed[j - 1] or (j > i + 1 and "\n" in text[t.end[j - 2] : t.start[j - 1]]):
                    break
                numeral = numeral and (word.isdecimal() and word.isascii() or not word[0].isalnum())
                digits += len(word) if numeral and word[0].isalnum() else 0
                if numeral and digits > 15 and j > i + 1:
                    break  # no form is so many digits with signs between
                if not word[-1].isalnum() and word != "=":
                    continue
                s = text[start : t.end[j - 1]]
                if numeral:
                    shape = s.translate(NUMERALS)
                    kinds = kept((shape,), lambda s=s: forms(s))
                else:
                    kinds = forms(s)
                if not kinds or (j == i + 1 and kinds == (4,) and not introduced(before)):
                    continue
                make = lambda e=t.end[j - 1], before=before: self.numbers(span_features(text, start, e, before), grow)  # noqa: E731, B023
                if numeral and not grow:
                    # all that the features of digits look at: groups, signs, dates, the words before and the signs around
                    around = (text[start - 1 : start], text[t.end[j - 1] : t.end[j - 1] + 2] if text[t.end[j - 1] : t.end[j - 1] + 1] in ("-", "/", ":", "_", "+", "=", "%", "€", "@", ".") else "")
                    cues = tuple(CUE_OF.get(w, "") for w in before)
                    years = tuple(g[:2] in ("19", "20") for g in (s[:2], s[3:5], s[5:7], s[6:8], s[7:9])) if "date" in self.index else ()
                    row = kept((id(self), shape, around, cues, years), make)
                else:
                    row = make()
                out[j].append((i, kinds, row))
        for spans in out:
            spans.sort(key=lambda x: -x[0])
        return out

    def numbers(self, names: list[str], grow: bool) -> list[int]:
        """Numbers of features; those that the fit didn't meet have none."""
        if grow:
            for f in names:
                self.index.setdefault(f, len(self.index))
        return [self.index[f] for f in names if f in self.index]

    def sums(self, n: int, spans: list, score: list) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward sums over all segmentations."""
        k = len(self.TYPES)
        a, b = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        a[0, 0], b[n] = 0.0, 0.0
        for j in range(1, n + 1):
            a[j, 0] = np.logaddexp.reduce(a[j - 1] + self.next[:, 0])
            for (i, kinds, _), s in zip(spans[j], score[j], strict=True):
                for y in kinds:
                    a[j, y] = np.logaddexp(a[j, y], np.logaddexp.reduce(a[i] + self.next[:, y]) + s[y])
        for j in range(n, 0, -1):
            b[j - 1] = np.logaddexp(b[j - 1], self.next[:, 0] + b[j, 0])
            for (i, kinds, _), s in zip(spans[j], score[j], strict=True):
                for y in kinds:
                    b[i] = np.logaddexp(b[i], self.next[:, y] + s[y] + b[j, y])
        return a, b

    def gradient(self, n: int, spans: list, truth: dict[tuple[int, int], int]) -> tuple[list, np.ndarray]:
        """Observed less expected counts, as (features, type, difference) of spans and as a matrix of neighbouring types."""
        score = [[self.weight[r].sum(0) for _, _, r in at] for at in spans]
        a, b = self.sums(n, spans, score)
        z = np.logaddexp.reduce(a[n])
        moves, gn = [], np.zeros_like(self.next)
        for j in range(1, n + 1):
            gn[:, 0] -= np.exp(np.minimum(a[j - 1] + self.next[:, 0] + b[j, 0] - z, 0))
            for (i, kinds, r), s in zip(spans[j], score[j], strict=True):
                for y in kinds:
                    pair = np.exp(np.minimum(a[i] + self.next[:, y] + s[y] + b[j, y] - z, 0))
                    gn[:, y] -= pair
                    moves.append((r, y, float(truth.get((i, j)) == y) - float(pair.sum())))
        was, i = 0, 0
        ends = {i: (j, y) for (i, j), y in truth.items()}
        while i < n:
            i, y = ends.get(i, (i + 1, 0))
            gn[was, y] += 1
            was = y
        return moves, gn

    def fit(self, sentences: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 4, rate: float = 0.3) -> None:
        """Adaptive gradient steps on the log-likelihood, with a little weight decay."""
        data = []
        for text, spans in sentences:
            t = Tokens(text)
            found = self.candidates(t, [False] * len(t), grow=True)
            begin, end = {s: i for i, s in enumerate(t.start)}, {e: j + 1 for j, e in enumerate(t.end)}
            truth = {(begin[s], end[e]): self.TYPES.index(kind) for s, e, kind in spans}
            if any((i, y) not in {(x, z) for x, kinds, _ in found[j] for z in kinds} for (i, j), y in truth.items()):
                raise ValueError(f"no form for {text!r}")
            data.append((len(t), found, truth))
        self.weight = np.zeros((len(self.index), len(self.TYPES)))
        sw, sn = np.full_like(self.weight, 1e-2), np.full_like(self.next, 1e-2)
        for _ in range(epochs):
            for n, found, truth in data:
                moves, gn = self.gradient(n, found, truth)
                for r, y, d in moves:
                    g = d - 1e-3 * self.weight[r, y]
                    sw[r, y] += g * g
                    self.weight[r, y] += rate * g / np.sqrt(sw[r, y])
                sn += gn * gn
                self.next += rate * gn / np.sqrt(sn)

    def windows(self, text: str, begin: int, end: int, closed: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
        """Entities of the best segmentation of a stretch as (start, end, kind), in windows of tokens.

        closed: spans in order that no entity may touch. A window is decided up to the last place that the best paths to all ends near its own
        end have in common; what comes after is taken again with the next one. Without such a place the window is doubled.
        """
        k, most = len(self.TYPES), WINDOW
        first = [0.0] + [-np.inf] * (k - 1)
        near = 0
        while begin < end:
            t = Tokens(text, begin, end, most)
            n = len(t)
            if not n:
                return
            shut = [False] * n
            while near < len(closed) and closed[near][1] <= begin:
                near += 1
            at = near
            for i in range(n):
                while at < len(closed) and closed[at][1] <= t.start[i]:
                    at += 1
                shut[i] = at < len(closed) and closed[at][0] < t.end[i]
            v, back = self.paths(n, self.candidates(t, shut), first)
            whole = n < most
            ends = [(n, int(np.argmax(v[n])))] if whole else [(j, y) for j in range(max(0, n - LONGEST + 1), n + 1) for y in range(k) if v[j][y] > -np.inf]
            # back from all ends, the furthest first, until they are one place
            open_ = set(ends)
            while len(open_) > 1:
                far = max(open_)
                if far[0] == 0:
                    break
                open_.remove(far)
                open_.add(back[far[0]][far[1]])
            stop, y = max(open_) if len(open_) == 1 else (0, 0)
            if not whole and stop == 0:
                most *= 2
                continue
            if not whole:
                first = [-np.inf] * k
                first[y] = 0.0
            out = []
            j = stop
            while j:
                i, was = back[j][y]
                if y:
                    out.append((t.start[i], t.end[j - 1], self.TYPES[y]))
                j, y = i, was
            yield from out[::-1]
            if whole:
                return
            begin, most = t.end[stop - 1], WINDOW

    def paths(self, n: int, spans: list, first: list[float]) -> tuple[list[list[float]], list[list[tuple[int, int]]]]:
        """Best score of each place and type, and where it comes from."""
        k, move = len(self.TYPES), self.next.tolist()
        v, back = [first], [[(0, 0)] * k]
        rows = range(k)
        plain = [first[0] > -np.inf and max(first[1:]) == -np.inf]  # places that no entity can end at: what was before is type 0
        for j in range(1, n + 1):
            now, came = [-np.inf] * k, [(0, 0)] * k
            was = 0 if plain[j - 1] else max(rows, key=lambda x, p=v[j - 1]: p[x] + move[x][0])
            now[0], came[0] = v[j - 1][was] + move[was][0], (j - 1, was)
            for i, kinds, r in spans[j]:
                s = self.weight[r].sum(0)
                for y in kinds:
                    was = 0 if plain[i] else max(rows, key=lambda x, p=v[i], y=y: p[x] + move[x][y])
                    total = v[i][was] + move[was][y] + float(s[y])
                    if total > now[y]:
                        now[y], came[y] = total, (i, was)
            v.append(now)
            back.append(came)
            plain.append(not spans[j])
        return v, back


def sentences(n: int = 2000, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated sentences with their spans, and as many that look alike without any."""
    r = random.Random(seed)
    syllables = ("ka", "ro", "mi", "ten", "sal", "dor", "vin", "el", "ha", "ber", "nu", "ost", "ri", "gan")
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    cap = lambda: word().capitalize()
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    of = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    upper, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
    alnum = upper + upper.lower() + "0123456789"
    given = sorted(GIVEN)
    cue = lambda kind: r.choice(CUES[kind])

    def account() -> str:
        land, rest = of(upper, 2), digits(r.choice((12, 14, 16, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in rest + land) + "00") % 97
        s = f"{land}{check:02d}{rest}"
        return s if r.random() < 0.3 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def piece(kind: str) -> tuple[str, str]:
        if kind == "local_phone":
            a, b, c = digits(3), digits(3), digits(4)
            s = r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{digits(3)} {digits(7)}", f"0{digits(2)}/{digits(7)}", f"{b}-{c}", "0" + " ".join(digits(2) for _ in range(4)), a + b + c))
            plain = s.count("-") != 2 and not s.startswith("(")
            return (cue("phone") + r.choice((" ", ": ", " me at ", " is "))) if plain or r.random() < 0.6 else "", s
        if kind == "iban":
            return r.choice((cue("account") + " ", "", "to ")), account()
        if kind == "id_number":
            if r.random() < 0.3:  # letters and digits, as passports and licences have them
                return cue("id") + r.choice((" ", ": ", " no. ", " number ")), r.choice((of(upper, 1) + digits(8), of(upper, 2) + digits(7), of(upper, 1) + digits(2) + of(upper, 1) + digits(2) + of(upper, 1) + digits(2), digits(2) + of(upper, 2) + digits(5), of(upper + "0123456789" * 2, 8) + "7"))
            s = r.choice((f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)} {digits(2)} {digits(4)}", digits(9)))
            return (cue("id") + r.choice((" ", ": ", " no. "))) if s.count("-") != 2 or r.random() < 0.7 else "", s
        if kind == "name":
            shape = r.random()
            if shape < 0.3:
                return r.choice(TITLES).capitalize() + r.choice((" ", ". ")), " ".join(cap() for _ in range(r.randint(1, 2)))
            first = r.choice(given).capitalize()
            full = r.choice((f"{first} {cap()}", f"{first} {cap()}", f"{first} {r.choice(upper)}. {cap()}", f"{first} {r.choice(PARTICLES)} {cap()}", f"{first} {cap()}-{cap()}", f"{first} {cap()} {cap()}"))
            if shape < 0.45:
                return r.choice(("name is ", "my name is ", "is called ", "name: ", "mi nombre es ", "ich heiße ")), r.choice((full, f"{cap()} {cap()}", f"{cap()} {cap()} {cap()}", first))
            if shape < 0.55:  # heads of letters
                return r.choice(("From: ", "To: ", "Cc: ", "from: ", "by: ", "Author: ", "Signed: ")), r.choice((f"{cap()} {cap()}", f"{cap()} {cap()} {cap()}", f"{cap()} {r.choice(PARTICLES)} {cap()}", full))
            if shape < 0.8:  # someone is spoken to or of, by names of any language
                return r.choice((cue("person") + " ", cue("person").capitalize() + " ", "the " + cue("person") + " ", cue("person") + ": ", cue("person") + ", ")), r.choice((f"{cap()} {cap()}", f"{cap()} {cap()}", f"{cap()} {cap()} {cap()}", f"{cap()} {r.choice(PARTICLES)} {cap()}", f"{cap()}-{cap()} {cap()}", full))
            return r.choice((cue("name") + " ", "", "and ", word() + " ")), full
        if kind == "credential":
            s = of(r.choice((hexes, alnum, alnum + "+/")), r.choice((12, 16, 20, 24, 32, 40, 64)))[:-1] + "7"
            return cue("secret") + r.choice((" = \"", "=", ": ", " = '", "=\"", " = ")), s
        number = f"{r.randint(1, 999)}{r.choice(('', '', '', 'b'))}"
        street = r.choice(STREETS[:14]).capitalize()
        s = r.choice((f"{number} {cap()} {street}", f"{number} {cap()} {cap()} {street}", f"{number} {cap()} {cap()} {cap()} {street}", f"{cap()}{r.choice(STREET_ENDS)} {number}", f"{number} Rue {r.choice(('de ', 'du ', 'de la ', ''))}{cap()}", f"Calle {r.choice(('de ', ''))}{cap()} {number}", f"{cap()} {r.choice(('Platz', 'Allee', 'Weg'))} {number}"))
        return r.choice((cue("place") + " ", cue("place") + " ", "", word() + " ")), s

    def other() -> str:
        h, d, c = of(hexes, r.choice((32, 40, 64))), digits, cap
        kinds = (
            f"version {d(1)}.{d(1)}", d(r.randint(1, 6)), f"{r.choice(('19', '20'))}{d(2)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}", f"{word()}={d(3)}{word()}{d(4)}", h, f"{cue('other')} {h}", f"{cue('other')}: {h}", f"commit {h[:12]}7",
            f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}", f"{of(upper, 2)}{d(2)}{of(upper, 1)}{d(3)}", f"{of(upper, 2)}{d(2)}" + "".join(r.choice(" ") + d(4) for _ in range(3)), f"${d(3)}.{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)} {word()}",
            f"by {c()} {d(1)}.{d(1)}", f"under the {c()} {c()}, {r.choice(('Version', 'version'))} {d(1)}", f"{word()} the {of(upper, 2)}U {c()} {c()} {c()}, version {d(1)}", f"{c()} {c()}", f"{c()} {c()} {c()}", f"the {c()} {c()} {word()}", d(16), f"{d(2)} . {d(2)}",
            f"( {d(3)} )", f"{d(12)}-{d(2)}", f"isbn {d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"order {d(r.randint(6, 10))}", f"invoice {d(3)}-{d(4)}", f"{d(3)}-{d(2)}", f"{d(1)}-{d(1)}-{d(1)}", f"{d(3)} {d(3)} {d(3)} {word()}", f"{d(1)},{d(3)},{d(3)}", f"{d(2)}.{d(4)}, {d(2)}.{d(4)}",
            f"chapter {d(2)} {c()}", f"{c()} {d(2)}", f"{d(2)} {c()}", f"in {d(2)} {c()} {c()}", f"{c()} {d(4)}", f"{word()}{d(2)}_{word()}{d(3)}", f"src/{word()}/{word()}{d(2)}.py", f"{of(alnum, 20)}7", f"{cue('other')} {of(alnum, 24)}7", f"token {word()}", f"the password {word()}", f"serial {d(4)}-{d(4)}-{d(4)}",
            f"{c()}. {c()} {word()}", f"{word().upper()} {word().upper()}", f"{word().upper()}!! {word().upper()}!!", " ".join([c()] * r.randint(2, 5)), f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(4)} {d(4)}", f"{d(3)}.{d(3)}", f"{d(6)}", f"{d(9)}", f"{d(10)}", f"section {d(1)}.{d(1)} {c()} {c()}", f"{cue('name').capitalize()} {c()}", f"{cue('name').capitalize()} {c()} {c()}", f"{cue('person').capitalize()} {c()}", f"call {word()} {d(2)}", f"{r.choice(given).capitalize()} {word()}", f"#{d(7)}", f"{cue('other')} {of(upper, 2)}{d(6)}", f"{of(upper, 1)}{d(7)}", f"{cue('name').capitalize()} the {c()} {c()}", f"{cue('name')} {c()} {c()}", f"{word()} {c()} {c()}", f"{c()} {c()}: {word()}",
            *(" ".join(d(r.randint(1, 9)) for _ in range(r.randint(2, 9))) for _ in range(3)), f"{d(3)} {d(2)} {d(4)} {d(3)}", f"{d(4)} {d(3)} {d(3)} {d(4)}", f"{d(2)} {d(9)} {d(1)}",
        )
        return r.choice(kinds)

    out = []
    for i in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(0, 4))).capitalize() if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(1, 4))), []
        text += r.choice((" ", ". ", ", ")) if text else ""
        if i % 2:
            lead, s = piece(kind := (ADDED + ("name", "name"))[i // 2 % (len(ADDED) + 2)])  # names have the most settings
            text += lead
            spans.append((len(text), len(text) + len(s), kind))
            text += s + ('"' if lead.endswith('"') else "'" if lead.endswith("'") else "")
        else:
            text += other()
        out.append((text + r.choice((" ", ". ", ", ", "\n")) + " ".join(word() for _ in range(r.randint(1, 3))), spans))
    return out


@cache
def train() -> Field:
    """The field, fitted once in a process: the sentences are always the same."""
    field = Field()
    field.fit(sentences())
    return field


def added_spans(text: str, base: list[tuple[int, int, str]], field: Field) -> list[tuple[int, int, str]]:
    """What the field finds beside the spans of the patterns."""
    closed = sorted((s, e) for s, e, _ in base)
    merged: list[tuple[int, int]] = []
    for s, e in closed:
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    out, near = [], 0
    for m in REGION.finditer(text):
        a, b = m.span()
        word = m.group()
        if b - a < 3 or (word.isalpha() and not introduced(before_of(text, a))):  # most regions are single words
            continue
        while near < len(merged) and merged[near][1] <= a:
            near += 1
        inside = []
        for s, e in merged[near:]:
            if s >= b:
                break
            inside.append((s, e))
        if inside and inside[0][0] <= a and inside[0][1] >= b:
            continue
        out += field.windows(text, a, b, inside)
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], RANK[x[2]], x[1])))


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of the patterns' spans, their digest, all spans as text and as an array, and the counts of added and of all spans."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(field)  # some thousands of weights
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans", "entities"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            rows: list[tuple] = []
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = added_spans(text, base, f)
                every = sorted(base + more, key=lambda x: (x[0], RANK[x[2]], x[1]))
                n = [sum(k == x[2] for x in base) for k in BASE]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(more), len(every), [{"kind": k, "start": s, "end": e} for s, e, k in every]))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(9)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.int64()), pa.array(cols[7], pa.int64()), pa.array(cols[8], kind)], names)

    return doc_columns(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long, entities array<struct<kind:string,start:long,end:long>>")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return find(table(spark, sf_dir, "documents"), train()).drop("entities")
