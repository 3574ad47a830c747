"""Personal data in disguise, found with its offsets in the source.

Base identifiers (email, ip, card, phone) are found in the text as it stands. Then two transducers rewrite a text while
they keep, for each character that they write, the source characters that it stands for: the first replaces
homoglyphs and wide forms, the second replaces spelled digits, `at` and `dot` disguises. The identifiers of the
rewritten text are mapped back to source spans, and those that don't lie within a base span are added: a disguise in the
middle of an identifier often leaves a base fragment of it, which the added span then overlaps.

Spans are code points of the source, end exclusive. A bare `at` between words counts only if the domain after it spells
a dot: "john at example.com" is read as prose.

Defined results: a null text counts as empty and has no spans; repeated rows give repeated rows; an empty table gives no
rows; a null doc_id stays null; columns of the input that aren't named are ignored by find() and kept by redact().
"""

import hashlib
import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the identifiers, leftmost and non-overlapping for each kind, ordered by start and kind."""
    found = []
    over = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = at = m.start()
        while start > over and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            over = m.end()
            found.append((start, 0, over))
    if not _DIGITS.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := re.sub(r"[ -]", "", m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_DIGITS.findall(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТХІЈЅаеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορνιⅼ",
        "ABEKMHOPCTXIJSaeopcyxijshdqwABEZHIKMNOPTYXaopvil",
        strict=True,
    )
)
# The digits' names.
_NAMES = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_INVISIBLE = "­​‌‍⁠﻿"
_SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ", "。": ".", "․": "."}
_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
_SUSPECT = re.compile(
    f"[{''.join(_LOOKALIKES)}{''.join(_SIGNS)}{_INVISIBLE}²³¹⁰⁴-₟℀-⅏①-⓿٠-٩۰-۹߀-߉०-९০-৯੦-੯૦-૯୦-୯௦-௯౦-౯೦-೯൦-൯๐-๙໐-໙༠-༩၀-၉０-￯ﬀ-ﬆ！-～\U0001d400-\U0001d7ff\U0001f100-\U0001f1ff]"
)


def _plain(c: str) -> str:
    """What c looks like, or c itself; letters with accents stay."""
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKES or c in _SIGNS:
        return _LOOKALIKES.get(c) or _SIGNS[c]
    if unicodedata.decomposition(c).startswith("<"):
        wide = unicodedata.normalize("NFKC", c)
        return wide if wide.isascii() else c
    return str(unicodedata.digit(c)) if unicodedata.category(c) == "Nd" else c


class Rewriting:
    """A rewritten text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def replace(self, edits: list[tuple[int, int, str]]) -> "Rewriting":
        """With the spans of edits (ordered, apart) replaced; offsets go on referring to the first source."""
        parts, starts, ends, at = [], [], [], 0
        old_starts, old_ends = self.starts or range(len(self.text)), self.ends or range(1, len(self.text) + 1)
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            starts += [*old_starts[at:a], *[old_starts[a]] * len(new)]
            ends += [*old_ends[at:a], *[old_ends[b - 1]] * len(new)]
            at = b
        out = Rewriting("".join(parts) + self.text[at:])
        out.starts, out.ends = starts + [*old_starts[at:]], ends + [*old_ends[at:]]
        return out

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])


def _homoglyphs(text: str) -> list[tuple[int, int, str]]:
    """Edits of the characters outside ASCII that look like ASCII ones."""
    edits = []
    for m in _NOT_ASCII.finditer(text):
        edits += [(m.start() + k, m.start() + k + 1, new) for k, c in enumerate(m[0]) if (new := _seen(c)) != c]
    return edits


_SEEN: dict[str, str] = {}


def _seen(c: str) -> str:
    if c not in _SEEN and len(_SEEN) < 5000:
        _SEEN[c] = _plain(c)
    return _SEEN[c] if c in _SEEN else _plain(c)


_NAME = "|".join(sorted(_NAMES, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:(?:{_NAME}|plus)(?![^\W_])|\+?[0-9]+)(?:[ ,.-]{{1,2}}(?:(?:{_NAME})(?![^\W_])|[0-9]+))+")
_UNIT = re.compile(rf"(?i)({_NAME}|plus)|[0-9]+|[ ,.-]+|\+")
_NAME_SET = frozenset(x.encode() for x in _NAMES)
_DOT_SET = frozenset((b"dot", b"punto", b"punkt", b"point"))
_SPLIT = bytes.maketrans(b",.-[](){}<>@+:;/", b" " * 16)
_DOT = r"(?:\s{0,2}[\[({<]\s{0,2}(?:dot|\.|punto|punkt|point)\s{0,2}[\])}>]\s{0,2}|\s{1,2}(?:dot|punto|punkt|point)\s{1,2})"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_AT = re.compile(r"(?i)(\s{0,2}[\[({<]\s{0,2}(?:at|@|arroba)\s{0,2}[\])}>]\s{0,2})|\s(?:at|arroba)\s|@")
_BRACKETED = re.compile(rb"[\[({<]\s{0,2}(?:at|@|arroba|dot|\.|punto|punkt|point)\s{0,2}[\])}>]")
_AFTER = re.compile(rf"(?i){_LABEL}(?:(?:\.|{_DOT}){_LABEL})+")
_BEFORE = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9_%+-]*(?:(?:\.|{_DOT})[A-Za-z0-9_%+-]+)*$")
_DOT_LINK = re.compile(rf"(?i){_DOT}")
_IP_DISGUISED = re.compile(rf"(?i)(?<![0-9])[0-9]{{1,3}}(?:(?:\.|{_DOT})[0-9]{{1,3}}){{3}}(?![0-9])")


def _dots(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    return [(start + x.start(), start + x.end(), ".") for x in _DOT_LINK.finditer(text[start:end])]


def _local_part(text: str, end: int) -> re.Match | None:
    """The longest local part, dots spelled or not, that ends at `end`; looks back as far as it reaches."""
    back = 128
    while True:
        found = _BEFORE.search(text[max(0, end - back) : end])
        if not found or found.start() >= 16 or back >= end:  # a spelled dot is shorter than that
            return found
        back *= 4


def _signs(text: str) -> list[tuple[int, int, str]]:
    """Edits of at and dot disguises. A bare `at` counts only if the domain after it spells a dot."""
    edits = []
    for m in _AT.finditer(text):
        after = _AFTER.match(text, m.end())
        before = after and _local_part(text, m.start())
        if before:
            dots = _dots(text, after.start(), after.end())
            if m[1] or dots:
                edits += [*_dots(text, m.start() - len(before[0]), m.start()), *([] if m[0] == "@" else [(m.start(), m.end(), "@")]), *dots]
    for m in _IP_DISGUISED.finditer(text):
        edits += _dots(text, m.start(), m.end())
    return edits


def _digits(text: str) -> list[tuple[int, int, str]]:
    """Edits of runs with two spelled digits or more: names become digits, what stands between goes."""
    edits = []
    for m in _SPELLED.finditer(text):
        units = [(m.start() + x.start(), m.start() + x.end(), x[1], x[0][0]) for x in _UNIT.finditer(m[0])]
        if sum(bool(x[2]) for x in units) >= 2:
            edits += [
                (a, b, _NAMES.get(name.lower(), "+") if name else "") for a, b, name, first in units if name or not (first.isdigit() or first == "+")
            ]
    return edits


def _words_for_signs(text: str) -> list[tuple[int, int, str]]:
    """Edits of disguises that are made of words; the texts without any are told by their set of words."""
    plain = text.lower().encode()
    words = plain.translate(_SPLIT).split()
    edits = []
    if not _DOT_SET.isdisjoint(words) or _BRACKETED.search(plain):
        edits += _signs(text)
    if not _NAME_SET.isdisjoint(words):
        run = names = 0
        for w in words:
            run, names = (run + 1, names + (w in _NAME_SET)) if w in _NAME_SET or w.isdigit() else (0, 0)
            if names >= 2 and run >= 3:
                edits += _digits(text)
                break
    out: list[tuple[int, int, str]] = []
    for e in sorted(edits):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a whole text, each as (start, kind, end) in order."""
    text = text or ""
    base = base_spans(text)
    at = Rewriting(text)
    if not text.isascii() and _SUSPECT.search(text) and (edits := _homoglyphs(text)):
        at = at.replace(edits)
    if edits := _words_for_signs(at.text):
        at = at.replace(edits)
    if at.starts is None:
        return base, base
    begins, more = [s for s, _, _ in base], []
    reach = list(accumulate((e for _, _, e in base), max))  # the furthest end of the base spans up to each
    for start, kind, end in base_spans(at.text):
        a, b = at.source(start, end)
        k = bisect_right(begins, a)
        if not k or reach[k - 1] < b:
            more.append((a, kind, b))
    return base, sorted(base + more)


def _shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


_RESULT = "struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base_sha256: string, spans: string, n_added: long, n_spans: long>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of base identifiers of each kind, the SHA-256 of their list, all spans, how many the
    disguises add, and the number of all."""

    @F.arrow_udf(_RESULT)
    def searched(texts: pa.Array) -> pa.Array:
        rows = []
        for x in texts:
            base, every = spans(x.as_py())
            kinds = [k for _, k, _ in base]
            rows.append(
                (
                    *(kinds.count(k) for k in range(4)),
                    hashlib.sha256(_shown(base).encode()).hexdigest(),
                    _shown(every),
                    len(every) - len(base),
                    len(every)
                )
            )
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
        return pa.StructArray.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)],
            ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"]
        )

    return docs.select(F.col(id_col).alias("doc_id"), searched(F.col(text_col)).alias("_f")).select("doc_id", "_f.*")


def redacted(text: str | None) -> str | None:
    """text with every span replaced by its kind; spans that touch the same characters become one, named by the first."""
    if text is None:
        return None
    out, at = [], 0
    for start, kind, end in spans(text)[1]:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with redacted texts; a null text stays null."""

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        return pa.array([redacted(x.as_py()) for x in texts], pa.string())

    return docs.withColumn(text_col, cleaned(F.col(text_col)))
