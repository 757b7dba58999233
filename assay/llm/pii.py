"""Personal data: offset-preserving deobfuscation.

Base detectors run over the source text. Where a text holds a disguise, transducers (look-alike characters,
spelled digits, at/dot words) rewrite it to a normal form that remembers which source characters each normal
character came from; the same detectors run over that form, and what they find maps back to source spans.

Defined results: a null or empty text has no spans; null ids stay null; repeated rows each give their own row;
texts of any length are read whole; extra columns of the input are not read. A disguised find within a base span of its kind is not
added; one that reaches beyond it is, as the base span then holds only a part of the identifier.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from hashlib import sha256

from pyspark.sql import DataFrame

from .common import arrow_map, bounded_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ---------------------------------------------------------------- detectors
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits can't match where the run's own start doesn't: looking behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses. Found from each @, whose local part is the run before it."""
    out, at, floor = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        # without a match, the next local part can begin right after this @, as @ belongs to none
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


DETECT = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> list[Span]:
    return [(kind, s, e) for kind in KINDS for s, e in DETECT[kind](text)]


# ---------------------------------------------------------------- transducers
# Letters of other scripts that look like an ASCII letter or sign.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "З": "3",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "κ": "k", "υ": "u", "ε": "e", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "·": ".", "•": ".", "∙": ".", "⋅": ".",
}
# The digits' names in the corpus' languages.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SEP = r"[ \t,.\-]{1,3}"
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
# Blanks around a bare word: up to three, or one line break, as wrapped text has it.
_GAPS = r"(?:[ \t]{1,3}|[ \t]{0,2}\r?\n[ \t]{0,2})"
_DOT = rf"(?:{_OPEN}(?:dot|punkt|point|punto|\.){_CLOSE}|{_GAPS}dot{_GAPS}|_dot_|[。．])"
# Endings for which "name at host dot end" is an address whatever stands around them.
_ENDS = "com|org|net|edu|gov|info|biz|io|eu|de|fr|es|uk|it|ch|at|us|co|me|test|example|invalid"
# Any other ending of letters will do, unless the words around a bare "dot" make it a noun: a determiner before it, or a
# word behind it that joins clauses or phrases (none of three letters or more is a top-level domain).
_NOUN = rf"(?:the|an?|this|that|these|those|each|every|any|some|no|another|which|what|my|your|his|her|its|our|their){_GAPS}dot\b"
_JOINS = r"(?:and|the|for|was|were|are|but|nor|that|this|with|from|which|when|where|while|because|had|has|have|than|then|who|into|onto|over|under|after|before|until|about|between|near|not|you|they|she)\b"
_HOST = r"[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){0,3}"
_MORE = rf"(?:[a-z0-9-]{{1,63}}(?:{_DOT}|\.)){{0,3}}"
_BARE = rf"(?:{_HOST}{_DOT}{_MORE}(?:{_ENDS})\b|(?!{_NOUN}){_HOST}{_DOT}(?!{_JOINS}){_MORE}[a-z]{{2,63}}\b)"
_TOKEN = re.compile(
    rf"(?P<at>{_OPEN}(?:at|@){_CLOSE}|(?<=[a-z0-9])_at_(?=[a-z0-9])|(?<=[a-z0-9]){_GAPS}at{_GAPS}(?={_BARE})|(?<=[a-z0-9])[ \t]{{1,3}}@[ \t]{{1,3}}(?=[a-z0-9]))"
    rf"|(?P<dot>(?<=[a-z0-9]){_DOT}(?=[a-z0-9]))"
    r"|(?P<digits>(?<![^\W_])(?=[OoIl|]{0,18}[0-9])(?=[0-9]{0,18}[OoIl|])[0-9OoIl|]{2,19}(?![^\W_]))"
    r"|(?P<lone>(?<![^\W_])(?-i:[OoIl|])(?![^\W_]))"
    # a number whose dots mark thousands is an amount
    rf"|(?P<plus>\bplus[ \t]{{1,3}}(?=(?:{_WORDS})\b|(?![0-9]{{1,3}}(?:\.[0-9]{{3}})+(?![0-9.]))[0-9]))"
    rf"|(?P<word>(?:(?<=[0-9])|\b)(?:{_WORDS})\b(?:(?={_SEP}(?:(?:{_WORDS})\b|[0-9]))|(?<=[^\W_])))"
    r"|(?P<char>[^\x00-\x7f])",
    re.I,
)
# A letter that is a digit group of its own has digit groups or such letters on both sides, or, among dots, on one.
_BEFORE = re.compile(r"[0-9](?:[.\- ][OoIl|]){0,18}[.\- ]$")
_BEHIND = re.compile(r"(?:[.\- ][OoIl|]){0,18}[.\- ][0-9]")
_DOTS_BEFORE = re.compile(r"[0-9](?:\.[OoIl|]){0,18}\.$")
_DOTS_BEHIND = re.compile(r"(?:\.[OoIl|]){0,18}\.[0-9]")


def stands_alone(text: str, s: int, e: int) -> bool:
    before, behind = text[max(0, s - 38) : s], text[e : e + 38]
    return bool((_BEFORE.search(before) and _BEHIND.match(behind)) or _DOTS_BEFORE.search(before) or _DOTS_BEHIND.match(behind))


_GAP = re.compile(rf"({_SEP})(?:{_WORDS})\b", re.I)
_AFTER_NUMBER = re.compile(rf"(?:\b(?:{_WORDS})|[0-9]){_SEP}$", re.I)


@lru_cache(maxsize=65536)
def plain(c: str) -> str:
    """The ASCII form of a look-alike character; "" for an invisible one; the character itself, if it has none."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if unicodedata.category(c) == "Cf":
        return ""
    d = unicodedata.decimal(c, None)
    if d is not None:
        return str(d)
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n < "\x80" else c


# What a disguise needs: each pattern is wider than the tokens it stands for. The last three read lower case.
_LATIN = "".join(c for c in map(chr, range(0x80, 0x100)) if plain(c) != c)
_ODD = re.compile(rf"[^\x00-\xff]|[{_LATIN}]|[0-9][OoIiLl|]|[OoIiLl|][0-9]|[0-9][.\- ][OoIl|](?![^\W_])|(?<![^\W_])[OoIl|][.\- ][0-9]")
_MARKS = re.compile(r"[\[({<]\s{0,3}(?:at|@|dot|punkt|point|punto|\.)\s{0,3}[\])}>]|_(?:at|dot)_|[ \t\n](?:dot|@)[ \t\r\n]")
_SPELLED = re.compile(rf"[\W0-9](?:{_WORDS}){_SEP}(?:{_WORDS}|[0-9])|[0-9]{_SEP}(?:{_WORDS})\b")
_PLUS = re.compile(rf"plus[ \t]{{1,3}}(?:{_WORDS}|[0-9])")


def may_hide(text: str) -> bool:
    """False only if no transducer would change the text."""
    low = text.lower()
    return bool(_ODD.search(text) or _MARKS.search(low) or _SPELLED.search(f" {low}") or _PLUS.search(low))


class Normal:
    """A normal form with its way back: pieces are (start in the form, start in the source, source length, copied?)."""

    def __init__(self, text: str):
        out, pieces, at, size = [], [], 0, 0

        def put(s: str, start: int, end: int, copied: bool) -> None:
            nonlocal size
            if s:
                pieces.append((size, start, end - start, copied))
                out.append(s)
                size += len(s)

        for m in _TOKEN.finditer(text):
            s, e = m.span()
            kind = m.lastgroup
            if kind == "lone" and not stands_alone(text, s, e):
                continue
            if kind in ("digits", "lone"):
                # letters that stand for digits among digits
                if s > at:
                    put(text[at:s], at, s, True)
                for i, c in enumerate(m[0], s):
                    put("0" if c in "Oo" else "1" if c in "Il|" else c, i, i + 1, c.isdigit())
                at = e
                continue
            if kind == "char":
                new = plain(m[0])
                if new == m[0]:
                    continue
            elif kind == "word":
                follows = re.match(rf"{_SEP}(?:(?:{_WORDS})\b|[0-9])", text[e : e + 12], re.I)
                if not follows and not _AFTER_NUMBER.search(text[max(0, s - 12) : s]):
                    continue
                new = DIGIT_WORDS[m[0].lower()]
            else:
                new = {"at": "@", "dot": ".", "plus": "+"}[kind]
            if s > at:
                put(text[at:s], at, s, True)
            put(new, s, e, False)
            at = e
            if kind == "word" and (gap := _GAP.match(text, e)):
                at = gap.end(1)  # digits spelled one after the other make one number
        if at < len(text):
            put(text[at:], at, len(text), True)
        self.text, self.pieces, self.starts = "".join(out), pieces, [p[0] for p in pieces]

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of a span of the form, and whether a disguise lies in it."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        p, q = self.pieces[i], self.pieces[j]
        s = p[1] + (start - p[0] if p[3] else 0)
        e = q[1] + (end - q[0] if q[3] else q[2])
        return s, e, not (i == j and p[3])


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and disguised spans together, both by kind as listed and then by start."""
    base = base_spans(text)
    if not may_hide(text):
        return base, base
    form, added = Normal(text), []
    for kind in KINDS:
        own = [(s, e) for k, s, e in base if k == kind]
        starts = [s for s, _ in own]
        for s, e in DETECT[kind](form.text):
            s, e, hidden = form.back(s, e)
            i = bisect_right(starts, s)
            if hidden and not (i and own[i - 1][1] >= e):
                added.append((kind, s, e))
    if not added:
        return base, base
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda x: (order[x[0]], x[1], x[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, then longest, names the kind."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


# ---------------------------------------------------------------- operators
def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, counts of base spans by kind, a digest of the base spans, all spans, how many of them the method added, and how many there are."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"

    def run(batch):
        rows = []
        for t in batch.column("text").to_pylist():
            base, every = all_spans(t or "")
            n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            rows.append((*n, sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base), len(every)))
        names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"]
        yield {"doc_id": batch.column("doc_id")} | {c: list(v) for c, v in zip(names, zip(*rows))}

    return arrow_map(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in text, and n_chars counted anew where it was. Null texts stay null."""
    from pyspark.sql import functions as F

    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def redacted(texts):
        def one(t):
            if not t:
                return t
            spans = all_spans(t)[1]
            return redact(t, spans) if spans else t

        return texts.map(one, na_action="ignore")

    out = docs.withColumn("text", redacted("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_pii(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return find_pii(table(spark, sf_dir, "documents"))
