"""Personal data in disguise: a text is rewritten by transducers that undo
homoglyphs, spelled digits and written-out at and dot signs, identifiers are
found in the rewritten text, and their spans are mapped back to the source.

A transducer is a list of edits (source range, replacement).  Only edits are
kept, not a position for every character: between two edits source and rewritten
text run in step, so a position is mapped by the edit before it.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combisieve.llm.columns import array_udf

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "array<struct<kind:string,start:bigint,end:bigint,value:string,disguised:boolean>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("disguised", pa.bool_())])

# The local part is a run of these right before the sign, so the sign is looked
# for and the run is taken backwards: no start is tried twice.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that no match has consumed is entered at its first digit only.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
# A chain of fewer than 14 digits is no card whatever is tried.
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, index of kind, end)`` in order: leftmost non-overlapping matches
    of each kind; a match that fails its check is dropped."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            out.append((start, 0, free))
        else:
            # the run before the next sign cannot reach over this one
            free = max(free, at + 1)
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# Letters of other scripts that look like ASCII ones, in their order.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "α": "a", "ο": "o", "ν": "v", "ρ": "p",
    "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "․": ".", "‐": "-", "‑": "-", "–": "-", " ": " ", " ": " ", " ": " ",
}
_LOOKALIKES |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full width
for _zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7E2):  # digits of other scripts and styles
    _LOOKALIKES |= {chr(_zero + i): str(i) for i in range(10)}
_LOOKALIKE = re.compile(f"[{re.escape(''.join(_LOOKALIKES))}]")
# English number words.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_WORD = "|".join(_SPELLED)
# a run of at least three figures, spelled or written, one of them spelled
_FIGURES = re.compile(rf"(?ai)(?<![a-z0-9])(?:plus[\x20])?(?:(?:{_WORD}|[0-9]++)(?:[\x20.-]|\x20-\x20|,\x20)){{2,}}(?:{_WORD}|[0-9]++)(?![a-z0-9])")
_FIGURE = re.compile(rf"(?ai){_WORD}|[0-9]+|plus|,\x20")
# the word or the sign itself in brackets, or the word between blanks
_SIGN = r"\x20?(?:\[\x20?(?:{0}|{1})\x20?\]|\(\x20?(?:{0}|{1})\x20?\)|\{{\x20?(?:{0}|{1})\x20?\}}|<\x20?(?:{0}|{1})\x20?>)\x20?|\x20{0}\x20"
_AT, _DOT = _SIGN.format("at", "@"), _SIGN.format("dot", r"\.")
# a written-out sign counts inside something shaped like a whole address; signs
# are looked for at every place, since one may begin where another ends
_EACH_AT, _EACH_DOT = re.compile(rf"(?i)(?=(@|{_AT}))"), re.compile(rf"(?i)(?=({_DOT}))")
_ATOM, _LABEL, _ATOM_SIGN = re.compile(r"(?i)[a-z0-9_%+-]+"), re.compile(r"(?i)[a-z0-9-]+"), re.compile(r"(?i)[a-z0-9._%+-]")
_SIGNS = re.compile(rf"(?i)(?P<at>{_AT})|(?P<dot>{_DOT})")
_SIGN_HINT = re.compile(r"(?i)[\[({<\x20]\x20?(?:at|dot)\x20?[\])}>\x20]|[\[({<]\x20?[.@]\x20?[\])}>]")
# a dot sign counts between figures, too
_BETWEEN = re.compile(rf"(?ai)(?<=[0-9])(?:{_DOT})(?=[0-9])")
# Runs of spelled figures with dot signs between them.  Between two signs spelled
# and written figures may mix; at the ends of a chain they are other words' neighbours.
_SPELT = rf"(?:{_WORD})(?![a-z0-9])"
_RUN = rf"(?:{_SPELT}(?:[\x20-]{_SPELT})*+|[0-9]++)"
_MIXED = rf"(?:{_SPELT}|[0-9]++)(?:[\x20-](?:{_SPELT}|[0-9]++))*+"
# A chain is only tried at a run with a dot sign behind it, so that none is
# scanned from each of its words.
_TOKEN = re.compile(rf"(?ai)(?<![a-z0-9])(?:(?P<plus>plus)(?=\x20)|{_RUN})")
_DOTTED = re.compile(rf"(?ai)(?:\.|{_DOT})(?=[a-z0-9])")
_CHAIN = re.compile(rf"(?ai){_RUN}(?:(?:\.|{_DOT})(?:{_MIXED}(?=\.[a-z0-9]|{_DOT})|{_RUN}))++")
_CHAINED = re.compile(rf"(?ai){_MIXED}")


def _rewritten(text: str, edits: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, new in edits:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


def _back(position: int, edits: list[tuple[int, int, str]], made: list[int], end: bool) -> int:
    """Source position of a border in the rewritten text.  A border inside a
    replacement goes to the outer border of what was replaced."""
    i = bisect.bisect_left(made, position) - 1 if end else bisect.bisect_right(made, position) - 1
    if i < 0:
        return position
    start, stop, new = edits[i]
    inside = position - made[i]
    if inside < len(new) or end and inside == len(new):
        return stop if end and inside > 0 else start
    return stop + inside - len(new)


def _made(edits: list[tuple[int, int, str]]) -> list[int]:
    """Where each replacement starts in the rewritten text."""
    out, moved = [], 0
    for start, end, new in edits:
        out.append(start + moved)
        moved += len(new) - (end - start)
    return out


def _homoglyphs(text: str) -> list[tuple[int, int, str]]:
    return [] if text.isascii() else [(m.start(), m.end(), _LOOKALIKES[m[0]]) for m in _LOOKALIKE.finditer(text)]


def _chains(text: str) -> list[tuple[int, int, str]]:
    """Spelled figures beside a dot sign: a run is one number, without blanks.
    A ``plus`` before it counts, with any written figures between."""
    out, at, plus, after = [], 0, None, -1
    while token := _TOKEN.search(text, at):
        at = token.end()
        if token["plus"]:
            plus, after = (token.start(), at + 1), at + 1
            continue
        chain = _CHAIN.match(text, token.start()) if _DOTTED.match(text, at) else None
        if chain is None:
            if token.start() == after and token[0].isdigit() and text[at : at + 1] in (" ", "-"):
                after = at + 1
            else:
                plus, after = None, -1
            continue
        runs = []
        for run in _CHAINED.finditer(text, chain.start(), chain.end()):
            figures = [m[0].lower() for m in _FIGURE.finditer(run[0])]
            if not all(f.isdigit() for f in figures):
                runs.append((run.start(), run.end(), "".join(_SPELLED.get(f, f) for f in figures)))
        if runs and plus and token.start() == after:
            out.append((*plus, "+"))
        out += runs
        at, plus, after = chain.end(), None, -1
    return out


def _figures(text: str) -> list[tuple[int, int, str]]:
    out = []
    for run in _FIGURES.finditer(text):
        found = list(_FIGURE.finditer(run[0]))
        if all(m[0].isdigit() or m[0] == ", " for m in found):
            continue
        for m in found:
            word = m[0].lower()
            if word == ", ":
                out.append((run.start() + m.start(), run.start() + m.end(), " "))
            elif not word.isdigit():
                new = "+" if word == "plus" else _SPELLED[word]
                end = m.end() + (word == "plus")  # with the space behind it
                out.append((run.start() + m.start(), run.start() + end, new))
    return out


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Ranges shaped like a whole address, with plain or written-out signs.

    From each at sign the parts are walked to both sides, between the end of the
    last address and the next at sign, so the work is linear in the text."""
    ats = [m.span(1) for m in _EACH_AT.finditer(text)]
    if not ats:
        return
    dots = [m.span(1) for m in _EACH_DOT.finditer(text)]
    behind, before = {a: b for a, b in dots}, {b: a for a, b in reversed(dots)}
    atoms, labels = {m.end(): m.start() for m in _ATOM.finditer(text)}, {m.start(): m.end() for m in _LABEL.finditer(text)}
    free = 0
    for sign, end in ats:
        starts, at = [], sign
        while at is not None and atoms.get(at, -1) >= free:
            starts.append(atoms[at])
            at = starts[-1] - 1 if text[starts[-1] - 1 : starts[-1]] == "." else before.get(starts[-1])
        start = next((s for s in reversed(starts) if not (s and _ATOM_SIGN.match(text, s - 1))), None)
        stop, parts = labels.get(end), 0
        while start is not None and stop is not None:
            end = stop
            parts += 1
            stop = labels.get(end + 1) if text[end : end + 1] == "." else labels.get(behind.get(end))
        if parts > 1:
            yield start, end
            free = end


def _signs(text: str) -> list[tuple[int, int, str]]:
    if not _SIGN_HINT.search(text):
        return []
    found = {(m.start(), m.end(), ".") for m in _BETWEEN.finditer(text)}
    for start, end in _addresses(text):
        for m in _SIGNS.finditer(text, start, end):
            found.add((m.start(), m.end(), "@" if m["at"] else "."))
    return sorted(found)


TRANSDUCERS = (_homoglyphs, _chains, _figures, _signs)


def disguised_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, index of kind, end, plain value)`` of identifiers that only the
    rewritten text shows, in source positions."""
    stages, plain = [], text
    for transducer in TRANSDUCERS:
        edits = transducer(plain)
        if edits:
            stages.append((edits, _made(edits)))
            plain = _rewritten(plain, edits)
    if not stages:
        return []
    out = []
    for start, kind, end in base_spans(plain):
        a, b = start, end
        for edits, made in reversed(stages):
            a, b = _back(a, edits, made, False), _back(b, edits, made, True)
        if text[a:b] != plain[start:end]:
            out.append((a, kind, b, plain[start:end]))
    return out


def spans_of(text: str | None) -> list[dict]:
    """All spans of one text, by start, then kind, then end."""
    text = text or ""
    plain = base_spans(text)
    spans = {(start, kind, end): (text[start:end], False) for start, kind, end in plain}
    for start, kind, end, value in disguised_spans(text):
        spans.setdefault((start, kind, end), (value, True))
    return [
        {"kind": KINDS[kind], "start": start, "end": end, "value": value, "disguised": disguised}
        for (start, kind, end), (value, disguised) in sorted(spans.items())
    ]


def find_identifiers(docs: DataFrame, text: str = "text", name: str = "identifiers") -> DataFrame:
    """``docs`` with an array ``name`` of identifiers in the whole text:
    ``kind`` (email, ip, card, phone), ``start``, ``end`` (code points, end
    exclusive), ``value`` (plain form) and ``disguised``.

    Plain identifiers are always listed; those that only the rewritten text
    shows are listed with the source range that they cover.  A NULL or empty text
    has none.  Rows are judged one by one: repeated rows get equal arrays, an
    empty table gives an empty table, other columns pass through (one called
    ``name`` is replaced).
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([spans_of(t.as_py()) for t in texts], pa.list_(_SPAN))

    return docs.withColumn(name, array_udf(run, SCHEMA)(F.col(text)))


def mask_identifiers(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every identifier in ``text`` replaced by ``<KIND>``; of
    overlapping ones the first, then the longest, is replaced whole.

    A NULL text stays NULL, an empty one empty.  Rows are masked one by one:
    repeated rows stay repeated, an empty table gives an empty table, other
    columns pass through.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([_masked(t.as_py()) for t in texts], pa.string())

    return docs.withColumn(text, array_udf(run, "string")(F.col(text)))


def _masked(text: str | None) -> str | None:
    if text is None:
        return None
    edits, free = [], 0
    for s in sorted(spans_of(text), key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= free:
            edits.append((s["start"], s["end"], f"<{s['kind'].upper()}>"))
            free = s["end"]
    return _rewritten(text, edits)
