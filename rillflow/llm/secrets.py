"""Secret scans by assignment-aware lexing (operator 11).

Three fixed patterns give the base spans: `assign` (a sensitive word, a separator and a value of six characters
or more; the span is the whole match), `access` (cloud access keys) and `hex` (long hexadecimal runs).  The method
adds spans of kind `literal`: source and configuration syntax is read into pairs of a target name and an expression
(assignments, annotated ones, keyed entries, call arguments, name and value given to one call, elements, environment
lines).  An expression is literals and names joined by concatenation, defaults or interpolation.  Names keep the
literals that they were given, so a literal is followed through any number of assignments in text order, and it is
scored by every target that it reaches: weight of the name times strength of the literal times certainty of the way.
A literal span is the text between the quotes, or a whole unquoted value.

Defined results: a null text is empty; an empty text, or one without a find, gives an empty list; offsets are code
points of the whole text, the end is exclusive; equal texts give equal spans and repeated rows are kept; a literal
reached by several targets is given once, with its best score; columns named like the added one are replaced, others
stay, whatever their names; an empty table gives no rows.  Texts are read one at a time, whatever their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anyname import field, kept_fields, map_arrow

KINDS = ("assign", "access", "hex", "literal")
FOUND = "array<struct<kind: string, start: bigint, end: bigint, name: string, score: double>>"

# Base patterns, fixed values; letters of the first in either case, of ASCII only.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the run of a shorter match holds no longer one
_HEX = re.compile(r"[0-9a-f]{24,}")

#: weight of the parts of a target name, combined as 1 - product(1 - weight)
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 0.9, "token": 0.8, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.7,
    "jwt": 0.7, "oauth": 0.6, "auth": 0.5, "authorization": 0.6, "private": 0.5, "key": 0.4, "api": 0.3, "access": 0.3, "signing": 0.4, "encryption": 0.4, "salt": 0.5, "webhook": 0.4,
    "session": 0.3, "cookie": 0.4, "pin": 0.4, "dsn": 0.4, "login": 0.3, "cipher": 0.4,
}
#: parts that say the literal is about a secret, not one
HARMLESS = frozenset("count counts length len size limit max min hint label placeholder field name names path file filename dir url uri type policy expiry expires ttl timeout prompt regex pattern public header format column id".split())
_FILLER = re.compile(r"(?i)^(?:change.?me|none|null|nil|true|false|undefined|todo|fixme|example|sample|dummy|test|your.*|my.?(?:password|secret|token|key)|password|secret|token|<.*>|\*+|x+|\.+|-+|_+)$")

_NAME = r"[A-Za-z_$@][\w$]*+(?:-[A-Za-z_]\w*+)*+(?:(?:\.|->|::)[A-Za-z_$@][\w$]*+)*+"
_STRING = r"""(?:[rbfuRBFU]{1,2}(?=["']))?(?:\"{3}(?P<s3>.*?)\"{3}|'{3}(?P<t3>.*?)'{3}|"(?P<s1>(?:[^"\\\n]|\\.)*+)"|'(?P<t1>(?:[^'\\\n]|\\.)*+)'|`(?P<b1>[^`\n]*+)`)"""
_string, _name = re.compile(_STRING, re.DOTALL), re.compile(_NAME)
_PAIR = re.compile(
    rf"""(?<![\w$.@])(?:
 (?:(?P<q>["'`])(?P<key>[\w$@.\x20-]++)(?P=q)|(?P<name>{_NAME})(?:\[\s*+(?P<q2>["'])(?P<item>[^"'\n\]]++)(?P=q2)\s*+\])*+)
  [ \t]*+(?::[ \t]*+[A-Za-z_][\w.<>,\[\]|&*?]*+[ \t]*+(?==[^=]))?+(?P<op>:=|=>|\+=|=(?![=~>])|:(?![:/])) # assignments and keyed entries
 |(?P<call>{_NAME})\([ \t]*+(?=["'])                                                                     # call with a literal first
 |(?:ENV|SET|set|env)[ \t]++(?P<env>{_NAME})(?P<gap>[ \t]++)(?=\S)                                       # environment lines
 )|<(?P<tag>[A-Za-z_][\w.-]*+)>(?P<inner>[^<>]++)</(?P=tag)>""",
    re.VERBOSE,
)
_LINE_LEAD = re.compile(r"^[ \t]*(?:(?:export|set|env|ENV|SET|-|--|const|let|var|#|//)[ \t]*)?(?:--)?[\"']?$")
_BARE = re.compile(r"""[^\s"'`,;{}()\[\]<>]++(?=[ \t]*+(?:[;,][ \t]*+)?(?:[#;].*)?(?:\r?\n|\Z))""")
_JOIN = re.compile(r"(?:[ \t]*+\\?\r?\n)?[ \t]*+(?:\+|\.\.?(?=[ \t]*+[\"'$A-Za-z])|\|\||\?\?|<>|&|\bor\b|,(?=\s*+$))[ \t]*+(?:\r?\n[ \t]*+)?|[ \t]++(?=[\"'])")
_HOLE = re.compile(r"\$\{\s*([\w.]+)\s*\}|\$\(?([A-Za-z_]\w*)\)?|%\(([A-Za-z_]\w*)\)s|\{\{?\s*([A-Za-z_][\w.]*)\s*\}?\}")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_AT_CALL = 0.6  # certainty that an argument of a call is what the target holds


def name_weight(name: str) -> float:
    """0 to 1: how likely a target of this name holds a secret."""
    rest, harmless = 1.0, 1.0
    for part in (p.lower() for p in _PARTS.findall(name)):
        weight = SENSITIVE.get(part) or (SENSITIVE.get(part[:-1]) if part.endswith("s") else None)
        rest *= 1 - (weight or 0.0)
        harmless *= 0.25 if part in HARMLESS else 1.0
    return (1 - rest) * harmless


def literal_strength(text: str) -> float:
    """0 to 1: how likely a literal is a secret by itself; fillers and short ones are none."""
    core = _HOLE.sub("", text).strip()
    n = len(core)
    if n < 6 or _FILLER.match(core):
        return 0.0
    bits = -sum(k * math.log2(k / n) for k in Counter(core).values())
    classes = sum(any(map(test, core)) for test in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in core)
    blanks = sum(c.isspace() for c in core)
    return min(1.0, bits / 16) * (0.6 if classes == 1 else 1.0) / (1 + blanks)


Piece = tuple[int, int, float]  # start, end, certainty


class _Reader:
    """Pairs of one text, in text order."""

    def __init__(self, text: str):
        self.text, self.held, self.found = text, {}, {}

    def look(self, name: str) -> list[Piece]:
        name = name.lstrip("$@")
        return self.held.get(name) or self.held.get(re.split(r"\.|->|::", name)[-1], [])

    def literal(self, m: re.Match, certainty: float = 1.0) -> list[Piece]:
        """The literal itself and what its interpolated names hold."""
        a, b = next(m.span(g) for g in ("s3", "t3", "s1", "t1", "b1") if m[g] is not None)
        out = [(a, b, certainty)]
        if "$" in self.text[a:b] or "{" in self.text[a:b] or "%(" in self.text[a:b]:
            for hole in _HOLE.finditer(self.text, a, b):
                out += [(s, e, c * certainty) for s, e, c in self.look(next(g for g in hole.groups() if g))]
        return out

    def expression(self, at: int) -> tuple[list[Piece], int]:
        text, pieces = self.text, []
        while True:
            if m := _string.match(text, at):
                pieces, at = pieces + self.literal(m), m.end()
            elif m := _name.match(text, at):
                at = m.end()
                if text[at : at + 1] == "(":
                    inner, at = self.arguments(at + 1)
                    pieces = pieces + inner
                else:
                    pieces = pieces + self.look(m[0])
            else:
                return pieces, at
            if not (m := _JOIN.match(text, at)):
                return pieces, at
            at = m.end()

    def arguments(self, at: int) -> tuple[list[Piece], int]:
        """Literals and names given to a call, to its bracket or the end of what can be read."""
        text, pieces = self.text, []
        while at < len(text):
            if m := _string.match(text, at):
                pieces, at = pieces + self.literal(m, _AT_CALL), m.end()
            elif m := _name.match(text, at):
                pieces, at = pieces + [(s, e, c * _AT_CALL) for s, e, c in self.look(m[0])], m.end()
            elif text[at] in " \t,+":
                at += 1
            else:
                return pieces, at + (text[at] == ")")
        return pieces, at

    def bind(self, target: str, pieces: list[Piece], more: bool = False) -> None:
        pieces = list(dict.fromkeys(pieces))
        plain = target.lstrip("$@")
        for name in {plain, re.split(r"\.|->|::", plain)[-1]}:
            self.held[name] = [*self.held.get(name, []), *pieces] if more else pieces
        weight = name_weight(target)
        for a, b, certainty in pieces if weight else ():
            score = weight * certainty * literal_strength(self.text[a:b])
            if score > self.found.get((a, b), (0.0, ""))[0]:
                self.found[a, b] = (score, target)

    def read(self) -> dict[tuple[int, int], tuple[float, str]]:
        text, at = self.text, 0
        while m := _PAIR.search(text, at):
            at = m.end()
            if m["tag"]:
                a, b = m.span("inner")
                lead = len(m["inner"]) - len(m["inner"].lstrip())
                self.bind(m["tag"], [(a + lead, a + max(lead, len(m["inner"].rstrip())), 1.0)])
            elif m["call"]:
                self.call(m["call"], at)
            elif m["env"]:
                if bare := _BARE.match(text, at):
                    self.bind(m["env"], [(*bare.span(), 1.0)])
            else:
                at = self.assignment(m)
        return self.found

    def call(self, name: str, at: int) -> None:
        """name("value"), or any call with a name and a value as its first two literals."""
        first = _string.match(self.text, at)
        if not first:
            return
        one = self.literal(first)
        comma = re.compile(r"[ \t]*,\s*").match(self.text, first.end())
        if comma and (second := _string.match(self.text, comma.end())):
            self.bind(self.text[one[0][0] : one[0][1]], self.literal(second))
        elif self.text[first.end() : first.end() + 1] == ")":
            self.bind(name, one)

    def assignment(self, m: re.Match) -> int:
        text, at = self.text, m.end()
        target = m["key"] or (f"{m['name']}.{m['item']}" if m["item"] else m["name"])
        blank = re.compile(r"[ \t]*+(?:\r?\n[ \t]++(?=[\"']))?").match(text, at)
        start = blank.end()
        pieces, end = self.expression(start)
        bare = _BARE.match(text, start)
        line = text.rfind("\n", 0, m.start()) + 1
        word = bare and bare.end() == end and not any(c.isdigit() for c in bare[0])  # a name that holds nothing here
        if bare and bare.end() >= end and not word and not pieces and _LINE_LEAD.match(text[line : m.start("name") if m["name"] else m.start("key")]):
            pieces, end = [(*bare.span(), 1.0)], bare.end()
        if pieces:
            self.bind(target, pieces, more=m["op"] == "+=")
        return at  # an expression may hold pairs of its own


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the three patterns, leftmost and without overlap for each, that are long enough."""
    out = [(*m.span(), "access") for m in _ACCESS.finditer(text)] + [(*m.span(), "hex") for m in _HEX.finditer(text)]
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return out


def scan_text(text: str, least: float = 0.35) -> list[dict]:
    """All spans of a text by start, then kind."""
    rows = [{"kind": kind, "start": a, "end": b, "name": None, "score": None} for a, b, kind in base_spans(text)]
    if any(sign in text for sign in ("=", ":", "(", "<", "ENV", "SET", "set", "env")):
        rows += [{"kind": "literal", "start": a, "end": b, "name": name, "score": score} for (a, b), (score, name) in _Reader(text).read().items() if score >= least]
    return sorted(rows, key=lambda r: (r["start"], KINDS.index(r["kind"]), r["end"]))


def scan(docs: DataFrame, least: float = 0.35, text: str = "text", out: str = "found") -> DataFrame:
    """Adds `out` (kind, start, end, name, score of each span) and takes the text away; nothing is shuffled."""
    fields = kept_fields(docs, (text, out))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t.as_py() or "", least) for t in batch.column(batch.schema.get_field_index(text))]
            rest = [i for i, name in enumerate(batch.schema.names) if name not in (text, out)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(found, kind)], names=[*(batch.schema.names[i] for i in rest), out])

    return map_arrow(docs, run, [*fields, field(out, FOUND)])


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def listed(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of these kinds, joined by commas."""
    some = F.filter(found, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
