"""Secret scan by assignment-aware lexing.

Three base patterns (assignments to telling names, access keys, long hex
runs) are found first. Then each text is lexed as source or configuration
into pairs of a name and a value: ``name = "literal"``, ``name: literal``,
``name := other``, ``name <- "literal"``, ``"name" => "literal"``, ``--name=literal``,
``export NAME=literal``, ``settings["name"] = "literal"``, ``define("NAME", "literal")``,
``<name>literal</name>``, triple quotes and backticks, ``name: |`` with the indented
lines below it, literals side by side or in brackets over several lines, and
values joined with ``+`` or named inside a literal (``f"{other}"``, ``"${other}"``);
the result of a call is no literal. Constants are propagated through names in text order, and a
literal whose value reaches a sensitive name is scored by that name and by its
own shape; literals that pass become spans of kind ``literal``. An assignment
in a comment is scored by its own name, but binds nothing. Names are those of
the whole text: nested scopes share them.

A value may be joined from any number of literals; names share the values
they are joined from, and all are scored in one walk over them, in which each
literal's characters are counted once and taken back once. So time and space
grow with the text and its alphabet. Only a join of two values that were both
joined from many takes time for the literals of one of them, once for each
different pair. No pattern goes over a stretch of text more than a few times,
whatever it holds.

Defined results: null and empty texts have no spans; very long texts are
scanned whole; spans at one place are in the order of ``KINDS``, then by end;
rows are judged one by one, so repeated rows and ties need no rule; an empty
table gives no row; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.storage import extended, packed, quoted

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal: the same as [0-9a-f]+ of 32 and more
_HINT = re.compile(r"[:=]|<-|</|[dD][eE][fF][iI][nN][eE]")

# Parts of names that hold secrets, with their weights.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "secret": 3.0, "token": 2.5, "apikey": 3.0,
    "api": 1.0, "key": 1.5, "credential": 3.0, "credentials": 3.0, "private": 1.5, "auth": 1.5, "bearer": 2.0,
    "access": 1.0, "signature": 1.0, "salt": 1.0, "cert": 1.0,
}

_QUOTED = r"""(?:[bBrRuUfF]{1,2}(?=["']))?(?:\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')"""
_LITERAL = rf"(?:{_QUOTED}|`(?:[^`\\]|\\[\s\S])*+`)"
_LITERALS = rf"{_LITERAL}(?:[ \t]*+{_LITERAL})*+"
_BRACKETS = rf"[\[(]\s*+(?:{_LITERAL}[\s,+]*+)++"
_KEYS = r"""\[[ \t]*+["'][^"'\\\n\]]++["'][ \t]*+\]"""
_LEX = re.compile(
    rf"""(?<![A-Za-z0-9_.-])[0-9.-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)["']?(?P<keys>(?:[ \t]*+{_KEYS})*+)"""
    rf"""[ \t]*+(?::=|=>|<-|=(?![=>])|:(?!=))[ \t]*+"""
    rf"""(?:(?P<value>(?:{_BRACKETS}|{_LITERALS}|[A-Za-z_][A-Za-z0-9_.]*+(?:{_KEYS})++|[A-Za-z0-9+/_.=$@!%^&*~-]++)(?:[ \t]*+\+[ \t]*+(?:{_LITERALS}|[A-Za-z_][A-Za-z0-9_.]*+(?:{_KEYS})*+))*+)|(?P<block>[|>][+-]?[ \t\r]*+\n))"""
)
_PART = re.compile(
    rf"""\"{{3}}(?P<t2>[\s\S]*?)\"{{3}}|'{{3}}(?P<t1>[\s\S]*?)'{{3}}|"(?P<q2>(?:[^"\\\n]|\\.)*+)"|'(?P<q1>(?:[^'\\\n]|\\.)*+)'|`(?P<tick>(?:[^`\\]|\\[\s\S])*+)`|(?P<prefix>[bBrRuUfF]{{1,2}})(?=["'])|(?P<key>[A-Za-z_][A-Za-z0-9_.]*+(?:{_KEYS})++)"""
    r"""|(?P<bare>[A-Za-z0-9/_.=$@!%^&*~-]++(?:\+(?=[A-Za-z0-9/=])[A-Za-z0-9/_.=$@!%^&*~-]++)*+)"""
)
_INSIDE = re.compile(r"\$?\{([A-Za-z_][A-Za-z0-9_.]*+)\}")
_DEFINE = re.compile(r"""(?<![A-Za-z0-9_])[dD][eE][fF][iI][nN][eE][ \t]*+\([ \t]*+["']([A-Za-z_][A-Za-z0-9_.-]*+)["'][ \t]*+,[ \t]*+(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)')""")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*+)>([^<>]*+)</\1>")
_KEY = re.compile(r"""["']([^"'\\\n\]]++)["']""")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_COMMENTS = re.compile(rf"""\\[\s\S]|{_QUOTED}|(?P<comment>(?<![^\s;,(){{}}])(?:#|//)[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z))""")
_SPLIT = re.compile(r"[_.\-]+|(?<=[a-z0-9])(?=[A-Z])")


@dataclass(frozen=True)
class SecretRules:
    min_literal: int = 8
    min_score: float = 3.5
    min_entropy: float = 2.5  # bits a character


def name_weight(name: str) -> float:
    parts = [p.lower() for p in _SPLIT.split(name) if p]
    weights = [SENSITIVE.get(p, 0.0) for p in parts]
    joined = SENSITIVE.get("".join(parts[-2:]), 0.0)
    return max([sum(weights), joined])


def entropy(s: str) -> float:
    return _bits(Counter(s))


def _bits(counts: Counter) -> float:
    n = counts.total()
    return -math.fsum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0  # the same in any order


def literal_score(name: float, value: str, rules: SecretRules) -> float:
    """The name's weight, and up to two points for entropy and for mixed classes of characters."""
    return _score(name, Counter(value), rules)


def _score(name: float, counts: Counter, rules: SecretRules) -> float:
    if counts.total() < rules.min_literal or " " in counts or (bits := _bits(counts)) < rules.min_entropy:
        return 0.0
    classes = any(c.isdigit() for c in counts) + any(c.isupper() for c in counts) + any(c.islower() for c in counts)
    return name + min(1.0, (bits - rules.min_entropy) / 1.5) + (0.0, 0.0, 0.7, 1.0)[classes]


class _Value:
    """What a name holds: the literals of one or two other values, and literals of its own."""

    __slots__ = ("first", "own", "second")

    def __init__(self, first: _Value | None = None, second: _Value | None = None, own: tuple[tuple[int, int], ...] = ()) -> None:
        self.first, self.second, self.own = first, second, own


class _Values:
    """The values of a text and the weights of the names that they reach."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.pairs: dict[tuple[_Value, _Value], _Value] = {}
        self.wanted: dict[_Value, float] = {}

    def joined(self, parts: list[tuple[int, int] | _Value]) -> _Value:
        """The value of all parts; equal pairs of values are one."""
        values = list(dict.fromkeys(p for p in parts if isinstance(p, _Value)))
        own = tuple(dict.fromkeys(p for p in parts if not isinstance(p, _Value)))
        out = values[0] if values else None
        for other in values[1:]:
            out = self.pairs.setdefault((out, other), _Value(out, other))
        return out if out and not own else _Value(out, None, own)

    def reach(self, value: _Value, weight: float) -> None:
        self.wanted[value] = max(weight, self.wanted.get(value, 0.0))

    def passing(self, rules: SecretRules) -> list[_Value]:
        """The values whose characters pass with the greatest weight that they reach.

        The first values of all values make trees. On the walk down a tree ``counts`` is of all literals that the
        value at hand is joined from, each once; what a value added goes again when it is left.
        """
        kin: dict[_Value | None, list[_Value]] = defaultdict(list)
        marked: set[_Value] = set()
        for value in self.wanted:
            while value is not None and value not in marked:
                marked.add(value)
                kin[value.first].append(value)
                value = value.first
        counts: Counter = Counter()
        held: set[_Value] = set()
        found = []
        waiting: list[tuple[_Value, list[_Value] | None]] = [(v, None) for v in reversed(kin[None])]
        while waiting:
            value, added = waiting.pop()
            if added is not None:  # on the way back
                for v in added:
                    held.remove(v)
                    for a, b in v.own:
                        for c, n in Counter(self.text[a:b]).items():
                            counts[c] -= n
                            if not counts[c]:
                                del counts[c]
                continue
            added, more = [], [value]
            while more:
                v = more.pop()
                if v is not None and v not in held:
                    held.add(v)
                    added.append(v)
                    for a, b in v.own:
                        counts.update(self.text[a:b])
                    more += (v.first, v.second)
            if value in self.wanted and _score(self.wanted[value], counts, rules) >= rules.min_score:
                found.append(value)
            waiting.append((value, added))
            waiting += [(v, None) for v in reversed(kin[value])]
        return found

    def spans(self, rules: SecretRules) -> set[tuple[int, int]]:
        """The literals of all passing values."""
        out: set[tuple[int, int]] = set()
        seen: set[_Value] = set()
        waiting: list[_Value | None] = [*self.passing(rules)]
        while waiting:
            v = waiting.pop()
            if v is not None and v not in seen:
                seen.add(v)
                out.update(v.own)
                waiting += (v.first, v.second)
        return out


def _comments(text: str) -> list[tuple[int, int]]:
    if "#" not in text and "//" not in text and "/*" not in text:
        return []
    return [m.span() for m in _COMMENTS.finditer(text) if m["comment"]]


def _full_name(name: str, keys: str) -> str:
    """``settings["db"]["password"]`` is settings.db.password."""
    return ".".join([name, *_KEY.findall(keys)]) if keys else name


def _block(text: str, m: re.Match) -> tuple[list[tuple[int, int]], int]:
    """The lines below a name that are indented more than it, without their blanks, and where they end."""
    line = text.rfind("\n", 0, m.start()) + 1
    indent = len(text[line : m.start()]) - len(text[line : m.start()].lstrip(" -\"'"))
    found, here = [], m.end()
    while here < len(text):
        end = text.find("\n", here)
        end = len(text) if end < 0 else end
        bare = text[here:end].strip()
        begin = here + len(text[here:end]) - len(text[here:end].lstrip())
        if bare and begin - here <= indent:
            break
        if bare:
            found.append((begin, begin + len(bare)))
        here = end + 1
    return found, here


def _parts(text: str, begin: int, end: int, bound: dict[str, _Value]) -> list[tuple[int, int] | _Value]:
    """What a value's text is joined from: literals, and the values of bound names in it or inside its literals."""
    origin: list[tuple[int, int] | _Value] = []
    prefix = ""
    for p in _PART.finditer(text, begin, end):
        kind = p.lastgroup
        if kind == "prefix":
            prefix = p["prefix"].lower()
            continue
        if kind == "key" or kind == "bare" and _NAME.match(p["bare"]):
            known = bound.get(p["bare"] or _full_name(p["key"].partition("[")[0].rstrip(), p["key"]))
            if known is not None:
                origin.append(known)
                continue
        a, b = p.span(kind)
        if kind not in ("key", "bare") and "{" in p[kind]:
            braces, other = "f" in prefix, b - a
            for m in _INSIDE.finditer(text, a, b):
                known = bound.get(m[1]) if braces or m[0][0] == "$" and kind not in ("t1", "q1") else None
                if known is not None:
                    origin.append(known)
                    other -= len(m[0])
            b = b if other else a
        prefix = ""
        if kind != "key" and b > a:
            origin.append((a, b))
    return origin


def lexed_spans(text: str, rules: SecretRules) -> list[tuple[int, int]]:
    """Spans of the literals whose values reach sensitive names."""
    bound: dict[str, _Value] = {}
    values = _Values(text)
    found: set[tuple[int, int]] = set()
    comments, c = _comments(text), 0
    here = 0
    while m := _LEX.search(text, here):
        here = m.end()
        while c < len(comments) and comments[c][1] <= m.start():
            c += 1
        remark = c < len(comments) and comments[c][0] <= m.start()
        name = _full_name(m["name"], m["keys"])
        weight = name_weight(name)
        origin: list[tuple[int, int] | _Value] = []
        if m["block"] is not None:
            if not weight:
                continue  # its lines are lexed as they come
            origin, here = _block(text, m)
        elif text[here : here + 1] != "(":
            origin = _parts(text, m.start("value"), m.end("value"), {} if remark else bound)
        value = values.joined(origin)
        if not remark:
            bound[name] = value
        if weight and value.first is None:
            if literal_score(weight, "".join(text[a:b] for a, b in value.own), rules) >= rules.min_score:
                found.update(value.own)
        elif weight:
            values.reach(value, weight)
    for m in _DEFINE.finditer(text):
        found |= _scored(text, m[1], *m.span(m.lastindex), rules)
    for m in _ELEMENT.finditer(text) if "</" in text else ():
        bare = m[2].strip()
        begin = m.start(2) + len(m[2]) - len(m[2].lstrip())
        found |= _scored(text, m[1], begin, begin + len(bare), rules)
    return sorted(found | values.spans(rules))


def _scored(text: str, name: str, begin: int, end: int, rules: SecretRules) -> set[tuple[int, int]]:
    weight = name_weight(name)
    return {(begin, end)} if weight and literal_score(weight, text[begin:end], rules) >= rules.min_score else set()


def spans(text: str | None, rules: SecretRules = SecretRules()) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind in the order of ``KINDS``."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    if _HINT.search(text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        out += [("literal", a, b) for a, b in lexed_spans(text, rules)]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str | None, found: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with each maximal run of overlapping spans replaced by ``mark``."""
    if not text or not found:
        return text
    parts, here = [], 0
    a, b = found[0][1:]
    for _, s, e in [*found[1:], ("", len(text) + 1, len(text) + 1)]:
        if s <= b:
            b = max(b, e)
            continue
        parts += [text[here:a], mark]
        here, a, b = b, s, e
    return "".join(parts) + text[here:]


def _mapped(docs: DataFrame, text: str, new: list[tuple[str, str]], make) -> DataFrame:
    source, back = packed(docs, text, [n for n, _ in new])
    schema = extended(source.schema, ", ".join(f"{n} {t}" for n, t in new))
    kinds = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for at in range(0, len(batch), 256):
                rows = [make(x.as_py()) for x in column.slice(at, 256)]
                arrays = [pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(new)]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, 256) for c in batch.columns), *arrays], names=schema.names)

    return back(source.mapInArrow(run, schema))


def find_secrets(docs: DataFrame, text: str = "text", rules: SecretRules = SecretRules()) -> DataFrame:
    """Adds ``n_assign, n_access, n_hex, base_sha256, spans`` to every row."""

    def make(value: str | None):
        found = spans(value, rules)
        base = [x for x in found if x[0] != "literal"]
        count = Counter(k for k, _, _ in base)
        return count["assign"], count["access"], count["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)

    return _mapped(docs, text, [("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string")], make)


def redact_secrets(docs: DataFrame, text: str = "text", rules: SecretRules = SecretRules(), mark: str = "[SECRET]") -> DataFrame:
    """Every row, with its secrets replaced in ``text``; the columns stay as they came."""
    out = _mapped(docs, text, [("__redacted", "string")], lambda v: (redact(v, spans(v, rules), mark),))
    return out.select(*(F.col("__redacted").alias(c) if c == text else F.col(quoted(c)) for c in docs.columns))
