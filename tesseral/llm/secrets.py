"""Secret scans by assignment-aware lexing.

Besides three patterns of fixed form, a text is lexed as source or configuration: quotes of all kinds with their escapes, words,
signs, brackets, tags and newlines are tokens, and those like `name = "literal"`, `name: literal`, `"name": ["literal", ...]`,
`<name>literal</name>` or `export NAME=other + "x"` become pairs of a name and an expression. Names bound to constants are propagated
through later expressions, and each literal that ends up in a name is scored by how sensitive the name sounds and how random
the value looks. Literals that score enough are spans of the kind `literal`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tesseral.llm.common import text_or_empty
from tesseral.llm.words import let_go

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "literal")

#: Fixed forms. Letters of the first are in either case; the others are runs and so maximal.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6

#: Tokens. A quote that isn't closed is a mark; so is one within a word, as in "it's". Signs of two marks that don't assign are told apart here.
_TOKEN = re.compile(
    r"""(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*+"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3})
    |(?P<quoted>"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|(?<!\w)'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`)
    |(?P<tag><[A-Za-z_][\w.:-]*+>)
    |(?P<not>::|[=!<>]=++|->)
    |(?P<sign>:=|=>|[:=])
    |(?P<word>[^\s"'`,;<>(){}\[\]=:+&|]++)
    |(?P<line>\n)
    |(?P<mark>\S)""",
    re.A | re.S | re.X,
)
#: Marks that end a bare value; others don't, as base64 holds + and = and urls hold colons.
_ENDS = frozenset("\"'`,;<>(){}[]&|")
_NAME_MARKS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
_NAME = re.compile(r"[$@%-]*+([A-Za-z_][\w.-]*+)\Z", re.A)
_CLOSE = {"(": ")", "[": "]", "{": "}"}
#: In pairs of pairs, as in name="password" value="...": the first holds the name of the second's value.
_NAMERS, _NAMED = {"key", "name", "id"}, {"value", "content"}
#: Values that begin like this, or are this, are placeholders; none needs more than the first _HEAD characters.
_PLACEHOLDER = re.compile(r"[<${].*|true|false|null|none|changeme|example.*|your.*", re.I | re.S)
_HEAD = 9
#: Words after which a name and its value stand side by side; words before a value that tell how it is used; operators before a sign.
_SETTERS = frozenset(("#define", "set", "setx"))
_SCHEMES = frozenset(("bearer", "basic", "token"))
_OPERATORS = frozenset("+|&?")
#: Words in names, and how much each says that the value is secret.
SENSITIVE = {"password": 3.0, "passwd": 3.0, "pwd": 2.5, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "api_key": 3.0, "credential": 2.5, "credentials": 2.5, "private_key": 3.0, "access_key": 3.0, "auth": 1.5, "bearer": 2.0, "signing_key": 2.5, "client_secret": 3.0, "connection_string": 2.0}
_SENSITIVE = re.compile("|".join(sorted(SENSITIVE, key=len, reverse=True)))
_HINT = re.compile("pass|pwd|secret|token|key|cred|auth|bearer|connection", re.I | re.A)


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float = 1.0


def base_spans(text: str) -> list[Span]:
    """Spans of the three fixed forms; offsets count code points, ends are exclusive."""
    found = [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [Span("hex", *m.span()) for m in HEX.finditer(text)]


def name_score(name: str) -> float:
    """The most telling word in a name written in any case style; 0 if there is none."""
    plain = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|[.\-]", "_", name).lower()
    return max((SENSITIVE[w] for w in _SENSITIVE.findall(plain)), default=0.0)


def value_score(value: str) -> float:
    """0 to 2: long values of many kinds of characters look random; words, numbers and placeholders don't."""
    return _random(len(value), Counter(value), value[:_HEAD])


def _random(length: int, counts: Counter, head: str) -> float:
    if length < 6 or len({c.lower() for c in counts}) == 1 or _PLACEHOLDER.fullmatch(head):
        return 0.0
    bits = -sum(r * math.log2(r) for n in counts.values() if (r := n / length))
    letters = "".join(counts)
    kinds = sum(bool(re.search(p, letters)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, bits / 3.5) * (0.25 + 0.25 * kinds) + min(length, 30) / 40


class _Value:
    """A literal (start, end) or the joined values of `parts`, held by reference however long they are."""

    __slots__ = ("start", "end", "parts", "told", "score")

    def __init__(self, start: int = 0, end: int = 0, parts: tuple[_Value, ...] = ()):
        self.start, self.end, self.parts = start, end, parts
        self.told: tuple[int, Counter, str] | None = None
        self.score = 0.0


def _told(value: _Value, text: str) -> tuple[int, Counter, str]:
    """Length, characters and beginning of the whole value: all that its score depends on."""
    todo = [value]
    while todo:
        v = todo[-1]
        missing = [p for p in v.parts if p.told is None]
        if missing:
            todo += missing
            continue
        todo.pop()
        if v.told is not None:
            continue
        if not v.parts:
            v.told = v.end - v.start, Counter(text[v.start : v.end]), text[v.start : min(v.end, v.start + _HEAD)]
            continue
        counts: Counter = Counter()
        for p in v.parts:
            counts.update(p.told[1])
        v.told = sum(p.told[0] for p in v.parts), counts, "".join(p.told[2] for p in v.parts[:_HEAD])[:_HEAD]
    return value.told


class _Lexed:
    """The tokens of a span of text: kinds, starts and ends; the index of the token that closes each opening bracket; and for each token that of the
    one after the bare value that would begin with it."""

    def __init__(self, text: str, start: int, end: int):
        self.text = text
        self.kind, self.a, self.b = [], [], []
        for m in _TOKEN.finditer(text, start, end):
            self.kind.append(m.lastgroup)
            self.a.append(m.start())
            self.b.append(m.end())
        self.end = end
        self.close: dict[int, int] = {}
        opened: list[int] = []
        for i, kind in enumerate(self.kind):
            if kind == "mark":
                c = text[self.a[i]]
                if c in _CLOSE:
                    opened.append(i)
                elif opened and c == _CLOSE[text[self.a[opened[-1]]]]:
                    self.close[opened.pop()] = i
        n = len(self.kind)
        self.after = list(range(1, n + 1))
        for i in range(n - 2, -1, -1):
            k = i + 1
            if self.a[k] == self.b[i] and (self.kind[k] in ("sign", "not") or self.kind[k] == "mark" and text[self.a[k]] not in _ENDS or self.kind[k] == "word" and not (k + 1 < n and self.kind[k + 1] == "sign" and _HINT.search(text, self.a[k], self.b[k]))):
                self.after[i] = self.after[k]
        #: Where the value begins behind the types and names of a chain of assignments that starts at a token.
        self.value_at = list(range(n + 2))
        for i in range(n - 3, -1, -1):
            if self.kind[i] == "word" and self.kind[i + 1] == "sign" and text[self.a[i + 1]] == "=" and self.a[i + 1] > self.b[i]:
                self.value_at[i] = self.value_at[i + 2]
        #: The values that begin at tokens, as read before: all names of a chain have the same.
        self.values: dict[int, _Value | None] = {}

    def is_(self, i: int, kind: str, what: str = "") -> bool:
        return i < len(self.kind) and self.kind[i] == kind and (not what or self.text[self.a[i]] in what)

    def past_lines(self, i: int) -> int:
        while self.is_(i, "line"):
            i += 1
        return i

    def inner(self, i: int) -> tuple[int, int]:
        """A quoted token without its quotes."""
        n = 3 if self.kind[i] == "long" else 1
        return self.a[i] + n, self.b[i] - n

    def indent(self, i: int) -> int:
        """How far from the start of its line a token stands."""
        return self.a[i] - self.text.rfind("\n", 0, self.a[i]) - 1

    def name_before(self, i: int) -> str | None:
        """The name that the sign at i assigns to: a word, a quoted name, or one in brackets as in settings["name"]."""
        if not i:
            return None
        k = i - 1
        while k and self.b[k] == self.a[k + 1] and (self.kind[k] == "mark" and self.text[self.a[k]] in _OPERATORS or self.kind[k] == "word" and self.text[self.a[k] : self.b[k]] == "??"):
            k -= 1  # as in += or ??=
        if self.is_(k, "mark", "]") and k >= 2 and self.kind[k - 1] == "quoted" and self.is_(k - 2, "mark", "["):
            k -= 1
        if self.kind[k] not in ("quoted", "word"):
            return None
        a, b = self.inner(k) if self.kind[k] == "quoted" else (self.a[k], self.b[k])
        at = b
        while at > a and self.text[at - 1] in _NAME_MARKS:
            at -= 1
        return self.text[at:b].lstrip("0123456789.-") or None


def literal_spans(text: str, threshold: float = 3.4) -> list[Span]:
    """Literals that reach a sensitive name, straight or through other names.

    Expressions may join literals and names with + or by writing them side by side; a name stands for its latest constant
    before it. What a list holds is judged piece by piece; calls give their quoted arguments that have a digit. A value may stand on the
    next line. A span is a literal without its quotes, where it is written. Quoted literals are lexed inside, too; pairs
    there end with them. Names, literals, lists and constants have any length.
    """
    if not _HINT.search(text):
        return []
    known: dict[str, _Value] = {}
    values: list[_Value] = []  # those of several parts come after their parts

    def literal(a: int, b: int) -> _Value:
        values.append(_Value(a, b))
        return values[-1]

    def judged(name: str, value: _Value) -> None:
        if told := name_score(name):
            score = told + _random(*_told(value, text))
            if score >= threshold:
                value.score = max(score, value.score)

    def part(lex: _Lexed, i: int, *, alone: bool = False) -> tuple[_Value | None, int]:
        """The literal or constant at token i, and the token after it. Bare words are literals if they have a digit or are no names."""
        if lex.is_(i, "word") and lex.b[i] - lex.a[i] <= 2 and (lex.is_(i + 1, "quoted") or lex.is_(i + 1, "long")) and lex.a[i + 1] == lex.b[i]:
            i += 1  # a prefix as in f"..."
        if lex.is_(i, "quoted") or lex.is_(i, "long"):
            a, b = lex.inner(i)
            return (literal(a, b) if a < b else None), i + 1
        if not lex.is_(i, "word"):
            return None, i
        a, after = lex.a[i], lex.after[i]
        b = lex.b[after - 1]
        if (word := _NAME.match(text, a, lex.b[i])) and word[1] in known and (b == lex.b[i] or text[lex.b[i]] == "+"):
            return known[word[1]], i + 1
        while b > a and text[b - 1] in ".!?:":
            b -= 1
        if a == b or alone and not lex.is_(after, "line") and after < len(lex.kind):
            return None, after
        if b <= lex.b[i] and _NAME.match(text, a, b) and not any(map(str.isdigit, text[a:b])):
            return None, after
        return literal(a, b), after

    def expression(lex: _Lexed, i: int) -> _Value | None:
        """The joined parts from token i on."""
        parts: list[_Value] = []
        while True:
            got, after = part(lex, i)
            if after == i:
                break
            if got is not None:
                parts.append(got)
            i = after
            k = lex.past_lines(i)
            if lex.is_(k, "mark", "+"):
                i = lex.past_lines(k + 1)
            elif lex.is_(i, "word") and text[lex.a[i] : lex.b[i]] in (".", ".."):
                i += 1
            elif not lex.is_(i, "quoted"):
                break
        if len(parts) > 1:
            values.append(_Value(parts=tuple(parts)))
            return values[-1]
        return parts[0] if parts else None

    def assigned(lex: _Lexed, name: str, sign: int) -> None:
        i = sign + 1
        if lex.is_(i, "mark", "|>"):  # block values, perhaps with a sign for how they end
            chomped = lex.is_(i + 1, "mark", "+") or lex.is_(i + 1, "word") and text[lex.a[i + 1] : lex.b[i + 1]] == "-"
            if lex.is_(i + 1 + chomped, "line"):
                i += 1 + chomped
        if lex.is_(i, "line"):
            k = lex.past_lines(i)
            bare = lex.is_(k, "word")
            if lex.is_(k + 1, "sign") or not (bare or lex.is_(k, "quoted") or lex.is_(k, "long")) or bare and lex.indent(k) <= lex.indent(sign - 1):
                return
            value = part(lex, k, alone=True)[0] if bare else expression(lex, k)
        elif lex.is_(i, "mark", "([{"):
            return inside(lex, name, i)
        elif lex.is_(i, "word") and lex.is_(i + 1, "mark", "(") and lex.a[i + 1] == lex.b[i]:
            return inside(lex, name, i + 1, digits=True)
        else:
            i = lex.value_at[i]
            if lex.is_(i, "word") and lex.is_(i + 1, "word") and text[lex.a[i] : lex.b[i]].lower() in _SCHEMES:  # Authorization: Bearer ...
                name, i = text[lex.a[i] : lex.b[i]], i + 1
            if i not in lex.values:
                lex.values[i] = expression(lex, i)
            value = lex.values[i]
        if value is not None:
            known[name] = value
            judged(name, value)

    def inside(lex: _Lexed, name: str, i: int, *, digits: bool = False) -> None:
        """Each literal of the bracket that opens at i, but for those in brackets of their own."""
        if not name_score(name):
            return
        end = lex.close.get(i, i)
        i += 1
        while i < end:
            if i in lex.close:
                i = lex.close[i] + 1
            elif lex.is_(i, "quoted") or lex.is_(i, "long"):
                value, after = part(lex, i)
                if value is not None and not lex.is_(after, "sign") and not (digits and not any(map(str.isdigit, text[value.start : value.end]))):
                    judged(name, value)
                i = after
            else:
                i += 1

    todo = [(0, len(text))]
    while todo:
        start, end = todo.pop()
        lex = _Lexed(text, start, end)
        namer: tuple[str, int] | None = None  # a name given as a value, and where
        for i, kind in enumerate(lex.kind):
            if kind in ("quoted", "long"):
                a, b = lex.inner(i)
                if _HINT.search(text, a, b):
                    todo.append((a, b))
            elif kind == "tag":
                a, b = lex.b[i], text.find("<", lex.b[i], end)
                if b > a and (held := text[a:b].strip()):
                    a = text.index(held, a)
                    judged(text[lex.a[i] + 1 : lex.b[i] - 1], literal(a, a + len(held)))
            elif kind == "mark" and text[lex.a[i]] == "(" and lex.is_(i + 1, "quoted") and lex.is_(i + 2, "mark", ",") and lex.is_(i + 3, "quoted"):
                if name_score(text[slice(*lex.inner(i + 1))]) and (value := part(lex, i + 3)[0]) is not None:  # as in set("api_secret", "...")
                    judged(text[slice(*lex.inner(i + 1))], value)
            elif kind == "word" and lex.is_(i + 1, "word") and text[lex.a[i] : lex.b[i]].lower() in _SETTERS and _NAME.match(text, lex.a[i + 1], lex.b[i + 1]):
                value = None if lex.is_(i + 2, "sign") else part(lex, i + 2)[0]
                if value is not None:
                    judged(text[lex.a[i + 1] : lex.b[i + 1]], value)
            elif (kind == "not" and text[lex.a[i] : lex.b[i]] == "->" or kind == "word" and text[lex.a[i] : lex.b[i]] == "??") and lex.is_(i + 1, "quoted") and (name := lex.name_before(i)):
                if (value := part(lex, i + 1)[0]) is not None:
                    judged(name, value)
            elif kind == "sign" and (name := lex.name_before(i)):
                low = name.lower()
                if low in _NAMERS and lex.is_(i + 1, "quoted"):
                    namer = text[slice(*lex.inner(i + 1))], i
                elif low in _NAMED and namer and i - namer[1] <= 4:
                    name = namer[0]
                assigned(lex, name, i)
    best: dict[tuple[int, int], float] = {}
    for v in reversed(values):
        for p in v.parts:
            p.score = max(v.score, p.score)
        if v.score and not v.parts:
            best[v.start, v.end] = max(v.score, best.get((v.start, v.end), 0))
    return [Span("literal", a, b, s) for (a, b), s in sorted(best.items())]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Rows doc_id, spans: array of (kind, start, end, score), by start and then kind as in KINDS.

    docs: doc_id, text; other columns are not read. Null and empty texts have no spans; repeated rows
    give repeated rows; texts of any length are scanned whole; no documents give no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        let_go()
        order = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            spans = []
            for text in batch.column(1):
                got = base_spans(x := text.as_py()) + literal_spans(x)
                spans.append([s._asdict() for s in sorted(got, key=lambda s: (s.start, order[s.kind], s.end))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")
