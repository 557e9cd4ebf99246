"""Secrets in texts: fixed patterns, and literals that source or configuration gives to secret names.

The lexer reads a text's lines that hold an operator: names, string literals, bare values. It pairs
names with literals in the forms of programs and configuration files (``name = "x"``, ``name: x``,
``"name": "x"``, ``d["name"] = "x"``, ``name="x"`` in tags, ``<name>x</name>``, ``f("name", "x")``,
``setName("x")``, ``--name x``, ``#define NAME "x"``, a password in an address). Constants are
propagated: a name that was given literals, joined or not, stands for them in later values. A pair
counts if the words of the target's name are sensitive and the literal looks like no placeholder.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespan.llm.batches import bounded

# fixed values: kinds in their order, patterns and least lengths
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 12
# runs are maximal, so that their least lengths may stand in the patterns
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Score from which a literal counts as a secret: sensitivity of the name times strength.
THRESHOLD = 0.35
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "pass": 0.9, "passphrase": 1.0, "secret": 1.0,
             "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "authorization": 0.9,
             "bearer": 0.9, "auth": 0.7, "dsn": 0.6, "pin": 0.5, "salt": 0.5}
#: Words that make a "key" a secret one.
KEY_OF = {"api", "access", "secret", "private", "auth", "signing", "encryption", "master", "account",
          "storage", "client", "service", "license"}
#: A name that ends in one of these tells something about a secret, not the secret.
ABOUT = {"count", "length", "len", "size", "max", "min", "limit", "type", "name", "names", "url", "uri",
         "path", "file", "field", "label", "hint", "prompt", "policy", "regex", "pattern", "expires",
         "expiry", "ttl", "timeout", "placeholder", "format", "header", "prefix", "suffix", "index",
         "error", "message", "reset", "enabled", "required", "visible", "id", "ids", "endpoint", "text"}
PLACEHOLDER = re.compile(
    r"change.?me|example|placeholder|your[_ -]|redacted|dummy|sample|todo|xxx|\*\*\*|<.*>|\$\{.*\}|\{\{"
    r".*\}\}|\{\w*\}|%[sdr({]|^(?:none|null|nil|undefined|true|false|test|password|secret|token)$",
    re.IGNORECASE)
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
SCHEME = re.compile(r"(?:bearer|basic|token)\s+", re.IGNORECASE)
ADDRESS = re.compile(r"^(?:[a-z][a-z0-9+.-]*://|[./~][\w.-]*/|[a-z]:\\)", re.IGNORECASE)

STRING = re.compile(r'''(?<!\w)[rbuf]{0,2}(?:"""(?P<a>(?:[^\\]|\\.)*?)"""|\'\'\'(?P<b>(?:[^\\]|\\.)*?)\'\'\''''
                    r'''|"(?P<c>(?:[^"\\\n]|\\.)*)"|'(?P<d>(?:[^'\\\n]|\\.)*)'|`(?P<e>(?:[^`\\]|\\.)*)`)''',
                    re.DOTALL | re.IGNORECASE)
NAME = re.compile(r"[A-Za-z_][\w$]*(?:[.-][A-Za-z_][\w$]*)*", re.ASCII)
REFERENCE = re.compile(r"\$\{?\(?([A-Za-z_]\w*)\)?\}?|\{\{\s*([A-Za-z_][\w.]*)\s*\}\}", re.ASCII)
INSIDE = re.compile(r"\$\{([A-Za-z_][\w.]*)\}|#\{([A-Za-z_][\w.]*)\}", re.ASCII)
OPERATOR = re.compile(r"=>|:=|[?+|]{1,2}=|=(?!=)|:(?![:/])")
SPACE = re.compile(r"(?:[ \t]|\\\n)*")
WIDE_SPACE = re.compile(r"\s*")
BARE = re.compile(r"[^\s,;\"'`<>(){}\[\]]+")
JOIN = re.compile(r"[ \t]*(?:\+(?!=)|\.\.|&(?!&)|\.(?=\s*[\"'$]))\s*")
TOKEN = re.compile(r"(?P<space>\s+)|(?P<name>[A-Za-z_][\w$]*(?:[.-][A-Za-z_][\w$]*)*)|(?P<other>.)",
                   re.ASCII | re.DOTALL)
WRAPPERS = {"str", "string", "bytes", "securestring", "b64decode", "decode", "quote", "trim", "strip"}
TRIGGER = re.compile(r"[=:(]")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)>([^<>]+)</\1>")
OPTION = re.compile(r"(?<!\S)--([A-Za-z][\w-]*)[ \t]+(?!-)([^\s\"'`]+)")
DEFINE = re.compile(r"#[ \t]*define[ \t]+([A-Za-z_]\w*)[ \t]+(?=[\"'])")
USERINFO = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@\"'<>]*:([^\s@/\"'<>]+)@", re.IGNORECASE)
TWO_ARGUMENTS = re.compile(r"\(\s*(?=[\"'])")

Literal = tuple[int, int, str]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the fixed patterns, each kind leftmost and apart."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
             if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def name_words(name: str) -> list[str]:
    """The words of ``dbPassword``, ``API_KEY`` or ``client-secret``, in lower case."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def sensitivity(name: str) -> float:
    """How surely a name is that of a secret, 0 to 1."""
    words = [w for w in name_words(name) if not w.isdigit()]
    if not words or words[-1] in ABOUT or "public" in words:
        return 0.0
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    joined = any(a in KEY_OF and b in ("key", "keys") for a, b in zip(words, words[1:]))
    return 1.0 if joined or any(a + b in ("apikey", "password") for a, b in zip(words, words[1:])) else best


def strength(literal: str) -> float:
    """How much a literal looks like a secret, 0 to 1, by its characters."""
    if PEM.search(literal):
        return 1.0
    scheme = SCHEME.match(literal)
    text = literal[scheme.end():] if scheme else literal.strip()
    if len(text) < 6 or any(c.isspace() for c in text) or PLACEHOLDER.search(text) or ADDRESS.match(text):
        return 0.0
    counts = Counter(text)
    if len(counts) < 4:
        return 0.0
    n = len(text)
    bits = -sum(k * math.log2(k / n) for k in counts.values())
    classes = [any(c.islower() for c in text), any(c.isupper() for c in text),
               any(c.isdigit() for c in text), any(not c.isalnum() for c in text)]
    plain = re.fullmatch(r"[^\W\d]+(?:[._-][^\W\d]+)*", text) is not None or text.isdigit()
    return min(1.0, min(1.0, bits / 40) * (0.4 + 0.2 * sum(classes)) * (0.5 if plain else 1.0))


class Lexer:
    """Name-literal pairs of one text, in their order."""

    def __init__(self, text: str):
        self.text = text
        self.constants: dict[str, list[Literal]] = {}
        self.found: dict[tuple[int, int], float] = {}
        self.field: tuple[str, int] | None = None   # the last name= or key= literal, and its end

    def resolve(self, name: str) -> list[Literal] | None:
        known = self.constants.get(name)
        return known if known is not None else self.constants.get(name.rsplit(".", 1)[-1])

    def string(self, at: int) -> tuple[list[Literal], int] | None:
        """A quoted literal and, of those inside it, the constants that it refers to."""
        m = STRING.match(self.text, at)
        if m is None:
            return None
        kind = m.lastgroup
        literal = (m.start(kind), m.end(kind), m.group(kind))
        whole = REFERENCE.fullmatch(literal[2])
        names = [whole.group(1) or whole.group(2)] if whole else [
            a or b for a, b in INSIDE.findall(literal[2])]
        inner = [x for n in names for x in self.resolve(n) or []]
        return ([] if whole and inner else [literal]) + inner, m.end()

    def value(self, at: int, end: int) -> list[Literal]:
        """The literals that the expression at ``at`` joins; ``end`` is that of the line."""
        text, out, depth = self.text, [], 0
        while True:
            at = (WIDE_SPACE if depth else SPACE).match(text, at).end()
            if text.startswith("(", at):
                depth, at = depth + 1, at + 1
                continue
            quoted = self.string(at)
            if quoted:
                literals, at = quoted
                out += literals
            else:
                rest = text[at:end].rstrip(" \t\r,;")
                name = NAME.match(text, at)
                if name and text.startswith("(", name.end()):
                    if name.group().rsplit(".", 1)[-1].lower() not in WRAPPERS:
                        return out
                    depth, at = depth + 1, name.end() + 1
                    continue
                known = self.resolve(name.group()) if name else None
                after = SPACE.match(text, name.end()).end() if name else at
                chain = OPERATOR.match(text, after) if name else None
                if name and chain and chain.group() in ("=", ":="):   # a: str = "x", a = b = "x"
                    at = chain.end()
                    continue
                if known is not None:
                    out += known
                    at = name.end()
                else:
                    refers = REFERENCE.match(text, at)
                    known = self.resolve(refers.group(1) or refers.group(2)) if refers else None
                    if known is not None:
                        out += known
                        at = refers.end()
                    else:
                        bare = BARE.match(text, at)
                        # a bare value stands alone to the end of its line
                        if not bare or out or bare.group() != rest:
                            return out
                        return [(bare.start(), bare.end(), bare.group())]
            while depth and text.startswith(")", WIDE_SPACE.match(text, at).end()):
                at, depth = WIDE_SPACE.match(text, at).end() + 1, depth - 1
            joined = JOIN.match(text, at)
            if joined:
                at = joined.end()
                continue
            next_at = (WIDE_SPACE if depth else SPACE).match(text, at).end()
            if not STRING.match(text, next_at):
                return out
            at = next_at

    def pair(self, name: str, literals: list[Literal]) -> None:
        """Score the literals of a target and remember them as its constants."""
        if not literals:
            self.constants.pop(name, None)
            return
        self.constants[name] = literals
        self.constants[name.rsplit(".", 1)[-1]] = literals
        sensitive = sensitivity(name)
        if not sensitive:
            return
        whole = sensitive * strength("".join(x for _, _, x in literals))
        if whole >= THRESHOLD:
            for start, end, text in literals:
                if text:
                    self.found[start, end] = max(whole, self.found.get((start, end), 0.0))

    def line(self, at: int, end: int) -> int:
        """Read the tokens from ``at`` to ``end``; returns where it stopped."""
        text, before = self.text, []
        while at < end:
            quoted = STRING.match(text, at)
            if quoted:
                before.append(("string", quoted.group(quoted.lastgroup)))
                at = quoted.end()
                continue
            operator = OPERATOR.match(text, at)
            if operator:
                target = self.target(before)
                if target:
                    literals = self.value(operator.end(), max(end, operator.end()))
                    self.pair(target, literals)
                    self.fields(target, literals)
                before.append(("operator", operator.group()))
                at = operator.end()
                continue
            m = TOKEN.match(text, at)
            if m.lastgroup == "name":
                before.append(("name", m.group()))
                self.call(m)
            elif m.lastgroup == "other":
                before.append(("other", m.group()))
            at = m.end()
        return at

    @staticmethod
    def target(before: list[tuple[str, str]]) -> str | None:
        if not before:
            return None
        kind, last = before[-1]
        named = [t for t in before[-4:] if t[1] != "&"][-3:]
        if [k for k, _ in named] == ["name", "operator", "name"] and named[1][1] == ":":
            return named[0][1]      # name: type = value
        if kind == "name" or (kind == "string" and NAME.fullmatch(last)):
            return last
        if last == "]" and len(before) > 2 and before[-2][0] == "string" and before[-3][1] == "[":
            return before[-2][1]
        return None

    def fields(self, target: str, literals: list[Literal]) -> None:
        """``name="DB_PASSWORD" value="x"``, on one line or the next."""
        short = target.rsplit(".", 1)[-1].lower()
        if short in ("name", "key") and len(literals) == 1:
            self.field = (literals[0][2], literals[0][1])
        elif short == "value" and self.field and literals:
            name, since = self.field
            if self.text.count("\n", since, literals[0][0]) <= 1:
                self.pair(name, literals)

    def call(self, name: re.Match) -> None:
        """``setName("x")`` and ``f("name", "x")``."""
        opened = TWO_ARGUMENTS.match(self.text, name.end())
        if not opened:
            return
        first = self.string(opened.end())
        if not first:
            return
        literals, at = first
        at = WIDE_SPACE.match(self.text, at).end()
        if self.text.startswith(",", at):
            second = self.string(WIDE_SPACE.match(self.text, at + 1).end())
            if second and len(literals) == 1 and NAME.fullmatch(literals[0][2]):
                self.pair(literals[0][2], second[0])
        elif self.text.startswith(")", at) and name_words(name.group())[:1] != ["get"]:
            self.pair(name.group(), literals)

    def run(self) -> dict[tuple[int, int], float]:
        """Spans of the literals that count as secrets, with their scores."""
        text, done = self.text, 0
        for m in TRIGGER.finditer(text):
            if m.start() < done:
                continue
            start = max(text.rfind("\n", 0, m.start()) + 1, done)
            end = text.find("\n", m.start())
            done = self.line(start, len(text) if end < 0 else end)
        for pattern in (OPTION, ELEMENT):
            for m in pattern.finditer(text):
                self.pair(m.group(1), [(m.start(2), m.end(2), m.group(2))])
        for m in DEFINE.finditer(text):
            self.pair(m.group(1), self.value(m.end(), len(text)))
        for m in USERINFO.finditer(text) if "://" in text else ():
            self.pair("password", [(m.start(1), m.end(1), m.group(1))])
        return self.found


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in ``KINDS``, end) of all secrets, in this order."""
    found = base_spans(text) + [(a, 3, b) for a, b in Lexer(text).run()]
    return sorted(found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``, the secrets of each text: kind, start, end in code points, in order of
    start, then kind.

    A null text counts as empty. Rows may repeat; a row without a doc_id is a document too. Other
    columns are ignored. Every text is read whole, by the worker that holds its row.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t.as_py() or "")]
                   for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)],
                                             names=["doc_id", "found"])

    return bounded(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(
        read, "doc_id bigint, found array<struct<kind: string, start: bigint, end: bigint>>")
