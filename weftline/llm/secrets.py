"""Secrets in whole texts: three fixed patterns, and assignment-aware lexing.

The lexer reads source and configuration syntax (``name = literal``, ``name: literal``,
``"name": "literal"``, ``export NAME=literal``, ``<name>literal</name>``, with a type
``name: type = literal``, chained ``name = other = literal``, with a key
``table["name"] = literal``, with strings of several lines, and with strings added to each other,
which are one literal) into pairs of a target name and a literal or another name.  Constants propagate: a name that stands
for a literal passes it on to the names it is assigned to, and a literal is scored by
the most sensitive name that it reaches and by its own shape.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import units
from weftline.llm.shared import give_back, index_of, map_batches, widened, without

#: The kinds in the order in which spans of one start are listed, and their patterns.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
#: What one of the names in ASSIGN holds, in lower case: texts without any needn't be searched.
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Literals of a higher score are spans of their own.
THRESHOLD = 0.6
#: How sensitive a target is, by the most sensitive of its words and pairs of words; each is above THRESHOLD, or it could never count.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authorization": 0.8, "auth": 0.7, "bearer": 0.9, "signature": 0.7, "salt": 0.7, "key": 0.65,
}
_QUOTED = r"""\"(?:[^"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"""
#: A string of several lines, and what a string goes on with: another one, added to it.
_LONG = r"""\"{3}(?:[^"\\]|\\.|\"(?!\"\"))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}"""
_MORE = re.compile(rf"""[\x20\t]*\+\s*(?P<value>{_QUOTED})""", re.ASCII)
#: A type: a name or path with its arguments, a reference or optional, or several as a union.
_ARGUMENTS = r"""\[[^\[\]=\n]{0,99}(?:\[[^\[\]=\n]{0,99}\][^\[\]=\n]{0,99}){0,3}\]|<[^<>=\n]{1,99}(?:<[^<>=\n]{0,99}>[^<>=\n]{0,99}){0,3}>"""
_ONE_TYPE = rf"""(?:[&*](?:'\w+\x20)?(?:mut\x20)?)?["']?[A-Za-z_][A-Za-z0-9_.]{{0,127}}+(?:::\w+)*["']?(?:{_ARGUMENTS})?(?:\[\])*[?!]?"""
_TYPE = rf"""{_ONE_TYPE}(?:[\x20\t]*\|[\x20\t]*{_ONE_TYPE}){{0,9}}"""
#: After a name may stand the end of a quoted key or subscript, or a size or index.
_PAIR = re.compile(
    rf"""(?P<name>[A-Za-z_][A-Za-z0-9_.\-]{{0,127}}+)(?:["'](?:[\x20\t]*\])?)?(?:\[[A-Za-z0-9_]*\])*"""
    rf"""(?:(?:[?!]?[\x20\t]*:[\x20\t]*(?P<type>{_TYPE})|[\x20\t]+(?:string|\[\]byte))(?:[\x20\t]+=(?![=>])[\x20\t]*|=[\x20\t]*(?=["']))"""
    rf"""|(?P<sep>[\x20\t]*(?::=|=>|==?|:)[\x20\t]*|>(?=[^<>\s]+</)))"""
    rf"""(?P<value>{_LONG}|{_QUOTED}|[A-Za-z0-9+/_.=@%$!*^~\-]+)(?P<keys>(?:\[(?:"[^"\\\[\]\n]*"|'[^'\\\[\]\n]*')\])*)""",
    re.ASCII | re.DOTALL,
)
#: What makes a name after a separator a target itself; and targets chained without spaces, with what is assigned to the last.
_CHAINED = re.compile(r"(?:\[[A-Za-z0-9_]*\])*[\x20\t]*=(?![=>])", re.ASCII)
_CLOSE_CHAIN = re.compile(r"(?P<names>(?:[A-Za-z_][A-Za-z0-9_.]*=)+)(?P<last>[^=].*)?\Z", re.ASCII)
_PLAIN_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z", re.ASCII)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@dataclass(frozen=True, slots=True)
class Literal:
    """A literal's span (code points, end exclusive), the name it is assigned to, and how sensitive the most sensitive name is that it reaches."""

    start: int
    end: int
    value: str
    name: str
    weight: float


def literals(text: str) -> list[Literal]:
    """The literals assigned in a text, in order, each weighed by the names that it reaches directly or through constants.

    Time and memory grow with the text, however names are assigned to each other.
    """
    found: list[tuple[str, int, int, str]] = []
    aliases: list[tuple[str, str]] = []
    at = 0
    while m := _PAIR.search(text, at):
        name, raw, start, end = m["name"], m["value"], m.start("value"), m.end("value")
        at = m.end()
        if (m["sep"] or "").strip() == "==":
            continue
        quoted = raw[0] in "\"'"
        # in prose and YAML what looks like a type may be the value
        if (kind := m["type"]) and (not quoted or any(c.isdigit() for c in kind)):
            found.append((name, m.start("type"), m.end("type"), kind))
            aliases.append((name, kind))
        # "Note: pwd = ..." reads like a type, too
        targets = [name, kind] if kind and _PLAIN_NAME.match(kind) and sensitivity(kind) else [name]
        if quoted:
            quotes = 3 if raw[:3] in ('"""', "'''") and len(raw) >= 6 else 1
            value, start, stop = raw[quotes:-quotes], start + quotes, end - quotes
            if quotes == 3:  # lines of its own around it
                start, stop = start + len(value) - len(value.lstrip()), stop - len(value) + len(value.rstrip())
                value = value.strip()
            while quotes == 1 and (more := _MORE.match(text, at)):
                value, stop, at = value + more["value"][1:-1], more.end() - 1, more.end()
            found += [(target, start, stop, value) for target in targets]
            continue
        found += [(target, start, end, raw) for target in targets]
        if _PLAIN_NAME.match(raw):
            aliases.append((name, m["keys"][:-2].rpartition(m["keys"][-2])[2] if m["keys"] else raw))
            if _CHAINED.match(text, at):
                at = start
        elif chain := _CLOSE_CHAIN.match(raw):
            names = chain["names"][:-1].split("=")
            aliases += zip([name, *names], names, strict=False)
            if chain["last"]:
                found.append((names[-1], start + chain.start("last"), end, chain["last"]))
                if _PLAIN_NAME.match(chain["last"]):
                    aliases.append((names[-1], chain["last"]))
                    if _CHAINED.match(text, end):
                        at = start + chain.start("last")
            else:
                at = end - len(names[-1]) - 1
    constants = {name for name, *_ in found}
    # a bare word that names a constant is that constant, otherwise a literal
    used = [(name, source) for name, source in aliases if source in constants]
    named = set(used)
    sources: dict[str, list[str]] = {}
    for name, source in used:
        sources.setdefault(name, []).append(source)
    # from the most sensitive name down, each marks all that reaches it and isn't marked yet
    weight: dict[str, float] = {}
    for name in sorted({*constants, *sources}, key=sensitivity, reverse=True):
        own, waiting = sensitivity(name), [name]
        while waiting:
            if (reached := waiting.pop()) not in weight:
                weight[reached] = own
                waiting += sources.get(reached, ())

    return [Literal(start, end, value, name, weight[name]) for name, start, end, value in found if (name, value) not in named]


def sensitivity(name: str) -> float:
    """How sensitive a target's name is, from 0 to 1."""
    parts = [w.lower() for w in _WORDS.findall(name.replace("-", "_"))]
    pairs = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(w, 0.0) for w in parts + pairs), default=0.0)


def randomness(value: str) -> float:
    """How random a literal looks, from 0 to 1: its entropy in bits a character over 4, with digits and letters mixed, without spaces."""
    if len(value) < LEAST_ASSIGNED or any(c.isspace() for c in value):
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return min(1.0, entropy / 4) * (1.0 if mixed else 0.7)


def score(literal: Literal) -> float:
    """The most sensitive name's weight times the literal's randomness; placeholders score nothing."""
    if re.fullmatch(r"[*xX.]+|\$\{?.*|<.*>|%.*%|(?i:null|none|true|false|changeme|example|placeholder)", literal.value):
        return 0.0
    return literal.weight * randomness(literal.value)


def spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text by start, then kind as listed, then end."""
    found: list[tuple[str, int, int]] = []
    low = text.lower() if any(c in text for c in "=:>") else ""
    if low and any(name in low for name in _NAMES):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    # a pair of a name's words may be listed as one
    low = low.replace("_", "").replace("-", "").replace(".", "")
    if low and any(name in low for name in SENSITIVE):
        found += sorted({("literal", x.start, x.end) for x in literals(text) if score(x) > threshold})
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every maximal stretch of overlapping spans replaced by ``[SECRET]``."""
    out, at = [], 0
    stretches: list[list[int]] = []
    for _, start, end in found:
        if stretches and start < stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], end)
        else:
            stretches.append([start, end])
    for start, end in stretches:
        out += [text[at:start], "[SECRET]"]
        at = end
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(docs: DataFrame, text_column: str = "text", spans_column: str = "spans", redacted_column: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the spans of secrets in its texts, array<struct<kind, start, end>>, and with ``redacted_column`` the text without them.

    Starts and ends count code points, the end exclusive.  Null and empty texts have
    no spans; a null stays null when redacted.  All rows and columns stay, but ones
    named like the new ones, in capitals or not, are replaced.  Kinds are those of KINDS: ``assign``,
    ``access`` and ``hex`` are fixed patterns, ``literal`` is what the lexer adds.
    """
    new = [c for c in (spans_column, redacted_column) if c]
    docs = without(docs, *[c for c in new if c.lower() != text_column.lower()])
    at = index_of(docs, text_column)
    if text_column.lower() in {c.lower() for c in new}:
        raise ValueError("the new columns need names of their own")
    schema = widened(docs, **{spans_column: "array<struct<kind:string,start:bigint,end:bigint>>"}, **({redacted_column: "string"} if redacted_column else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in units.slices(batches, at):
            texts = batch.column(at).to_pylist()
            found = [spans(t or "", threshold) for t in texts]
            columns = [*batch.columns, pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found], pa.list_(_SPAN))]
            if redacted_column:
                columns.append(pa.array([redacted(t, x) if x and t else t for t, x in zip(texts, found, strict=True)], pa.string()))
            del texts, found
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        give_back()

    return map_batches(docs, run, schema)


def digest(kinds: tuple[str, ...] = KINDS, spans_column: str = "spans"):
    """The spans of the given kinds as kind:start:end, comma-joined, as a column."""
    chosen = F.filter(spans_column, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
