"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived (a
conjunction of what every match must contain, a disjunction over alternatives).
Each block of texts is indexed by the queries' trigrams: one posting list of
text numbers for each. The query's postings are intersected and joined, and only
the texts left are searched with the expression itself. A rule without a
mandatory trigram is searched in every text.

Spans are code points, end exclusive. Defined results: a null text is empty and
an empty text has no span; overlapping spans of different rules all stay; equal
texts have equal spans; input columns of the result's names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.common import byte_blocks, map_batches


@dataclass(frozen=True)
class Rule:
    """A named expression; ``size`` is the least length of ``group``."""

    kind: str
    pattern: str
    group: int = 0
    size: int = 1
    base: bool = False


#: The rules of the contract come first, in its order; the others add spans. Each
#: added one starts at a run's start and gives nothing back, so any text takes linear time.
RULES: tuple[Rule, ...] = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("basicauth", r"(?<![a-z])[a-z]++://[A-Za-z0-9._%+-]++:([A-Za-z0-9._%+-]++)@", 1, 3),
)

# --- Boolean trigram queries -------------------------------------------------
# A query is True (anything), a trigram (bytes), ("and", ...) or ("or", ...).

MAX_SET = 64


def _simplify(op: str, parts: list) -> object:
    seen: list = []
    for p in parts:
        if p is True:
            if op == "or":
                return True
            continue
        for q in p[1:] if isinstance(p, tuple) and p[0] == op else (p,):
            if q not in seen:
                seen.append(q)
    return True if not seen else seen[0] if len(seen) == 1 else (op, *seen)


@dataclass
class _Info:
    """Exact strings of a part if they are few, else its edges, and its query."""

    exact: set[bytes] | None
    prefix: set[bytes]
    suffix: set[bytes]
    query: object


def _of_strings(strings: set[bytes]) -> object:
    return _simplify("or", [_simplify("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)]) if strings else True


def _any() -> _Info:
    return _Info(None, {b""}, {b""}, True)


def _concat(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MAX_SET:
        both = {x + y for x in a.exact for y in b.exact}
        return _Info(both, both, both, _of_strings(both))
    left, right = a.exact if a.exact is not None else a.suffix, b.exact if b.exact is not None else b.prefix
    joint = _of_strings({x[-2:] + y[:2] for x in left for y in right}) if len(left) * len(right) <= MAX_SET else True
    prefix = {x + y for x in a.exact for y in right} if a.exact is not None else a.prefix
    suffix = {x + y for x in left for y in b.exact} if b.exact is not None else b.suffix
    if len(prefix) > MAX_SET:
        prefix = {b""}
    if len(suffix) > MAX_SET:
        suffix = {b""}
    return _Info(None, {x[:2] for x in prefix}, {x[-2:] for x in suffix}, _simplify("and", [a.query, b.query, joint]))


def _union(parts: list[_Info]) -> _Info:
    if all(p.exact is not None for p in parts):
        both = set().union(*(p.exact for p in parts))
        if len(both) <= MAX_SET:
            return _Info(both, both, both, _of_strings(both))
    prefix = set().union(*((p.exact if p.exact is not None else p.prefix) for p in parts))
    suffix = set().union(*((p.exact if p.exact is not None else p.suffix) for p in parts))
    query = _simplify("or", [p.query for p in parts])
    return _Info(None, prefix if len(prefix) <= MAX_SET else {b""}, suffix if len(suffix) <= MAX_SET else {b""}, query)


def _analyse(items, limit: int = 8) -> _Info:
    out = _Info({b""}, {b""}, {b""}, True)
    for op, arg in items:
        if op is sre.LITERAL:
            s = chr(arg).lower().encode() if arg < 128 else chr(arg).encode()
            part = _Info({s}, {s}, {s}, True)
        elif op is sre.IN:
            found: set[bytes] | None = set()
            for kind, value in arg:
                if kind is sre.LITERAL and value < 128:
                    found.add(chr(value).lower().encode())
                elif kind is sre.RANGE and value[1] < 128 and value[1] - value[0] < limit:
                    found |= {chr(c).lower().encode() for c in range(value[0], value[1] + 1)}
                else:
                    found = None
                    break
            part = _Info(found, found, found, True) if found and len(found) <= limit else _any()
        elif op is sre.SUBPATTERN:
            part = _analyse(arg[3])
        elif op is sre.BRANCH:
            part = _union([_analyse(x) for x in arg[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner = _analyse(body)
            if (low, high) == (0, 1):
                part = _union([inner, _Info({b""}, {b""}, {b""}, True)])
            elif low == 0:
                part = _any()
            else:
                part = inner
                for _ in range(min(low, 3) - 1):
                    part = _concat(part, inner)
                if high != low:  # more may follow: neither end of the rest is known
                    edge = part
                    part = _Info(None, {x[:2] for x in (edge.exact or edge.prefix)}, {b""}, edge.query)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):  # no width
            continue
        else:
            part = _any()
        out = _concat(out, part)
    return out


def trigram_query(pattern: str) -> object:
    """What the A-Z lower-cased bytes of any text with a match must contain.

    True when the expression has no mandatory trigram.
    """
    info = _analyse(parser.parse(pattern))
    return _of_strings(info.exact) if info.exact is not None else info.query


def _grams(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_grams, query[1:]))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class PostingIndex:
    """Posting lists of the wanted trigrams over one block of texts."""

    def __init__(self, grams: list[bytes]):
        self.codes = np.sort(np.array([int.from_bytes(g, "big") for g in grams], np.int32))
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.codes] = True

    def build(self, data: np.ndarray, offsets: np.ndarray) -> dict[bytes, np.ndarray]:
        n = len(data)
        if n < 3:
            return {}
        low = _LOWER[data].astype(np.int32)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        at = np.flatnonzero(self.wanted[code])
        row = np.searchsorted(offsets, at, "right") - 1
        whole = at + 3 <= offsets[row + 1]
        at, row = at[whole], row[whole]
        which = np.searchsorted(self.codes, code[at])
        pairs = np.unique(which.astype(np.int64) << 40 | row)
        which, row = pairs >> 40, pairs & ((1 << 40) - 1)
        cut = np.searchsorted(which, np.arange(len(self.codes) + 1))
        return {int(c).to_bytes(3, "big"): row[cut[i] : cut[i + 1]] for i, c in enumerate(self.codes)}


def candidates(query: object, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Text numbers that satisfy a query."""
    if query is True:
        return np.arange(n)
    if isinstance(query, bytes):
        return postings.get(query, np.empty(0, np.int64))
    lists = [candidates(q, postings, n) for q in query[1:]]
    if query[0] == "or":
        return np.unique(np.concatenate(lists))
    out = min(lists, key=len)
    for other in lists:
        out = np.intersect1d(out, other, assume_unique=True) if other is not out else out
    return out


class Scanner:
    """Compiled rules with their queries; made once in each task."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = PostingIndex(sorted(set().union(*map(_grams, self.queries))))
        self.patterns = [re.compile(self._quick(r), re.ASCII) for r in rules]

    @staticmethod
    def _quick(rule: Rule) -> str:
        """A greedy run of one class that must reach a size can ask for it at once."""
        if rule.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
            return f"{rule.pattern[:-1]}{{{rule.size},}}"
        return rule.pattern

    def spans(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule number, end), sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        for i, j, data, at in byte_blocks(column):
            postings = self.index.build(data, at)
            texts: dict[int, str] = {}
            for k, (rule, query, pattern) in enumerate(zip(self.rules, self.queries, self.patterns, strict=True)):
                for row in candidates(query, postings, j - i).tolist():
                    if row not in texts:
                        texts[row] = str(data[at[row] : at[row + 1]].tobytes(), "utf-8", "replace")
                    for m in pattern.finditer(texts[row]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.size:
                            out[i + row].append((m.start(), k, m.end()))
        for found in out:
            found.sort()
        return out


def _map_texts(df: DataFrame, text: str, rules: tuple[Rule, ...], ddl: str | object, make: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            yield make(batch, scanner.spans(batch.column(text)))

    return map_batches(df, run, ddl)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, found array<struct<kind,start,end,base>>) for each row, by start then rule."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def make(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        rows = [[{"kind": rules[k].kind, "start": s, "end": e, "base": rules[k].base} for s, k, e in found] for found in spans]
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(rows, pa.list_(item))], names=[key, "found"])

    kind = df.schema[key].dataType.simpleString()
    ddl = f"`{key}` {kind}, found array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    return _map_texts(df.select(key, text), text, rules, ddl, make)


def redact(df: DataFrame, text: str = "text", size: str = "n_chars", rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span (overlapping ones merged) of ``text`` replaced by ``mark``."""

    def make(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        column = batch.column(text).to_pylist()
        for i, found in enumerate(spans):
            if found:
                body, out, at = column[i], [], 0
                merged: list[list[int]] = []
                for s, _, e in found:
                    if merged and s < merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                for s, e in merged:
                    out += [body[at:s], mark]
                    at = e
                column[i] = "".join(out) + body[at:]
        names = batch.schema.names
        arrays = [pa.array(column, batch.schema.field(text).type) if n == text else batch.column(n) for n in names]
        if size in names:
            n = pa.array([None if x is None else len(x) for x in column], pa.int64())
            changed = pa.array([bool(f) for f in spans])
            k = names.index(size)
            arrays[k] = pa.compute.if_else(changed, n.cast(arrays[k].type), arrays[k])
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return _map_texts(df, text, rules, df.schema, make)


def digest(found: str = "found") -> dict:
    """Contract columns from a ``found`` column."""
    spans = F.col(found)

    def line(x):
        return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))

    def count(kind: str):
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda x: x["base"])
    return {f"n_{r.kind}": count(r.kind) for r in RULES if r.base} | {
        "base_sha256": F.sha2(F.array_join(F.transform(base, line), ","), 256),
        "spans": F.array_join(F.transform(spans, line), ","),
    }
