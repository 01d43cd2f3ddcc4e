"""Operator 3: secrets by assignment-aware lexing."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal", "constant")
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer")
#: The last part of a name, what may close it, and an assignment sign. No name is begun inside another.
TARGET = re.compile(r"""(?a)(?<![A-Za-z0-9_])(?P<name>[A-Za-z_]\w*+)["'`]?[\x20\t]*+\]?[\x20\t]*+(?P<sign>:=|=>|=(?![=>])|:(?![:/]))""")
ELEMENT = re.compile(r"""(?a)<(?P<name>[A-Za-z_][\w.-]*+)(?:[\x20\t][^<>]*+)?>(?=[^<\s])""")
TYPED = re.compile(r"""(?a)[\x20\t]*+[A-Za-z_][\w.\[\]|]*+[\x20\t]*+=(?![=>])""")
OPENING = re.compile(r"""(?ai)[rbuf]{1,2}(?=["'])|[\x20\t]++|@(?=["'])|\(\s*+""")
PLUS = re.compile(r"""[\x20\t]*+(?:\+|\.(?=[\x20\t])|\\\n)\s*+""")
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>|&]++""")
BLOCK = re.compile(r"""[|>][+-]?[\x20\t]*+\n(?P<pad>[\x20\t]++)""")
FOLD = re.compile(r"""\n[\x20\t]*+""")
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9\x20]*PRIVATE KEY(?: BLOCK)?-----")
#: Words before a bare credential in an authorization header.
SCHEME = re.compile(r"""(?ai)(?:bearer|basic|token|digest|apikey)[\x20\t]++(?=[^\s"'`])""")
CLOSING = {'"': re.compile(r"""(?:[^"\\\n]|\\.)*+\""""), "'": re.compile(r"""(?:[^'\\\n]|\\.)*+'"""), "`": re.compile(r"""[^`]*+`""")}
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Weights of name parts; pairs count together ("api key"), and a name is sensitive from 2 on.
STRONG = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "credential": 3, "credentials": 3, "apikey": 3, "authorization": 3, "bearer": 2, "auth": 1, "key": 1, "private": 1, "access": 1, "api": 1, "client": 1, "encryption": 1, "signing": 1}
#: First and last line of a PEM key; their spaces are not the key's.
ARMOUR = re.compile(r"-----(?:BEGIN|END)[A-Z0-9\x20]+-----")
PLAIN = re.compile(r"(?ai)^(?:true|false|none|null|nil|undefined|changeme|example|sample|test|xxx+|your[-_ ].*|\*+|<.*>|\$\{.*\}|\{\{.*\}\}|[a-z][a-z0-9+.-]*://[^@]*)$")


def sensitivity(name: str) -> int:
    """How much a name says that its value is a secret."""
    return sum(STRONG.get(p.lower(), 0) for p in PARTS.findall(name))


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


#: What a literal must have to count: characters; characters if it has no digit beside letters; bits per
#: character under a strong name (3 and more) and under a weaker one.
LEAST_CHARS, LEAST_LETTERS, STRONG_NAME = 6, 16, 3
LEAST_BITS, LEAST_BITS_WEAK = 2.5, 3.5


def looks_secret(value: str, name_score: int, quoted: bool = False) -> bool:
    """A strong name needs a plausible literal, a weaker one a random-looking literal.

    A private key in armour always counts, header lines included. Blanks are allowed in a ``quoted`` literal
    of a strong name (a passphrase, a header with its scheme), else they make it prose.
    """
    if KEY_BLOCK.match(value):
        return bool(ARMOUR.sub("", value).strip())
    value = ARMOUR.sub("", value)
    if len(value) < LEAST_CHARS or PLAIN.match(value) or " " in value and not (quoted and name_score >= STRONG_NAME):
        return False
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return entropy(value) >= (LEAST_BITS if name_score >= STRONG_NAME else LEAST_BITS_WEAK) and (mixed or (name_score >= STRONG_NAME and len(value) >= LEAST_LETTERS))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three fixed patterns, leftmost and not overlapping within a kind."""
    low = text.lower()
    found = []
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if LONG_HEX.search(text):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return found


class _Lexer:
    """Reads the value at a place of a text as pieces: literals with their places, and names.

    Where a quote does not end on its line, no later quote of its kind on that line does either, so
    each line is searched once for each kind and reading stays linear.
    """

    def __init__(self, text: str):
        self.text, self.dead = text, {}

    def quoted(self, at: int) -> tuple[int, int, int] | None:
        """Start, end and what follows of a string that opens at ``at``."""
        text, mark = self.text, self.text[at]
        triple = mark * 3
        if mark != "`" and text.startswith(triple, at):
            if at >= self.dead.get(triple, 0):
                end = text.find(triple, at + 3)
                if end >= 0:
                    return at + 3, end, end + 3
                self.dead[triple] = len(text)
            return None
        if at < self.dead.get(mark, 0):
            return None
        found = CLOSING[mark].match(text, at + 1)
        if found:
            return at + 1, found.end() - 1, found.end()
        line = text.find("\n", at) if mark != "`" else -1
        self.dead[mark] = line if line >= 0 else len(text)
        return None

    def armoured(self, at: int) -> int:
        """Where a PEM block that opens at ``at`` ends, or -1."""
        if at < self.dead.get("-----", 0):
            return -1
        end = self.text.find("-----END ", at)
        end = self.text.find("-----", end + 9) if end >= 0 else -1
        if end < 0:
            self.dead["-----"] = len(self.text)
            return -1
        return end + 5

    def folded(self, m: re.Match, name_at: int) -> int | None:
        """End of a YAML block whose lines are deeper than the name's line."""
        text, pad = self.text, m["pad"]
        if len(pad) <= len(text[text.rfind("\n", 0, name_at) + 1 : name_at]):
            return None
        end = m.end()
        while (line := text.find("\n", end)) >= 0 and text.startswith(pad, line + 1):
            end = line + 1 + len(pad)
        return line if line >= 0 else len(text)

    def value(self, at: int, name_at: int) -> tuple[list[tuple[str, int, int]], int]:
        """Pieces of the value at ``at`` and where it ends."""
        text, pieces, bracket = self.text, [], False
        while True:
            while m := OPENING.match(text, at):
                at, bracket = m.end(), bracket or "(" in m[0]
            if m := BLOCK.match(text, at):
                if not text.startswith("-----BEGIN ", m.end()) and (end := self.folded(m, name_at)):
                    return [("text", m.end(), end)], end
                at = m.end()
            if text.startswith("-----BEGIN ", at):
                if (end := self.armoured(at)) >= 0:
                    pieces.append(("text", at, end))
                return pieces, max(at, end)
            quote = text[at : at + 1]
            if quote and quote in CLOSING:
                found = self.quoted(at)
                if not found:
                    return pieces, at + 1
                pieces.append(("text", *found[:2]))
                at = found[2]
            elif m := SCHEME.match(text, at) or BARE.match(text, at):
                if m.re is SCHEME:  # the credential follows
                    at = m.end()
                    if not (m := BARE.match(text, at)):
                        return pieces, at
                if text.startswith(("(", "["), m.end()):  # a call or a lookup
                    return pieces, m.end()
                pieces.append(("bare", at, at + len(m[0].rstrip(".:!?"))))
                at = m.end()
            else:
                return pieces, at
            if m := PLUS.match(text, at):
                at = m.end()
            elif quote in CLOSING:  # strings side by side are one; in brackets on further lines too
                near = at
                while text[near : near + 1] and text[near] in (" \t\r\n" if bracket else " \t"):
                    near += 1
                if text[near : near + 1] not in ('"', "'"):
                    return pieces, at
                at = near
            else:
                return pieces, at


def _assignments(text: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Name-value pairs of source, settings, JSON, YAML and XML, in order, and key blocks without a name."""
    lexer, pairs, label = _Lexer(text), [], None
    if "</" in text:
        for m in ELEMENT.finditer(text):
            end = text.find("<", m.end())
            pairs.append((m.start(), m["name"], [("text", m.end(), end if end >= 0 else len(text))]))
    for m in KEY_BLOCK.finditer(text):
        if (end := lexer.armoured(m.start())) >= 0:
            pairs.append((m.start(), "private_key", [("text", m.start(), end)]))
    read = {"=": 0, ":": 0}
    for m in TARGET.finditer(text):
        start, at = m.start("name"), m.end()
        mark = ":" if m["sign"] == ":" else "="
        if start < read[mark]:  # inside a bare value after the same sign: part of it
            continue
        while start and (text[start - 1] in "_.-" or text[start - 1].isascii() and text[start - 1].isalnum()):
            start -= 1
        name = text[start : m.end("name")].lstrip(".-")
        if m["sign"] == ":" and (typed := TYPED.match(text, at)):
            at = typed.end()
        pieces, end = lexer.value(at, start)
        if pieces and pieces[-1][0] == "bare":
            read[mark] = end
        if label and name.lower() == "value" and not set(text[label[1] : start]) & set("<>{}"):
            name = label[0]
        single = len(pieces) == 1 and pieces[0][0] == "text"
        label = (text[pieces[0][1] : pieces[0][2]], end) if single and name.lower() in ("name", "key") else None
        pairs.append((m.start(), name, pieces))
    return [(name, pieces) for _, name, pieces in sorted(pairs, key=lambda p: p[0])]


def lexed_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Literals of sensitive names, and constants that reach a sensitive name through other names.

    A bare value that is the name of another pair stands for that pair's value, whether it comes
    before (the nearest) or after (the first). Sensitivity runs along such names until nothing changes. The
    pieces of a joined literal are judged together and each told by its place.
    """
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    pairs = _assignments(text)
    where: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(pairs):
        where.setdefault(name, []).append(i)
    scores = [sensitivity(name) for name, _ in pairs]
    reached, todo = {}, [(s, i, False) for i, s in enumerate(scores) if s >= 2]
    found: dict[tuple[int, int], str] = {}
    todo.sort()
    while todo:  # the strongest first; a pair is looked at again only for a stronger name
        score, i, passed = todo.pop()
        if reached.get(i, 0) >= score:
            continue
        reached[i] = score
        own, quoted = [], True
        for kind, s, e in pairs[i][1]:
            at = where.get(text[s:e]) if kind == "bare" else None
            if at and at != [i]:
                k = bisect_left(at, i)
                todo.append((score, at[k - 1] if k else next(j for j in at[:2] if j != i), True))
            else:
                own.append((s, e))
                quoted &= kind == "text"
        if own and looks_secret(FOLD.sub("", "".join(text[s:e] for s, e in own)), score, quoted):
            for place in own:
                found.setdefault(place, "constant" if passed else "literal")
    out, reach, inside, of_base = [], 0, 0, iter([*sorted(base), (len(text) + 1, 0, "")])
    start, end, _ = next(of_base)
    for (s, e), k in sorted(found.items(), key=lambda x: (x[0][0], -x[0][1])):
        while start <= s:
            inside = max(inside, end)
            start, end, _ = next(of_base)
        if s < e and e > max(reach, inside):  # inside no other literal and no base span
            out.append((s, e, k))
            reach = e
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            rows = []
            for text in part.column(1).to_pylist():
                base = base_spans(text or "")
                more = lexed_spans(text or "", base)
                n = Counter(k for *_, k in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            a, b, c, d, e, f = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string()), pa.array(e, pa.string()), pa.array(f, pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every text; no shuffle.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_lexed``. Spans are
    kind:start:end in code points. Added kinds: ``literal`` (a sensitive name's value) and
    ``constant`` (a value defined under another name), never wholly inside one base span; one that reaches
    beyond it is there beside it.

    Literals have no length bound, may hold escapes, span lines in triple quotes, YAML blocks and
    PEM keys, and be joined of parts; names come from source, settings, JSON, YAML and XML.
    Constants are followed both ways. A literal counts from 6 characters on, with a digit beside letters or from 16
    characters on, if it has 2.5 bits a character under a strong name and 3.5 under a weaker one; placeholders
    do not count, and blanks only in quotes under a strong name. A private key in armour counts whatever it holds.

    Null text: empty. Very long texts are read whole in linear time. Null or repeated ids keep a row each. An empty table gives an empty
    table; other columns play no part.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"))
    return slim.mapInArrow(_scan, f"doc_id {slim.schema[0].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; other columns stay, whatever they are called.

    Spans that overlap become one mark; nothing of a found literal is left, however long. Null
    texts stay null, empty ones empty. An empty table gives an empty table.
    """

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        base = base_spans(text)
        out, at = [], 0
        for s, e, _ in sorted(base + lexed_spans(text, base)):
            if e > at:
                out += [text[at : max(at, s)], mark if s >= at else ""]
                at = e
        return "".join(out) + text[at:]

    @F.pandas_udf("string")
    def apply(texts):
        return texts.map(clean)

    return docs.withColumn(text_col, apply(F.col(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
