"""Problem 3: credentials in source code, configuration, logs and commands.

Every string leaf of a payload is cut into lines, a line into lexical tokens; a linear-chain conditional random field
over shapes and context labels the tokens, and its Viterbi spans are the characters that are redacted. The field is
trained here, from the drafted lines of ``secret_lines``. Every line that holds one of the literals a credential stands
beside (a word that names one, a provider's prefix, a scheme) is labelled by the field, whatever its tokens look like.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veilspan.llm.batches import sliced
from veilspan.llm.crf import Crf, train
from veilspan.llm.secret_lines import LINES, drafted
from veilspan.sources.tables import table

REDACTION = "⟦SECRET:REDACTED⟧"

_PEM = r"-----BEGIN [A-Z0-9 ]+-----[\s\S]*?-----END [A-Z0-9 ]+-----"
_REFERENCE = r"\$\{\{?[^{}\n]*\}\}?|\$\([^()\n]*\)|%\(\w+\)s|\{\{[^{}\n]*\}\}|<[A-Za-z][\w ]*(?:-[\w ]+)+>|⟦[^⟧\n]*⟧|vault:[\w/.\-]+#\w+|\[[A-Z_]{4,}\]|\*{3,}|[xX]{5,}|\.{3,}"
_RUN = r"[\w\-.+/*!%#~^$]*[\w/+*#~^%$\-](?:={1,2}(?=[\"'\s;,<)}\]&]|$))?"
TOKEN = re.compile(f"({_PEM})|({_REFERENCE})|({_RUN})|(\\s+)|(.)", re.S)
PEM_BLOCK = re.compile(_PEM)

# Prefixes that providers give to secret and to public keys.
SECRET_PREFIX = re.compile(r"(?:sk[-_](?:live|test|proj|ant)[-_]|rk_live_|gh[pousr]_|github_pat_|glpat-|npm_|xox[abprs]-|AKIA[0-9A-Z]{12}|ASIA[0-9A-Z]{12}|AIza|whsec_|SG\.|hf_|dop_v1_|eyJ[\w-]+\.[\w-]+\.|pypi-)")
PUBLIC_PREFIX = re.compile(r"pk[-_](?:live|test)[-_]|ssh-(?:rsa|ed25519)|sha(?:1|256|384|512)[-:]")
# Words that name a credential, as parts of a name, and words that turn the name into something else.
NAMING = frozenset("password passwd passphrase pwd pass passe mdp secret token key apikey auth authorization authtoken credential credentials pgpassword mysql_pwd clef clé jeton sig bearer cookie".split())
OTHERWISE = frozenset("file path ref field hash min max length len size width id name url host count total used public publishable pub ttl mode limit type scope expiry expires rotation tokenizer vocab policy".split())
FINGERPRINT = frozenset("commit sha sha1 sha256 sha512 digest checksum etag integrity trace build request fingerprint md5 crc uuid revision version".split())
GATE = re.compile(r"pass|pwd|secret|token|key|mdp|auth|bearer|basic|cred|identified|clé|clef|jeton|://|\s-u\s|sk[-_]|gh[pousr]_|npm_|xox|akia|asia|aiza|eyj|code|account|private|conn|cookie|sig")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-ÿ]+|\d+")
_HEX = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}")
_CASE = re.compile(r"[a-z][A-Z]|\d[A-Za-z]|[A-Za-z]\d")


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


@functools.lru_cache(maxsize=1 << 16)
def shape(token: str) -> str:
    """A coarse class of a run of characters."""
    n = len(token)
    if PUBLIC_PREFIX.match(token):
        return "public"
    if SECRET_PREFIX.match(token) and n >= 16:
        return "prefixed"
    if token[0] == "$" or token.startswith("%"):
        return "variable"
    core = token.rstrip("=")
    if core.isdigit():
        return "number"
    if _UUID.fullmatch(core):
        return "uuid"
    if n >= 10 and _HEX.fullmatch(core) and any(c.isdigit() for c in core):
        return f"hex{n if n in (32, 40, 64, 128) else ''}"
    if re.fullmatch(r"[\d.:/-]+", core):
        return "numeric"
    if "/" in core and not (n >= 24 and len(_CASE.findall(core)) >= 8) and (core[0] == "/" or core.count("/") > 1 and not any(c.isdigit() for c in core) or re.fullmatch(r"[a-z_]+(?:/[\w.\-]+)+", core)):
        return "path"
    letters, digits = any(c.isalpha() for c in core), any(c.isdigit() for c in core)
    mark = any(c in "!*+%#~^" for c in core)
    turns = len(_CASE.findall(core))
    if letters and digits:
        if n >= 24 and turns >= 4:
            return "long"
        if re.fullmatch(r"[a-z_]+\d{0,2}", core) and n < 8:
            return "word"
        if n >= 7:
            return "marked" if mark else "mixed" if turns > 1 or n >= 10 else "lettered"
        return "short"
    if letters and mark and n >= 6:
        return "marked"
    if letters and turns >= 2 and n >= 10 and _entropy(core) > 2.7 and not re.fullmatch(r"(?:[a-z]+|[A-Z][a-z]+)(?:[A-Z][a-z]{2,})+", core):
        return "scrambled"
    if re.fullmatch(r"[\w-]+(?:\.[\w-]+)+", core):
        return "dotted"
    if re.fullmatch(r"-{1,2}\w[\w-]*", core):
        return "flag"
    return "word"


#: Shapes that few values but credentials and digests have; only a feature, no line is left out by it.
POSSIBLE = frozenset("prefixed hex hex32 hex40 hex64 hex128 uuid long marked mixed lettered scrambled public".split())


# Parts of names whose values people choose, and words that stand where a value is still to come.
CHOSEN = frozenset("password passwd passphrase pwd pass passe mdp pgpassword".split())
STAND_INS = frozenset("changeme change_me changeit required optional obligatoire requis none null nil true false yes no example exemple todo tbd unset default placeholder string str text bytes password secret token hidden masked redacted here empty undefined value valeur your votre prompt stdin".split())


@functools.lru_cache(maxsize=1 << 16)
def chosen(token: str) -> bool:
    return any(p.lower() in CHOSEN for p in _PARTS.findall(token))


@functools.lru_cache(maxsize=1 << 16)
def name_class(token: str) -> str:
    """What a name names: ``secret``, ``fingerprint``, ``meta`` (about a credential), ``other`` or ``none``."""
    parts = [p.lower() for p in _PARTS.findall(token.strip("-/"))]
    if not parts:
        return "none"
    naming = any(p in NAMING for p in parts) or "apikey" in token.lower() or "pass" in parts
    if naming:
        if any(p in OTHERWISE and p not in ("id",) for p in parts) or parts[-1] == "id" and "access" not in parts:
            return "meta"
        return "secret"
    return "fingerprint" if any(p in FINGERPRINT for p in parts) else "other"


Lexeme = tuple[int, int, str, str]  # start, end, text, kind


def lexemes(line: str, offset: int = 0) -> list[Lexeme]:
    """The tokens of a line without white space; kinds: pem, ref, run, and for others the character itself."""
    out = []
    for m in TOKEN.finditer(line):
        kind = m.lastindex
        if kind == 4:
            continue
        text = m.group()
        after = line[m.end() : m.end() + 1]
        if kind == 3 and text[-1] == "=" and after and after in "\"'" and line[max(0, m.start() - 1) : m.start()] != after:
            name = text.rstrip("=")  # the sign of an assignment, no padding: the quote behind it opens there
            out += [(m.start() + offset, m.start() + len(name) + offset, name, "run")] * bool(name)
            out += [(i + offset, i + 1 + offset, "=", "=") for i in range(m.start() + len(name), m.end())]
            continue
        if kind == 3 and text.startswith("//"):  # the rest of an address: its parts on their own
            out += [(p.start() + m.start() + offset, p.end() + m.start() + offset, p.group(), "/" if p.group() == "/" else "run") for p in re.finditer(r"/|[^/]+", text)]
            continue
        out.append((m.start() + offset, m.end() + offset, text, "pem" if kind == 1 else "ref" if kind == 2 else "run" if kind == 3 else text))
    return out


_PLAIN = {"is", "est", "by", "user", "login", "basic", "bearer", "-u", "--password", "--token", "--secret", "curl", "password", "passe", "mdp", "str", "mot", "de", "temp", "key", "value", "token", "clé", "machine", "connect", "identified", "authorization", "ref", "commit", "clone", "base64", "uid", "pwd"}


def features(tokens: list[Lexeme], line: str, offset: int = 0) -> list[list[str]]:
    """Shape and context of every token."""
    out: list[list[str]] = []
    names = [name_class(t[2]) if t[3] == "run" else "" for t in tokens]
    shapes = [shape(t[2]) if t[3] == "run" else t[3] for t in tokens]
    lower = [t[2].lower() if t[3] == "run" and len(t[2]) < 20 else "" for t in tokens]
    url = "://" in line
    command = "none"
    last_secret, last_name, gap = -1, "none", ""
    scheme, user = "", False
    pick, quote = False, ""  # whether the last name's value is one that people choose; the quote that is open behind it
    for i, (_, _, text, kind) in enumerate(tokens):
        s = shapes[i]
        # the delimiters since the last run, and what that run names
        f = [f"s:{s}", f"sg:{s}|{gap}", f"snk:{s}|{last_name}|{gap}", f"nk:{last_name}|{gap}"]
        if quote:
            f.append(f"q:{kind if kind not in ('run', 'ref') else s}")
        if kind in ("run", "pem", "ref"):
            n = len(text)
            size = "1" if n < 7 else "2" if n < 12 else "3" if n < 20 else "4" if n < 32 else "5"
            f.append(f"sl:{s}{size}")
            if kind == "pem":
                f.append(f"pem:{'PRIVATE' in text[:40]}")
            before = lower[i - 1] if i and lower[i - 1] in _PLAIN else tokens[i - 1][3] if i and tokens[i - 1][3] not in ("run", "ref") else "^" if not i else "w"
            before2 = lower[i - 2] if i > 1 and lower[i - 2] in _PLAIN else "w"
            after = tokens[i + 1][3] if i + 1 < len(tokens) else "$"
            f += [f"b:{before}", f"bs:{before}|{s}", f"b2:{before2}|{before}|{s}", f"a:{after}|{s}"]
            far = "n" if last_secret < 0 else "1" if i - last_secret <= 3 else "2" if i - last_secret <= 6 else "3"
            f.append(f"far:{far}|{s}")
            if scheme:
                f.append(f"sch:{scheme}|{s}")
            if url and after == "@" and before == ":":
                f += [f"url:{i > 1 and (tokens[i - 2][3] in ('run', ':'))}", "urlpass"]
            if user:
                f.append(f"user:{before}|{s}")
            if pick:
                f += [f"pk:{s}|{gap}", f"pkn:{len(text) > 3}|{gap}"]
            if lower[i] in STAND_INS:
                f.append(f"in:{last_name}")
            if names[i] in ("secret", "meta") and kind == "run":
                f.append(f"vn:{last_name}|{gap}")
            lw = lower[i]
            scheme = lw if lw in ("bearer", "basic") else ""
            user = user and before != ":" or lw in ("-u", "--user")
            if names[i] == "secret":
                last_secret = i
            if not quote:
                pick = names[i] == "secret" and chosen(text)
                last_name = "value" if s in POSSIBLE or kind == "ref" else names[i]
            gap = ""
        else:
            quote = "" if kind == quote else kind if kind in ('"', "'") and pick and gap[-1:] in (":", "=") else quote
            gap = (gap + kind)[-3:]
        command = command if command != "none" else s
        out.append(f)
    return out


@functools.lru_cache(maxsize=1)
def model() -> Crf:
    """The field, trained on the drafted lines (bounded by ``LINES``, the same in every run)."""
    rows = []
    for line, spans in drafted(LINES):
        tokens = lexemes(line)
        labels, inside = [], False
        for start, end, _, _ in tokens:
            hit = any(start < e and s < end for s, e in spans)
            labels.append((2 if inside and not any(s == start for s, _ in spans) else 1) if hit else 0)
            inside = hit
        rows.append((features(tokens, line), labels))
    return train(rows)


def _spans(line: str, crf: Crf) -> list[tuple[int, int]]:
    tokens = lexemes(line)
    found: list[tuple[int, int]] = []
    for label, (start, end, _, _) in zip(crf.decode(features(tokens, line)), tokens, strict=True):
        if label == 1:
            found.append((start, end))
        elif label == 2 and found:
            found[-1] = (found[-1][0], end)
    return found


class Finder:
    """Spans of credentials in a text, with a bounded memory of lines seen before."""

    def __init__(self, crf: Crf | None = None, keep: int = 50_000) -> None:
        self.crf, self.keep = crf or model(), keep
        self.known: dict[str, list[tuple[int, int]]] = {}

    def line(self, line: str) -> list[tuple[int, int]]:
        if not GATE.search(line.lower()):
            return []
        if line not in self.known:
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[line] = _spans(line, self.crf)
        return self.known[line]

    def __call__(self, text: str) -> list[tuple[int, int]]:
        """Half-open spans, in order, without overlaps; a null or empty text has none."""
        if not text or not GATE.search(text.lower()):
            return []
        out: list[tuple[int, int]] = []
        at = 0
        for block in PEM_BLOCK.finditer(text) if "-----BEGIN" in text else ():
            out += self._lines(text, at, block.start())
            label = self.crf.decode(features(lexemes(block.group(), block.start()), ""))
            if label and label[0]:
                out.append(block.span())
            at = block.end()
        return out + self._lines(text, at, len(text))

    def _lines(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        out = []
        for line in text[start:end].split("\n"):
            out += [(s + start, e + start) for s, e in self.line(line)]
            start += len(line) + 1
        return out


def leaves(value: object) -> Iterator[str]:
    """The string leaves of a decoded JSON value; keys are none."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from leaves(v)
    elif isinstance(value, list):
        for v in value:
            yield from leaves(v)


_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:)?')
_ESCAPE = re.compile(r"\\u[0-9a-fA-F]{4}|\\.|[^\\]", re.S)


def redacted_json(raw: str, find: Callable[[str], list[tuple[int, int]]], replacement: str | Callable[[str], str] = REDACTION) -> str:
    """``raw`` with the spans of its string leaves replaced, by one text or by what a function makes of each; every other character stays as it is written."""

    def literal(m: re.Match) -> str:
        if m.group(2) is not None:
            return m.group()
        inner = m.group(1)
        text = json.loads(f'"{inner}"', strict=False)
        spans = find(text)
        if not spans:
            return m.group()
        if "\\" not in inner:
            where = range(len(inner) + 1)
        else:
            where, at, high = [], 0, False
            for piece in _ESCAPE.findall(inner):
                pair = high and piece[:2] == "\\u" and piece[2].lower() == "d" and piece[3].lower() in "cdef"
                if not pair:
                    where.append(at)
                high = piece[:2] == "\\u" and piece[2].lower() == "d" and piece[3].lower() in "89ab"
                at += len(piece)
            where.append(at)
        out, at = [], 0
        for s, e in spans:
            out += [inner[at : where[s]], replacement if isinstance(replacement, str) else replacement(text[s:e])]
            at = where[e]
        return f'"{"".join(out)}{inner[at:]}"'

    return _LITERAL.sub(literal, raw)


def _parsed(raw: str | None) -> object | None:
    if not raw:
        return None
    try:
        return json.loads(raw, strict=False)
    except ValueError:
        return None


def findings(events: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key``, ``field_name``, ``secret``, ``start``, ``end`` (in the leaf) and ``leaf`` (its number) of each credential.

    ``fields`` hold JSON. Null, empty and broken JSON (a payload cut off) gives no rows; a null key is kept. Repeated
    rows give repeated findings; of readings that score alike the first label wins. Very long texts are read line by
    line, whole. An empty table gives no rows. Other columns are ignored.
    """
    crf = model()
    kind = events.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(crf)
        for batch in sliced(batches):
            at, rows = [], []
            for f, name in enumerate(fields):
                for i, raw in enumerate(batch.column(f + 1).to_pylist()):
                    for n, text in enumerate(leaves(_parsed(raw))):
                        for s, e in find(text):
                            at.append(i)
                            rows.append((name, text[s:e], s, e, n))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[key, "field_name", "secret", "start", "end", "leaf"])

    return events.select(key, *fields).mapInArrow(run, f"`{key}` {kind}, field_name string, secret string, start int, end int, leaf int")


def redacted(events: DataFrame, fields: list[str]) -> DataFrame:
    """All columns, with the credentials in the JSON ``fields`` replaced. Broken JSON is kept as it is."""
    crf = model()
    places = [events.columns.index(f) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(crf)
        for batch in sliced(batches):
            columns = list(batch.columns)
            for p in places:
                out = [raw if _parsed(raw) is None else redacted_json(raw, find) for raw in columns[p].to_pylist()]
                columns[p] = pa.array(out, pa.string())
            yield pa.record_batch(columns, names=batch.schema.names)

    return events.mapInArrow(run, events.schema)


def _events(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "tool_events", "event_id", "tool_input", "tool_response")


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """The credentials of tool_events, each value once per event and field."""
    return findings(_events(spark, directory), "event_id", ["tool_input", "tool_response"]).select("event_id", "field_name", "secret").distinct()


def p3_redacted(spark: SparkSession, directory: str) -> DataFrame:
    """Payloads of tool_events without credentials; redelivered events once."""
    return redacted(_events(spark, directory).dropDuplicates(["event_id"]), ["tool_input", "tool_response"])


QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted}
