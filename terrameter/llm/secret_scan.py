"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are assigned values, tokens of well-known shapes and long mixed tokens.  The forest looks
at a candidate's length, its character transitions, how much of it dictionary words cover, whether it
is part of a path, and the words beside it.  It is trained from labelled findings; the ones made by
``labelled_findings`` stand in where no reviewed findings are given.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches
from .trees import Tree, forest

MASK = "[SECRET]"

# Words that stand beside secrets, beside harmless tokens, and frequent parts of names.
SECRET_WORDS = ["key", "apikey", "token", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "credentials", "private", "access", "login", "clé", "jeton", "schlüssel", "passwort", "clave", "contraseña"]
HARMLESS_WORDS = ["commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "uuid", "guid", "id", "example", "sample", "test", "version", "revision", "integrity", "etag", "http", "https", "www", "file", "path", "import", "class"]
PLACEHOLDERS = ["changeme", "example", "your", "xxxx", "placeholder", "dummy", "insert", "redacted", "todo", "none", "null", "test", "sample", "password", "secret", "token"]
WORDS = "the and for that with from this have are not you all can had her was one our out day get has him his how man new now old see two way who boy did its let put say she too use name list map type file path data user value index count string number object array table query result error message server client request response config default option module package import export class public private static final return function method build test main home page image style script view model control manager service factory handler helper util core base common version release update delete create insert select where group order limit time date year month week hour minute second first last next previous open close read write start stop begin end left right top bottom width height size length color font title header footer content text body form field button link menu item node tree graph path edge point line area".split()  # noqa: E501

# Assigned values are found from their signs, which are rare: a name before the sign, and a value behind it,
# quoted without white space; quoted with it, as far as a phrase goes; or bare, where a comma or semicolon
# belongs to the value unless another name and sign follow it.
_SIGN = re.compile(r"[:=]")
_SIGNS = (":=", "=>")
NAMES = r"(?i:(?:api[_-]?key|key|token|secret|password|passwd|pwd|passwort|kennwort|schlüssel|mot[ _-]de[ _-]passe|jeton|clé|contraseña|clave|auth|credential)s?[\"']?\s{0,3})"
_NAMED_SIGN = re.compile(NAMES + r"\Z")
_NAME_CHARS = 20  # of the longest name with what may stand between it and its sign
VALUES = (
    r"(?:\"((?:[^\s\"\\]|\\\S){6,}+)\"|'((?:[^\s'\\]|\\\S){6,}+)'|\"((?:[^\"\\\n]|\\.){6,100}+)\"|'((?:[^'\\\n]|\\.){6,100}+)'(?!\w)"
    r"|[\"']?((?=[^\s\"'<>]{6})[^\s\"',;<>]++(?:[,;](?![\w.-]*+[\"']?\s{0,3}[:=])[^\s\"',;<>]++)*+))"
)
_VALUE_AFTER = re.compile(r"\s{0,3}" + VALUES)
_VALUE = 6  # least length of an assigned value
_LOGIN = re.compile(r"://[^\s/:@\"'<>]*+:([^\s/@\"'<>]{4,}+)@")  # a password before a host
# Runs of a web token begin where no such run does already, so that each is read once.
_SHAPED = re.compile(r"AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk[-_][A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,}|eyJ(?<![A-Za-z0-9_-]eyJ)[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++")
LEAST = 12
_LONG = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST},}}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_CASES = re.compile(r"[a-z][A-Z]|[/+_]")  # what tokens without a digit have beyond plain words
_PLAIN = 24  # least length of a token without a digit
_RULE = re.compile(r"([+/_=.-])\1{3,}")  # rule lines and filler between tokens
_NAMED = re.compile(r"[A-Za-z_][A-Za-z_.-]*[0-9]{0,3}=(?!=)")  # a name before its value
_NAME = re.compile(r"[^\W\d_]+")
_DICTIONARY = re.compile("|".join(sorted({w for w in WORDS + PLACEHOLDERS if len(w) > 2}, key=len, reverse=True)))

FEATURES = ["length", "log_transition", "class_changes", "digits", "upper", "distinct", "entropy", "dictionary", "in_path", "near_secret", "near_harmless", "assigned", "shaped", "hex_only", "placeholder", "hyphens", "dots", "uncovered", "symbols", "spaces"]


def _mixed(text: str, begin: int, end: int) -> bool:
    """Whether a token has letters and digits, or is long and no plain word."""
    if _LETTER.search(text, begin, end) is None:
        return False
    return _DIGIT.search(text, begin, end) is not None or end - begin >= _PLAIN and _CASES.search(text, begin, end) is not None


def _long_spans(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """The mixed parts of a long token between runs of one separator, or all of it where no part is mixed.

    A name and its equals sign before a part are left off where the value alone is mixed.
    """
    if end - begin < LEAST or not _mixed(text, begin, end):
        return []
    cuts = [begin, *[at for m in _RULE.finditer(text, begin, end) for at in m.span()], end]
    parts = [(b, e) for b, e in zip(cuts[::2], cuts[1::2], strict=True) if _mixed(text, b, e)] or [(begin, end)]
    values = [(m.end(), e) if (m := _NAMED.match(text, b, e)) and e - m.end() >= 8 and _mixed(text, m.end(), e) else (b, e) for b, e in parts]
    return values


def _value_span(text: str, begin: int, end: int) -> tuple[int, int]:
    """An assigned value without the rule line before it, where enough of it is left."""
    rule = _RULE.match(text, begin, end)
    return (rule.end(), end) if rule and end - rule.end() >= 6 else (begin, end)


def assigned_values(text: str) -> Iterator[tuple[int, int, int]]:
    """(begin of the name, begin and end of the value) of each assignment, from left to right, without overlaps."""
    done = 0
    for m in _SIGN.finditer(text):
        at = m.start()
        if at < done or not (name := _NAMED_SIGN.search(text[max(done, at - _NAME_CHARS) : at])):
            continue
        for length in (2, 1) if text.startswith(_SIGNS, at) else (1,):
            if value := _VALUE_AFTER.match(text, at + length):
                done = value.end()
                begin, end = value.span(value.lastindex)
                if end - begin >= _VALUE:
                    yield at - len(name[0]), begin, end
                break


def candidates(text: str) -> list[tuple[int, int, bool, bool]]:
    """(begin, end, assigned, shaped) of each candidate, without overlaps, in order.

    Spans that overlap are one candidate as far as any of them reaches, so no end of a secret stays
    outside.  The name to which a value is assigned belongs to no candidate; what a long token has
    before such a name is looked at by itself.
    """
    spans: list[tuple[int, int, bool, bool]] = [(*m.span(), False, True) for m in _SHAPED.finditer(text)]
    names: list[tuple[int, int]] = []
    for start, begin, end in assigned_values(text):
        names.append((start, begin))
        spans.append((*_value_span(text, begin, end), True, False))
    spans += [(*m.span(1), True, False) for m in _LOGIN.finditer(text)]
    at = 0
    for m in _LONG.finditer(text):
        begin, end = m.span()
        while at < len(names) and names[at][1] <= begin:
            at += 1
        k = at
        while k < len(names) and names[k][0] < end:
            spans += [(*span, False, False) for span in _long_spans(text, begin, names[k][0])]
            begin = max(begin, names[k][1])
            k += 1
        spans += [(*span, False, False) for span in _long_spans(text, begin, end)]
    out: list[tuple[int, int, bool, bool]] = []
    for begin, end, assigned, shaped in sorted(spans):
        if out and begin < out[-1][1]:
            b, e, a, s = out[-1]
            out[-1] = b, max(e, end), a or assigned, s or shaped
        else:
            out.append((begin, end, assigned, shaped))
    return out


_SEPARATORS, _SYMBOLS = " -_./\\:=", "!@#$%^&*"


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _transitions() -> np.ndarray:
    """Log-probabilities of letter pairs in ordinary names, from the word list."""
    table = np.full((27, 27), 0.3)
    for word in WORDS:
        codes = [26, *[ord(c) - 97 for c in word], 26]
        for a, b in zip(codes, codes[1:], strict=False):
            table[a, b] += 1
    return np.log(table / table.sum(1, keepdims=True))


_PAIRS = _transitions()


BEFORE, AFTER = 48, 32  # characters beside a candidate in which neighbouring words are looked for


def _letter(text: str, at: int) -> bool:
    return 0 <= at < len(text) and _NAME.match(text, at, at + 1) is not None


def _neighbours(text: str, begin: int, end: int) -> list[str]:
    """The last four whole words before and the first two after; a word that the window cuts is none."""
    first, last = max(0, begin - BEFORE), min(len(text), end + AFTER)
    before = [m for m in _NAME.finditer(text, first, begin) if m.start() > first or not _letter(text, first - 1)]
    after = [m for m in _NAME.finditer(text, end, last) if m.end() < last or not _letter(text, last)]
    return [m[0].lower() for m in before[-4:] + after[:2]]


def features(text: str, begin: int, end: int, assigned: bool, shaped: bool) -> list[float]:
    token = text[begin:end]
    n = len(token)
    low = token.lower()
    codes = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in low]
    pairs = [_PAIRS[a, b] for a, b in zip(codes, codes[1:], strict=False)]
    kinds = [_kind(c) for c in token]
    counts: dict[str, int] = {}
    for c in token:
        counts[c] = counts.get(c, 0) + 1
    near = _neighbours(text, begin, end)
    covered = sum(len(m[0]) for m in _DICTIONARY.finditer(low))
    path = token.count("/") + token.count("\\") + (text[max(0, begin - 3) : begin].endswith(("/", "\\", "://"))) + (text[end : end + 1] in "/\\" and end < len(text))
    return [
        math.log(n),
        float(np.mean(pairs)) if pairs else -3.0,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        kinds.count(2) / n,
        kinds.count(1) / n,
        len(counts) / min(n, 64),
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        covered / n,
        float(min(path, 5)),
        float(sum(w in SECRET_WORDS for w in near)),
        float(sum(w in HARMLESS_WORDS for w in near)),
        float(assigned),
        float(shaped),
        float(all(c in "0123456789abcdefABCDEF" for c in token)),
        float(any(p in low for p in PLACEHOLDERS)),
        token.count("-") / n,
        token.count(".") / n,
        math.log(1 + n - covered - sum(counts.get(c, 0) for c in _SEPARATORS)),
        sum(counts.get(c, 0) for c in _SYMBOLS) / n,
        counts.get(" ", 0) / n,
    ]


_HEX, _MIXED, _DIGITS, _UPPER = "0123456789abcdef", string.ascii_letters + string.digits, string.digits, string.ascii_uppercase


def _pick(r: random.Random, chars: str, k: int) -> str:
    return "".join(r.choice(chars) for _ in range(k))


def _words(r: random.Random, k: int, sep: str) -> str:
    return sep.join(r.choice(WORDS) for _ in range(k))


# Shapes of findings by name: what a reviewer would call a secret, and what a reviewer would not.
TRUE_SHAPES = {
    "hex": lambda r: _pick(r, _HEX, r.choice([32, 40, 48, 64])),
    "short_hex": lambda r: _pick(r, _HEX, r.randint(12, 30)),
    "upper_hex": lambda r: _pick(r, _HEX, r.choice([32, 40])).upper(),
    "mixed": lambda r: _pick(r, _MIXED, r.randint(16, 64)),
    "base64": lambda r: _pick(r, _MIXED + "+/", r.randint(24, 60)) + "=" * r.randint(0, 2),
    "access_id": lambda r: "AKIA" + _pick(r, _UPPER + _DIGITS, 16),
    "hub_token": lambda r: "ghp_" + _pick(r, _MIXED, 36),
    "service_key": lambda r: r.choice(["sk-", "sk-proj-", "sk_live_", "sk-"]) + _pick(r, _MIXED, r.randint(20, 48)),
    "password": lambda r: _pick(r, _MIXED + "!@#%^&*", r.randint(8, 24)),
    "web_token": lambda r: f"eyJ{_pick(r, _MIXED, 20)}.{_pick(r, _MIXED, 40)}.{_pick(r, _MIXED, 30)}",
    "phrase": lambda r: _words(r, r.randint(1, 2), "").title() + _pick(r, _DIGITS, r.randint(2, 10)) + _pick(r, "!@#%^&*", r.randint(1, 2)) + _pick(r, _MIXED, r.randint(0, 4)) + _words(r, r.randint(0, 1), "").title(),
    "grouped": lambda r: "-".join(_pick(r, _MIXED, r.choice([5, 6, 8])) for _ in range(r.randint(3, 5))),
    "spaced": lambda r: f"{_words(r, r.randint(1, 3), ' ')} {_pick(r, _DIGITS, r.randint(1, 4))}{r.choice(['', '!', '#'])} {_words(r, r.randint(1, 2), ' ')}",
    "code_groups": lambda r: " ".join(_pick(r, r.choice([_HEX, _MIXED, _DIGITS]), r.randint(4, 6)) for _ in range(r.randint(3, 6))),
    "listed": lambda r: f"{_pick(r, _MIXED, r.randint(2, 6))}{r.choice(',;')}{_pick(r, _MIXED, r.randint(8, 20))}",
    "escaped": lambda r: f"{_pick(r, _MIXED, r.randint(2, 8))}{r.choice([chr(92) + chr(34), chr(92) * 2])}{_pick(r, _MIXED, r.randint(6, 14))}",
}
FALSE_SHAPES = {
    "name": lambda r: _words(r, r.randint(2, 4), "_") + _pick(r, _DIGITS, 2),
    "path": lambda r: r.choice(["", "/", "./"]) + _words(r, r.randint(3, 6), "/") + r.choice([".py", ".txt", "", "_v"]) + _pick(r, _DIGITS, 1),
    "uuid": lambda r: "-".join(_pick(r, _HEX, k) for k in (8, 4, 4, 4, 12)),
    "placeholder": lambda r: r.choice(PLACEHOLDERS) + "_" + _words(r, 2, "_"),
    "filler": lambda r: r.choice("xX0*") * r.randint(12, 30),
    "release": lambda r: _words(r, r.randint(2, 4), "-") + f"-v{r.randint(0, 20)}.{r.randint(0, 30)}",
    "dated": lambda r: _words(r, 3, ".") + f".20{_pick(r, _DIGITS, 2)}.{_pick(r, '01', 2)}",
    "tag": lambda r: "<" + _words(r, 2, "_") + ">",
    "bits": lambda r: _pick(r, "01", r.randint(20, 40)),
    "camel": lambda r: _words(r, 1, "") + _words(r, 2, "").title() + _words(r, 1, "").title() + _pick(r, _DIGITS, 1),
    "host": lambda r: f"{r.choice(WORDS)}{_pick(r, _DIGITS, r.randint(1, 2))}.{r.choice(WORDS)}.{r.choice(['com', 'org', 'net', 'example.com'])}",
    "address": lambda r: f"{r.choice(WORDS)}.{_pick(r, _DIGITS, 2)}@{r.choice(WORDS)}{_pick(r, _DIGITS, 1)}.example.{r.choice(['com', 'org'])}",
    "time": lambda r: f"20{_pick(r, _DIGITS, 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T1{r.randint(0, 9)}:{_pick(r, '012345', 2)}:00Z",
    "link": lambda r: f"https://{r.choice(WORDS)}.example.com/{_words(r, r.randint(1, 3), '/')}/{_pick(r, _DIGITS, r.randint(2, 6))}",
    "package": lambda r: f"{_words(r, r.randint(1, 2), '-')}-{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}-{r.choice(['py3', 'cp313', 'linux64', 'x86_64'])}",
}
# The values of this shape have spaces and are quoted; so are those of some true shapes.
FALSE_SHAPES["sentence"] = lambda r: _words(r, r.randint(3, 9), " ")
FALSE_SHAPES["title"] = lambda r: _words(r, r.randint(2, 6), " ").title() + r.choice(["", ".", ":", f" {r.randint(1, 9)}"])
FALSE_SHAPES["labels"] = lambda r: _words(r, r.randint(2, 5), r.choice([",", ";"]))
HASH_SHAPES = {"sha1": lambda r: _pick(r, _HEX, 40), "md5": lambda r: _pick(r, _HEX, 32), "sha256": lambda r: _pick(r, _HEX, 64)}
_HASH_NAMES = ["commit", "sha256:", "md5 checksum", "hash", "revision", "digest", "etag", "integrity sha256-", "checksum:", "sha1 ", "uuid", "blob id"]


def labelled_findings(n: int = 4000, seed: int = 5, without: frozenset[str] = frozenset(), only: str | None = None) -> list[tuple[str, int, int, int]]:
    """``n`` findings as (text, begin, end, label); label 1 is a true secret.

    Made by rule: random tokens in the shapes of credentials beside secret-like words, against
    hashes, identifiers, paths, addresses, placeholders and plain words in the same layouts.  Shapes
    in ``without`` are left out; ``only`` makes findings of one shape.
    """
    r = random.Random(seed)
    true, false, hashes = ({k: f for k, f in shapes.items() if k not in without and only in (None, k)} for shapes in (TRUE_SHAPES, FALSE_SHAPES, HASH_SHAPES))
    filler = lambda: _words(r, r.randint(2, 8), " ")
    out = []
    for i in range(n):
        name = r.choice(["token", "api_key", "secret", "password", "API_KEY", "auth_token", "key", "Token", "TOKEN", "DB_PASSWORD", "client_secret"])
        assign = r.choice([' = "', '="', ": ", ": '", "=", " = ", " := "])
        label = int(bool(true) and (i % 2 == 1 or not (false or hashes)))
        tail = None
        if label:
            shape, make = r.choice(sorted(true.items()))
            token = make(r)
            known = shape in ("access_id", "hub_token", "service_key", "web_token")
            lead = f"{filler()} {name}{assign}" if not known or r.random() < 0.85 else f"{filler()} "
        elif hashes and (not false or r.random() < 0.3):
            token = r.choice(sorted(hashes.items()))[1](r)
            lead = f"{filler()} {r.choice(_HASH_NAMES)} "
        else:
            token = r.choice(sorted(false.items()))[1](r)
            lead = f"{filler()} {name}{assign}" if r.random() < 0.4 or " " in token else f"{filler()} {r.choice(['', 'https://', 'file ', 'path ', 'import ', 'id ', 'see ', 'from '])}"
        if " " in token or "\\" in token:
            lead, tail = f"{filler()} {name}{r.choice([' = ', '=', ': '])}\"", '"'
        elif r.random() < 0.08 and not any(c in "/@<>:" for c in token) and lead.endswith(assign):
            lead, tail = f"{filler()} {r.choice(['postgres', 'mysql', 'redis', 'https', 'amqp'])}://{r.choice(WORDS)}:", f"@{r.choice(WORDS)}{r.choice(['', '.example.com', '.internal:5432/home'])}"
        if tail is None:
            tail = r.choice(['"', "", "'", "###", "!!"]) if lead[-1] in "\"'" else ""
        out.append((f"{lead}{token}{tail} {filler()}", len(lead), len(lead) + len(token), label))
    return out


@dataclass(frozen=True)
class Limits:
    findings: int = 20_000  # labelled findings that the forest is trained from, at most
    trees: int = 30
    depth: int = 9


@dataclass(frozen=True)
class Scanner:
    trees: list[Tree]
    threshold: float = 0.5

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        x = np.array(rows, float)
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(rows) else np.zeros(0)

    def scan(self, text: str) -> list[tuple[int, int, float]]:
        """(begin, end, score) of every candidate of one whole text, in code points."""
        found = candidates(text)
        return [(b, e, float(s)) for (b, e, _, _), s in zip(found, self.scores([features(text, *c) for c in found]), strict=True)]


def train(findings: list[tuple[str, int, int, int]] | None = None, limits: Limits = Limits(), seed: int = 11) -> Scanner:
    """The forest from labelled findings (text, begin, end, label), at most ``limits.findings`` of them."""
    rows, labels = [], []
    for text, begin, end, label in (labelled_findings() if findings is None else findings)[: limits.findings]:
        hit = next((c for c in candidates(text) if c[0] < end and c[1] > begin), (begin, end, False, False))
        rows.append(features(text, *hit))
        labels.append(label)
    return Scanner(forest(np.array(rows, float), np.array(labels, float), limits.trees, limits.depth, seed))


def scan_documents(docs: DataFrame, scanner: Scanner, text_col: str = "text") -> DataFrame:
    """``docs`` with n_candidates, findings (begin, end, score) and ``text_col`` masked in place.

    Candidates that the forest takes for secrets are replaced; everything else stays.  Null and empty
    texts stay as they are and have no findings.  Repeated rows and null ids stay.  Columns of
    ``docs`` with the names of the new ones are replaced.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_candidates", "findings")]
    shared = docs.sparkSession.sparkContext.broadcast(scanner)  # trees x 2^depth nodes at most
    finding = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared.value
        for b in batches:
            texts = b.column(at).to_pylist()
            found = [candidates(t or "") for t in texts]
            scores = iter(one.scores([features(t, *c) for t, cs in zip(texts, found, strict=True) for c in cs]))
            hits, masked = [], []
            for t, cs in zip(texts, found, strict=True):
                own = [{"begin": c[0], "end": c[1], "score": float(next(scores))} for c in cs]
                own = [x for x in own if x["score"] >= one.threshold]
                hits.append(own)
                if own:
                    ends = [0, *[x["end"] for x in own]]
                    t = MASK.join([t[e : x["begin"]] for e, x in zip(ends, own, strict=False)] + [t[ends[-1] :]])
                masked.append(t)
            columns = [pa.array(masked, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            columns += [pa.array([len(cs) for cs in found], pa.int64()), pa.array(hits, pa.list_(finding))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_candidates", "findings"])

    kept = docs.select(*[docs[c].cast("string").alias(c) if c == text_col else docs[c] for c in names])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{kinds}, n_candidates long, findings array<struct<begin: long, end: long, score: double>>")


def scan_report(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_candidates, n_secrets, spans (begin-end pairs) and the masked text's SHA-256."""
    rows = scan_documents(docs.select(F.col(id_col), F.col(text_col)), scanner, text_col)
    spans = F.array_join(F.transform("findings", lambda x: F.concat_ws("-", x["begin"], x["end"])), ",")
    return rows.select(id_col, "n_candidates", F.size("findings").cast("bigint").alias("n_secrets"), spans.alias("spans"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("masked_sha256"))
