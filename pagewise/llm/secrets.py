"""Secret scans: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .forest import Forest, plant

MARK = "[SECRET]"
#: Code points of context on each side that features read.
NEAR = 60

# Names that secrets are assigned to, names of harmless values,
# words of placeholders, prefixes of issued keys, and common words.
SECRET_NAMES = "password passwd pwd pass secret token apikey api_key api-key access_key accesskey auth authorization bearer credential credentials client_secret private_key signing_key session_key encryption_key".split()
PLAIN_NAMES = "commit sha sha1 sha256 md5 checksum digest hash etag version build revision uuid guid id isbn issn order invoice tracking serial model part number color page ref href src url path file image figure table".split()
PLACEHOLDERS = "example sample your changeme placeholder dummy test fake redacted xxxx none null todo insert here".split()
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "pk_live_", "AIza", "eyJ", "npm_", "hf_")
COMMON = "the and for that with this from have are was not you all can one our out get use new time file data name value list page text code user example test default config server client system number string object class method index table field type path image version release build order model report local public private static return import".split()

RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}")
SIGN = re.compile(r"[:=]")
NAME = re.compile(r"([A-Za-z][A-Za-z0-9_.-]*)[\"'\]]{0,2}[ \t]{0,8}$")
VALUE = re.compile(r"[=>]?[ \t]{0,8}([\"'`]?)(?:(?:bearer|basic|token)[ \t]{1,8})?(?=[^\s\"'`<>,;(){}])", re.I)
#: Runs that values are taken from.
PIECE = re.compile(r"[^\s\"'`<>,;(){}]+")
TRAILING = "$%&*#!?.,:;)]}|"
PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
PEM_END = re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY-----")
WORD = re.compile(r"[A-Za-z][A-Za-z_-]+")
ASSIGNED = re.compile(r"[:=]=?[ \t]{0,8}[\"'`]?(?:(?:bearer|basic|token)[ \t]{1,8})?$", re.I)
HAS_DIGIT, HAS_LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
BASE64, HEX = re.compile(r"[A-Za-z0-9+/]{4,}={0,2}"), re.compile("[0-9a-f]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")

#: A candidate is a secret if the forest's mean is at least this.
AT_LEAST = 0.5


@dataclass
class Candidate:
    start: int
    end: int
    name: str
    quoted: bool


def candidates(text: str) -> list[Candidate]:
    """Assigned values of secret names, key blocks, and long runs of digits with letters, by start.

    A value ends where the next assignment to a secret name begins, and a key
    block before the next one, so of each sort candidates lie apart and the work
    is linear in the text. Those of different sorts may overlap; ``scan`` settles that.
    """
    found: list[Candidate] = []
    begins = [m.span() for m in PEM.finditer(text)] if "-----BEGIN " in text else []
    if begins:
        ends = [m.span() for m in PEM_END.finditer(text)]
        for (a, b), (after, _) in zip(begins, [*begins[1:], (len(text), 0)]):
            i = bisect_left(ends, (b, 0))
            whole = i < len(ends) and ends[i][0] < after
            found.append(Candidate(a, ends[i][1] if whole else b, "", False))
    signs = []
    for m in SIGN.finditer(text):
        name = NAME.search(text[max(0, m.start() - NEAR) : m.start()])
        if name and _kind(name[1].lower(), SECRET_NAMES) and (v := VALUE.match(text, m.end())):
            begin = m.start() - len(name[0])
            signs.append((begin, v.end(), name[1].lower(), bool(v[1])))
    pieces = PIECE.finditer(text) if signs else iter(())
    a = b = 0
    for (_, at, name, quoted), (after, *_) in zip(signs, [*signs[1:], (len(text),)]):
        while b <= at and (p := next(pieces, None)):
            a, b = p.span()
        if a <= at < b:
            value = text[at : max(at, min(b, after))].rstrip(TRAILING)
            if len(value) >= 6:
                found.append(Candidate(at, at + len(value), name, quoted))
    for m in RUN.finditer(text):
        s = m.group()
        if s.startswith(PREFIXES) or HAS_DIGIT.search(s) and HAS_LETTER.search(s):
            before = text[max(0, m.start() - NEAR) : m.start()]
            assigned = ASSIGNED.search(before)
            name = NAME.search(before[: assigned.start()]) if assigned else None
            found.append(Candidate(m.start(), m.end(), name[1].lower() if name else "", before[-1:] in ("'", '"')))
    return sorted({(c.start, -c.end): c for c in reversed(found)}.values(), key=lambda c: (c.start, -c.end))


def _kind(name: str, names: list[str]) -> bool:
    return any(name == n or name.endswith(("_" + n, "-" + n, "." + n)) or name.startswith(n + "_") for n in names)


def _classes(value: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points; and of each its class: digit, lower, upper or other."""
    c = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    k = np.full(len(c), 3, dtype=np.int8)
    for i, (a, b) in enumerate((("0", "9"), ("a", "z"), ("A", "Z"))):
        k[(c >= ord(a)) & (c <= ord(b))] = i
    return c, k


def features(before: str, value: str, after: str, name: str, quoted: bool, path: str) -> list[float]:
    """Length, make-up, character transitions, dictionary coverage, names, neighbouring words and path, of the whole value."""
    points, kinds = _classes(value)
    n = len(value)
    share = (np.bincount(kinds, minlength=4)[:4] / n).tolist()
    turns = float((kinds[1:] != kinds[:-1]).sum() / max(1, n - 1))
    _, counts = np.unique(points, return_counts=True)
    p = counts / n
    low = value.lower()
    if len(low) != n:  # a character whose lower case is two
        low = "".join(c.lower()[:1] for c in value)
    covered = np.zeros(n + 1, dtype=np.int32)
    near = {w.lower() for w in WORD.findall(before + " " + after)}
    for w in {*COMMON, *PLACEHOLDERS, *(x for x in near if len(x) >= 4)}:
        at = low.find(w)
        while at >= 0:
            covered[at] += 1
            covered[at + len(w)] -= 1
            at = low.find(w, at + 1)
    letters = share[1] + share[2]
    vowels = sum(low.count(c) for c in "aeiou") / n
    key_block = value.startswith("-----BEGIN ")
    body = sum(len(x) for x in value.split("\n")[1:] if BASE64.fullmatch(x.strip())) if key_block else 0
    return [
        float(np.log2(n)), *share, turns, float(-(p * np.log2(p)).sum()), len(p) / n,
        float(HEX.fullmatch(low) is not None), float((np.cumsum(covered[:-1]) > 0).mean()), vowels / letters if letters else 0.0,
        float(bool(name)), float(_kind(name, SECRET_NAMES)), float(_kind(name, PLAIN_NAMES)),
        float(any(w in low for w in PLACEHOLDERS)), float(value.startswith(PREFIXES)), float(bool(UUID.fullmatch(value))),
        float(len(near & set(SECRET_NAMES))), float(len(near & set(PLAIN_NAMES))), float(quoted),
        float(any(w in path.lower() for w in ("test", "example", "doc", "lock", "fixture"))),
        float(key_block), float(np.log2(1 + body)),
    ]


def labelled_findings(seed: int = 11, each: int = 150) -> list[tuple[str, str, str, str, bool, str, int]]:
    """The labelled table: before, value, after, name, quoted, path, label; ``each`` rows of every kind.

    Made by rule from a seed, so its size is fixed: issued keys, hex and base64
    values and typed passwords under secret names; against these, placeholders,
    checksums, identifiers, versions, file names, encoded words and prose with digits,
    and key blocks without a key.
    """
    rng = np.random.default_rng(seed)

    def pick(chars: str, n: int) -> str:
        return "".join(chars[i] for i in rng.integers(0, len(chars), n))

    def one(xs) -> str:
        return xs[int(rng.integers(0, len(xs)))]

    def prose() -> str:
        return " ".join(pick("etaoinshrdlu", int(rng.integers(2, 9))) if rng.random() < 0.6 else one(COMMON) for _ in range(6))

    hexes, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = []

    def add(value: str, label: int, name: str = "", quoted: bool = False, lead: str = "", path: str | None = None) -> None:
        before = f"{prose()} {name + one(('=', ' = ', ': ')) if name else lead}{chr(34) * quoted}"
        rows.append((before, value, f"{chr(34) * quoted} {prose()}", name, quoted, one(("src12", "app/settings.py", "notes.md", "web")) if path is None else path, label))

    for _ in range(each):
        q = bool(rng.integers(0, 2))
        add(pick(hexes, int(rng.integers(16, 65))), 1, one(SECRET_NAMES), q)
        add(pick(hexes, 40), 1, "token", True)
        add(pick(hexes, int(rng.integers(12, 24))), 1, "password")
        add(pick(hexes[:10] + hexes[10:] * int(rng.integers(1, 4)), int(rng.integers(12, 32))), 1, one(SECRET_NAMES))
        add("AKIA" + pick(upper, 16), 1)
        add(one(("ghp_", "glpat-", "sk-", "xoxb-", "AIza", "hf_")) + pick(mixed, int(rng.integers(20, 40))), 1, one((*SECRET_NAMES, "")), q)
        add(pick(mixed + "+/", int(rng.integers(20, 60))), 1, one(SECRET_NAMES), q)
        add(pick(mixed + "!@#-_", int(rng.integers(8, 16))), 1, one(("password", "passwd", "pwd")), q)
        add(pick(mixed, int(rng.integers(30, 60))), 1)
        add(one(PLACEHOLDERS) + one(("", "-", "_")) + one(("key", "token", "password", "1234", "value")), 0, one(SECRET_NAMES), q)
        add(pick("abcdefghijklmnoprstu", int(rng.integers(6, 12))), 0, one(SECRET_NAMES[:6]), False)
        add(pick(hexes, one((32, 40, 64))), 0, one(PLAIN_NAMES[:10]), q)
        add(pick(hexes, one((12, 32, 40, 64))), 0, lead=f"{one(PLAIN_NAMES[:10])} ")
        u = pick(hexes, 32)
        add("-".join((u[:8], u[8:12], u[12:16], u[16:20], u[20:])), 0, one(("", "id", "uuid")), q)
        add(f"{one(COMMON)}-{one(COMMON)}-{one(COMMON)}-{int(rng.integers(1, 3000))}", 0)
        add(f"{one(COMMON)}_{one(COMMON)}_{int(rng.integers(1, 99))}/{one(COMMON)}", 0, one(("", "path", "file")), q)
        add(pick("etaoinshrdlu", int(rng.integers(9, 18))) + str(int(rng.integers(1, 2100))), 0)
        add(f"{one(COMMON)}{one(COMMON)}{one(COMMON)}{int(rng.integers(1, 99))}", 0, one(("", *SECRET_NAMES[:3])), False, path="tests/fixtures.py")
        lines = [pick(mixed + "+/", 64 if i else int(rng.integers(6, 65))) for i in range(int(rng.integers(1, 25)))]
        kind = one(("", "RSA ", "EC ", "OPENSSH ", "DSA "))
        begin, end = f"-----BEGIN {kind}PRIVATE KEY-----", f"-----END {kind}PRIVATE KEY-----"
        add("\n".join((begin, *lines, end)), 1)
        add(begin, 0)
        add("\n".join((begin, one(("...", "<key>", "your key here", "xxxx", "[...]", "")), end)), 0)
        add(f"{begin} {one(COMMON)} {end}", 0)
        word = lambda a, b: pick("bcdfghklmnprstvw", 1) + pick("aeiou", 1) + pick("abcdefghiklmnoprstu", int(rng.integers(a, b)))
        login = one(("password", "passwd", "pwd", "pass", "db_password"))
        add(word(3, 8) + pick("0123456789", int(rng.integers(1, 5))) + one(("", "", "!", "#")), 1, login, q)
        add(word(3, 8).capitalize() + one(("_", "-", "!", "")) + pick("0123456789", int(rng.integers(1, 5))), 1, login, q)
        add(word(6, 12), 0, login)
        add(one(("required", "enabled", "optional", "disabled", "true", "string", "hidden", "missing")), 0, one(SECRET_NAMES), q)
        add(f"https://{word(3, 8)}.example.com/{one(COMMON)}?{one(COMMON)}", 0, one(SECRET_NAMES), q)
        add("os_environ_" + one(SECRET_NAMES) + str(int(rng.integers(1, 9))), 0, one(SECRET_NAMES))
    return rows


def train(seed: int = 11) -> Forest:
    rows = labelled_findings(seed)
    x = np.array([features(*r[:6]) for r in rows])
    return plant(x, np.array([r[6] for r in rows], dtype=np.float64))


def scan(text: str, path: str, forest: Forest) -> list[tuple[int, int, float]]:
    """Start, end and score of candidates that lie apart: of overlapping ones the
    forest's secrets first, then the earlier, then the longer."""
    found = candidates(text)
    if not found:
        return []
    x = np.array([features(text[max(0, c.start - NEAR) : c.start], text[c.start : c.end], text[c.end : c.end + NEAR], c.name, c.quoted, path) for c in found])
    score = forest.predict(x)
    out: list[tuple[int, int, float]] = []
    taken = 0
    for c, s in zip(found, score):  # by start
        if s >= AT_LEAST and c.start >= taken:
            out.append((c.start, c.end, float(s)))
            taken = c.end
    sure = [(a, b) for a, b, _ in out]
    taken = i = 0
    for c, s in zip(found, score):
        while i < len(sure) and sure[i][1] <= c.start:
            i += 1
        if s < AT_LEAST and c.start >= taken and (i == len(sure) or sure[i][0] >= c.end):
            out.append((c.start, c.end, float(s)))
            taken = c.end
    return sorted(out)


FINDING = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def findings_column(spark: SparkSession, text_col: str = "text", path_col: str = "source") -> Column:
    """All candidates of a text with their scores; the forest (a few hundred kB) is broadcast."""
    held = spark.sparkContext.broadcast(train())

    @F.pandas_udf(T.ArrayType(FINDING))
    def findings(text: pd.Series, path: pd.Series) -> pd.Series:
        out = [[{"start": a, "end": b, "score": s} for a, b, s in scan(t, p, held.value)] for t, p in zip(text, path)]
        return pd.Series(out, dtype=object)

    return findings(F.coalesce(text_col, F.lit("")), F.coalesce(path_col, F.lit("")))


def redacted_column(spark: SparkSession, text_col: str = "text", path_col: str = "source") -> Column:
    """The text with each secret replaced by ``MARK``; a null text stays null."""
    held = spark.sparkContext.broadcast(train())

    @F.pandas_udf(T.StringType())
    def redacted(text: pd.Series, path: pd.Series) -> pd.Series:
        out = []
        for t, p in zip(text, path):
            if t is not None:
                for a, b, s in reversed(scan(t, p, held.value)):
                    t = f"{t[:a]}{MARK}{t[b:]}" if s >= AT_LEAST else t
            out.append(t)
        return pd.Series(out, dtype=object)

    return redacted(F.col(text_col), F.coalesce(path_col, F.lit("")))


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_candidates``, ``n_secrets``, ``spans``.

    Spans are start:end in code points, end exclusive, of what the forest calls
    a secret, comma-joined. A score of just ``AT_LEAST`` is one. Whole texts and
    whole values are read, in time linear in their length; null and empty texts
    have none; repeated rows stay, each scanned alike; other columns are not
    read, so their names don't matter. No rows: none.
    """
    got = docs.select("doc_id", findings_column(docs.sparkSession).alias("f"))
    sure = F.filter("f", lambda x: x["score"] >= AT_LEAST)
    spans = F.array_join(F.transform(sure, lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return got.select("doc_id", F.size("f").cast("long").alias("n_candidates"), F.size(sure).cast("long").alias("n_secrets"), spans.alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced and ``n_chars``, where there is one, counted anew.

    Other columns stay as they are, whatever their names; null texts stay null. No rows: none.
    """
    out = docs.withColumn("text", redacted_column(docs.sparkSession))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), "n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in docs.columns))
