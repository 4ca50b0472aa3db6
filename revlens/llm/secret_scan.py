"""Secret scans: keyword prefilter, anchored expressions near hits, checksums.

An Aho-Corasick automaton finds every keyword of the rules in one pass over a
text. A rule's expression is tried only at its keywords' positions, and rules of
self-checking tokens keep a candidate only if its embedded checksum is right.
Hexadecimal runs have no keyword; a run needs 24 of 16 letters, so a linear
search for the run itself is the filter.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from revlens.llm import kit

BASE_KINDS = ("assign", "access", "hex")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(number: int, width: int) -> str:
    digits = ""
    while number:
        number, rest = divmod(number, 62)
        digits = BASE62[rest] + digits
    return digits.rjust(width, "0")


def crc_suffix(token: re.Match) -> bool:
    """The last six characters are the CRC-32 of the random part, in base 62."""
    body = token[0].partition("_")[2]
    return base62(zlib.crc32(body[:-6].encode()), 6) == body[-6:]


def jwt_header(token: re.Match) -> bool:
    """The first part is Base64 of a JSON object that names an algorithm."""
    head = token[0].split(".")[0]
    try:
        header = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


def wif_checksum(token: re.Match) -> bool:
    """Base58Check: the last four bytes are a double SHA-256 of the rest."""
    alphabet = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
    number = 0
    for ch in token[0]:
        number = number * 58 + alphabet.index(ch)
    raw = number.to_bytes(38, "big").lstrip(b"\0")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched where a keyword begins. ``verdict`` decides on a
    match; one that fails is dropped, and the text that it took is not tried again
    by the same rule. Where no match begins, ``barren`` may name the place before
    which none can begin either, so that a run of keywords is read once."""

    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    verdict: Callable[[re.Match], bool]
    any_case: bool = False
    barren: Callable[[str, int], int] = lambda text, start: start + 1


ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)

_JWT_RUN = re.compile("[A-Za-z0-9_-]*")


def jwt_barren(text: str, start: int) -> int:
    """What follows a token's first part decides for all starts inside it."""
    return _JWT_RUN.match(text, start).end()


_PEM_HEAD = re.compile("-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s:,-]*")


def pem_barren(text: str, start: int) -> int:
    """Heads and ends are made of a body's characters, so a run of these that
    holds no end after one head holds none after its later heads."""
    head = _PEM_HEAD.match(text, start)
    return _PEM_BODY.match(text, head.end()).end() if head else start + 1


RULES = (
    Rule(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        ASSIGN,
        lambda m: len(m[2]) >= 6,
        any_case=True,
    ),
    Rule("access", ("AKIA",), re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    Rule(
        "checked",
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
        re.compile("(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
        crc_suffix,
    ),
    Rule(
        "jwt",
        ("eyJ",),
        re.compile(r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
        jwt_header,
        barren=jwt_barren,
    ),
    Rule(
        "private_key",
        ("-----BEGIN ",),
        re.compile(
            r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]*?-----END (?:[A-Z]+ )*PRIVATE KEY-----"
        ),
        lambda m: True,
        barren=pem_barren,
    ),
)

# A wallet key starts with any of three common characters, so its runs are found
# by their length and settled by their checksum.
WIF = re.compile(r"(?<![1-9A-HJ-NP-Za-km-z])[5KL][1-9A-HJ-NP-Za-km-z]{50,51}(?![1-9A-HJ-NP-Za-km-z])")
HEX = re.compile("[0-9a-f]{24,}")


class Scanner:
    """Finds (start, kind, end) in one text; positions are code points."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.automata = []
        for any_case in (True, False):
            automaton = ahocorasick.Automaton()
            for number, rule in enumerate(rules):
                for word in rule.keywords if rule.any_case is any_case else ():
                    automaton.add_word(word, (number, len(word)))
            automaton.make_automaton()
            self.automata.append((any_case, automaton))
        names = [*BASE_KINDS, *(r.kind for r in rules if r.kind not in BASE_KINDS), "wallet"]
        self.order = {kind: k for k, kind in enumerate(names)}

    def spans(self, text: str) -> list[tuple[int, int, int, str]]:
        """(start, rank of the kind, end, kind), sorted."""
        out = []
        after = dict.fromkeys(range(len(self.rules)), 0)
        for any_case, automaton in self.automata:
            if not len(automaton):
                continue
            # Lower-casing bytes changes ASCII letters only, so positions stay.
            seen = text.encode().lower().decode() if any_case else text
            for last, (number, length) in automaton.iter(seen):
                rule, start = self.rules[number], last + 1 - length
                if start < after[number]:
                    continue
                match = rule.pattern.match(text, start)
                if match is None:
                    after[number] = rule.barren(text, start)
                    continue
                after[number] = match.end()
                if rule.verdict(match):
                    out.append((start, self.order[rule.kind], match.end(), rule.kind))
        for match in HEX.finditer(text):
            out.append((match.start(), self.order["hex"], match.end(), "hex"))
        for match in WIF.finditer(text):
            if wif_checksum(match):
                out.append((match.start(), self.order["wallet"], match.end(), "wallet"))
        return sorted(out)


SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def find_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """(id, spans): every secret in every text, sorted by start, then kind.

    A null or empty text has no spans; rows with a null id or repeated rows are
    scanned like any other; other columns are left out. Texts of any length are
    scanned whole, in time that grows with their length.
    """

    def make():
        scanner = Scanner(rules)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [
                [{"start": s, "end": e, "kind": k} for s, _, e, k in scanner.spans(t)]
                for t in kit.texts_of(batch)
            ]
            kind = pa.list_(
                pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
            )
            return kit.columns(key=batch.column("key"), spans=pa.array(found, kind))

        return work

    key = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return kit.map_texts(narrow, make, f"key {key}, spans {SPANS}").withColumnRenamed("key", id_col)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def digest(found: DataFrame, kinds: tuple[str, ...], base: Column, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind and hash of the base spans, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        id_col,
        *[count(kind).alias(f"n_{kind}") for kind in kinds],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def base_spans() -> Column:
    """Of ``find_secrets``: the spans of the base kinds."""
    return F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))


def redact(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns; each secret in the text becomes ``[kind]``.

    Overlapping secrets become one mark, named after the first. A null text
    stays null.
    """
    fields = df.schema
    place = df.columns.index(text_col)

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            texts = [
                t if t is None else _redacted(t, scanner.spans(t))
                for t in batch.column(place).to_pylist()
            ]
            arrays = list(batch.columns)
            arrays[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return df.mapInArrow(run, fields)


def _redacted(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    out, at, open_end = [], 0, -1
    for start, _, end, kind in spans:
        if start < open_end:
            open_end = at = max(open_end, end)
            continue
        out += [text[at:start], f"[{kind}]"]
        open_end = at = end
    return "".join(out) + text[at:] if out else text
