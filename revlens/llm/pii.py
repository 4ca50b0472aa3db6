"""Personal data: a semi-Markov conditional random field over candidate zones.

Base expressions find spans of four kinds; these always stay. The field adds
spans that the expressions miss, such as a telephone number without its plus or
an address with "(at)". Only text near a digit or an at sign can hold an entity,
so decoding runs in zones around those; inside a zone, dynamic programming over
atoms chooses boundaries and kinds of all segments together, entities being at
most ``longest`` atoms. Features look at whole spans.

The weights come from the base spans of a bounded sample of the corpus, with
copies of them rewritten in the forms that the expressions miss, by structured
training: the loss is the negative log-likelihood of the segmentation, its
gradient the difference of feature counts under the forward-backward marginals.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from revlens.llm import kit
from revlens.llm.secret_scan import SPANS

KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Options:
    """Weights are fitted on at most ``max_rows`` texts, and on at most
    ``max_zones`` zones of them: up to half of these hold entities, as many for
    each kind, and up to half hold none. All texts are searched."""

    max_rows: int = 2_000
    max_zones: int = 3_000
    epochs: int = 6
    rate: float = 0.3
    longest: int = 24
    margin: float = 2.0


# --- base expressions -------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with a local part before it, which begins after the last
    match, and a dotted domain after it. The same spans as the expression's, in
    time that grows with the text."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            after = domain.end()
        at = text.find("@", max(at + 1, after))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Fours of the numbers in each chain of dotted numbers."""
    for chain in _CHAIN.finditer(text):
        parts = list(re.finditer("[0-9]+", chain[0]))
        for k in range(0, len(parts) - 3, 4):
            if all(int(p[0][-4:]) <= 255 and len(p[0].lstrip("0")) <= 3 for p in parts[k : k + 4]):
                yield chain.start() + parts[k].start(), chain.start() + parts[k + 3].end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    out += [(s, 1, e) for s, e in addresses(text)]
    for m in _CARD.finditer(text):
        if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the field --------------------------------------------------------------

# What a zone needs, and how far it reaches: one token back, three on.
_TRIGGER = re.compile(r"[0-9]{2}|@|[(\[](?:at|AT)[)\]]")
_ONWARD = re.compile(r"[^\s]{0,80}(?:[ ]{1,2}[^\s]{1,40}){0,3}")
_BACK = 80
_ATOM = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
_SHAPE = re.compile("[0-9]+")
_LETTERS = re.compile("[A-Za-z]+")


def shape(span: str) -> str:
    """The span with each run of digits as its length and of letters as ``a``."""
    return _LETTERS.sub("a", _SHAPE.sub(lambda m: f"<{min(len(m[0]), 20)}>", span))


def span_features(zone: str, start: int, end: int) -> list[str]:
    """Of a candidate segment as a whole."""
    span = zone[start:end]
    digits = digits_of(span)
    count = len(digits)
    marks = "".join(sorted(set(_ATOM.sub(lambda m: "" if m[0].isalnum() else m[0], span))))
    before = zone[max(0, start - 1) : start]
    after = zone[end : end + 1]
    out = [f"marks={marks[:8]}", f"digits={min(count, 20)}", f"letters={bool(_LETTERS.search(span))}"]
    out.append(f"before={'w' if before.isalnum() else before.strip() or '_'}")
    out.append(f"after={'w' if after.isalnum() else after.strip() or '_'}")
    if not _LETTERS.search(span):
        out.append(f"shape={shape(span)[:40]}")
        if 12 <= count <= 19:
            out.append(f"luhn={luhn(digits)}")
        parts = span.split(".")
        if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
            out.append(f"octets={all(len(p) <= 3 and int(p) <= 255 for p in parts)}")
        out.append(f"phone_size={9 <= count <= 15}")
    else:
        low = span.lower()
        signs = [s for s in ("@", "(at)", "[at]") if s in low]
        dots = any(d in low for d in (".", "(dot)", "[dot]"))
        out.append(f"address={len(signs) == 1},{dots}")
        held = [c for c in span if not c.isalnum()]
        out.append(f"marks_at_ends={held[0]}{held[-1]}" if held else "no_marks")
        out.append(f"blanks={min(span.count(' '), 4)}")
    return out


def entity_ends(atoms: list[tuple[int, int]], zone: str, first: int, longest: int) -> list[int]:
    """Atoms that a candidate from ``first`` may end with: it begins and ends
    with a word (or begins with a plus or a bracket), holds no line end, and has a
    digit or an at sign. Segments that cannot be entities are never scored."""
    head = zone[atoms[first][0]]
    if not (head.isascii() and head.isalnum() or head in "+("):
        return []
    out, digits, sign = [], 0, False
    for last in range(first, min(first + longest, len(atoms))):
        s, e = atoms[last]
        text = zone[s:e]
        if text == "\n" or (text.isspace() and zone[s - 1 : s].isspace()):
            break
        digits += len(digits_of(text))
        sign = sign or text == "@" or text in ("at", "AT")
        if text[0].isascii() and text[0].isalnum() and (digits >= 7 or sign and last > first + 1):
            out.append(last)
    return out


class Field:
    def __init__(self, weights: dict[str, float], options: Options):
        self.weights, self.options = weights, options

    def candidates(self, zone: str) -> tuple[list[tuple[int, int]], dict[int, list]]:
        """Atoms, and for each first atom its candidates (last, features)."""
        atoms = [m.span() for m in _ATOM.finditer(zone)]
        found = {}
        for first in range(len(atoms)):
            if first and zone[atoms[first][0] - 1].isalnum():
                continue
            ends = entity_ends(atoms, zone, first, self.options.longest)
            if ends:
                found[first] = [
                    (last, span_features(zone, atoms[first][0], atoms[last][1])) for last in ends
                ]
        return atoms, found

    def score(self, kind: int, features: list[str]) -> float:
        get = self.weights.get
        return get(f"{kind}|bias", 0.0) + sum(get(f"{kind}|{f}", 0.0) for f in features)

    def decode(self, zone: str) -> list[tuple[int, int, int]]:
        """The best segmentation's entities (start, kind, end). A segment outside
        entities is one atom and scores nothing."""
        atoms, found = self.candidates(zone)
        if not found:
            return []
        best = [0.0] * (len(atoms) + 1)
        choice: list[tuple[int, int] | None] = [None] * (len(atoms) + 1)
        for first in range(len(atoms) - 1, -1, -1):
            best[first] = best[first + 1]
            for last, features in found.get(first, ()):
                for kind in range(len(KINDS)):
                    total = self.score(kind, features) - self.options.margin + best[last + 1]
                    if total > best[first]:
                        best[first], choice[first] = total, (last, kind)
        out, at = [], 0
        while at < len(atoms):
            if choice[at] is None:
                at += 1
                continue
            last, kind = choice[at]
            out.append((atoms[at][0], kind, atoms[last][1]))
            at = last + 1
        return out

    def learn(self, zone: str, gold: list[tuple[int, int, int]], rate: float) -> None:
        """One step along the gradient of the likelihood of ``gold``."""
        atoms, found = self.candidates(zone)
        if not found:
            return
        size = len(atoms)
        backward = [0.0] * (size + 1)
        scored = {
            first: [(last, f, [self.score(k, f) for k in range(len(KINDS))]) for last, f in ends]
            for first, ends in found.items()
        }
        for first in range(size - 1, -1, -1):
            terms = [backward[first + 1]]
            for last, _, scores in scored.get(first, ()):
                terms += [s + backward[last + 1] for s in scores]
            backward[first] = _log_sum(terms)
        forward = [-math.inf] * (size + 1)
        forward[0] = 0.0
        change: dict[str, float] = defaultdict(float)
        wanted = {(s, e): k for s, k, e in gold}
        for first in range(size):
            forward[first + 1] = _log_sum([forward[first + 1], forward[first]])
            for last, features, scores in scored.get(first, ()):
                kind_wanted = wanted.get((atoms[first][0], atoms[last][1]))
                for kind, s in enumerate(scores):
                    here = math.exp(min(0.0, forward[first] + s + backward[last + 1] - backward[0]))
                    gap = (kind == kind_wanted) - here
                    if abs(gap) > 1e-4:
                        change[f"{kind}|bias"] += gap
                        for f in features:
                            change[f"{kind}|{f}"] += gap
                forward[last + 1] = _log_sum([forward[last + 1], *(forward[first] + s for s in scores)])
        for name, value in change.items():
            self.weights[name] = self.weights.get(name, 0.0) * (1 - 1e-4) + rate * value


def _log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top if top == -math.inf else top + math.log(sum(math.exp(t - top) for t in terms))


def zones_of(text: str) -> Iterator[tuple[int, str]]:
    """Stretches around triggers; those that meet are one."""
    start = end = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            end = max(end, _ONWARD.match(text, m.start()).end())
            continue
        if end > start:
            yield start, text[start:end]
        low = max(end, m.start() - _BACK)
        back = text[low : m.start()]
        cut = max(back.rfind("\n"), back.rfind(" ", 0, max(back.rfind(" "), 0)))
        start, end = low + cut + 1, _ONWARD.match(text, m.start()).end()
    if end > start:
        yield start, text[start:end]


def rewritten(span: str, kind: int, turn: int) -> str:
    """A span in a form that the base expressions miss."""
    if kind == 0:
        return span.replace("@", (" (at) ", "(at)", " [at] ")[turn % 3])
    if kind == 3:
        bare = re.sub(r"^\+[0-9]{1,2}[ .-]?", "", span)
        return bare if turn % 2 else bare.replace("(", "").replace(")", "").replace(" ", "-")
    return span


def examples(text: str, turn: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Zones of a text with their base spans, as they are and rewritten."""
    spans = base_spans(text)
    for start, zone in zones_of(text):
        own = [(s - start, k, e - start) for s, k, e in spans if start <= s and e <= start + len(zone)]
        own = [x for n, x in enumerate(own) if all(x[0] >= y[2] for y in own[:n])]
        yield zone, own
        if own:
            out, gold, at = "", [], 0
            for s, k, e in own:
                new = rewritten(zone[s:e], k, turn)
                out += zone[at:s]
                gold.append((len(out), k, len(out) + len(new)))
                out, at = out + new, e
            yield out + zone[at:], gold


def least(orders: DataFrame, rows: int, wanted: int) -> list[int]:
    """The ``wanted`` least different hashes of so many rows. Those below a bound
    that about four times as many stay under are sorted, however many there are in
    all; where repeated rows leave too few, the bound rises."""
    part = 4 * wanted / max(rows, 1)
    while True:
        low = orders if part >= 1 else orders.where(F.col("order") < int(part * 2**64) - 2**63)
        found = [r[0] for r in low.distinct().orderBy("order").limit(wanted).collect()]
        if part >= 1 or len(found) == wanted:
            return found
        part *= 4


def fit(df: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text") -> Field:
    """From at most ``max_rows`` different texts that hold an at sign or a long
    number, those of the least hashes of id and text, so the fit is the same
    however the rows are dealt out. Only hashes are ordered; texts meet the chosen
    ones where they are read."""
    o = options
    stage = kit.Stage(df.sparkSession)
    rows = (
        df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
        .where(F.col("text").rlike("[0-9]{3}|@"))
        .select(F.xxhash64("key", "text").alias("order"), "text")
    )
    orders = stage.table(rows.select("order"), "orders")
    chosen = least(orders, orders.count(), o.max_rows)
    stage.drop(orders)
    chosen = df.sparkSession.createDataFrame([(x,) for x in chosen], "order bigint")
    picked = rows.join(F.broadcast(chosen), "order").groupBy("order").agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                {"kind": gold[0][1] if gold else -1, "zone": z, "gold": [list(g) for g in gold]}
                for t in kit.texts_of(batch)
                for z, gold in examples(t, zlib.crc32(t.encode()))
            ]
            gold = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pylist(
                out, pa.schema([("kind", pa.int32()), ("zone", pa.string()), ("gold", gold)])
            )

    found = picked.select("text").mapInArrow(cut, "kind int, zone string, gold array<array<int>>")
    order = (F.xxhash64("zone"), F.col("zone"), F.col("gold"))
    of_kind = F.row_number().over(Window.partitionBy("kind").orderBy(*order))
    half = o.max_zones // 2
    share = F.when(F.col("kind") < 0, half).otherwise(half // len(KINDS))
    shown = [
        (r["zone"], [tuple(g) for g in r["gold"]])
        for r in found.withColumn("place", of_kind).where(F.col("place") <= share).orderBy(*order).collect()
    ]
    field = Field({}, o)
    for epoch in range(o.epochs):
        for zone, gold in shown:
            field.learn(zone, gold, o.rate / (1 + epoch))
    return field


def find_personal(
    df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, spans, base): base spans and the field's, sorted by start, then kind,
    and base spans alone. A span of the field that overlaps a base span is dropped.

    A null or empty text has no spans; null ids and repeated rows are searched
    like any other; other columns are left out. Texts are searched whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)

    def make():
        own = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            base = [base_spans(t) for t in kit.texts_of(batch)]
            found = [all_spans(t, own, b) for t, b in zip(kit.texts_of(batch), base)]
            spans, base = (
                pa.array([[{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in x] for x in rows], kind)
                for rows in (found, base)
            )
            return kit.columns(key=batch.column("key"), spans=spans, base=base)

        return work

    key = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return kit.map_texts(narrow, make, f"key {key}, spans {SPANS}, base {SPANS}").withColumnRenamed("key", id_col)


def all_spans(
    text: str, field: Field, base: list[tuple[int, int, int]]
) -> list[tuple[int, int, int]]:
    taken = sorted((s, e) for s, _, e in base)
    out = list(base)
    at = 0
    for start, zone in zones_of(text):
        for s, k, e in field.decode(zone):
            s, e = s + start, e + start
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            if all(e <= b or s >= f for b, f in taken[at : at + 4]):
                out.append((s, k, e))
    return sorted(out)
