"""Personal data: fixed patterns, and boosted trees over the spans of broader generators.

The base spans (email, ip, card, phone by pattern and validity test) always stay. Generators with high recall propose
further, overlapping spans: spelled-out addresses, bracketed or spaced numbers, cards with other separators, phone numbers
without a plus. Boosted trees judge a proposal by its form and its surroundings; per kind, the threshold is the least
whose precision on held-back candidates reaches PRECISION. The trees learn from candidates of all documents (marked by the
base patterns and by what cannot be valid) and from written-out examples of the forms that these patterns do not know, which
together weigh as much. Candidates are counted by form; every fourth text, by a hash of it, is held back for the thresholds.

Defined cases: a null text is the empty text and has no spans; offsets are code points, ends exclusive; of overlapping
added spans the likelier stays, and none overlaps a base span; rows with equal ids each give their own row; an empty table
gives none.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import common
from wayline.llm.boosting import Boosted
from wayline.operators.windows import running_total

EXAMPLES = 3_000  # written-out candidates
CUTS = np.array([*range(21), 22, 24, 28, 32, 40, 48, 64, 96, 128, 256], float)  # of all features, which are small counts
TASK_FORMS = 100_000  # forms that a task, or the driver, adds up at a time
PRECISION = 0.99
KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The base patterns. The look-behind only spares work: a match always starts a run of digits.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_AT = re.compile(r"[\[({<]\s?at\s?[\])}>]", re.I)  # part of every match of the first generator

_GENERATORS = (
    ("email", re.compile(r"[\w.%+-]{1,64}\s?[\[({<]\s?at\s?[\])}>]\s?[\w-]{1,63}(?:\s?(?:[\[({<]\s?dot\s?[\])}>]|\.)\s?[\w-]{2,63}){1,4}", re.I)),
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64} at [\w-]{1,63}(?: dot [\w-]{2,63}){1,4}", re.I)),
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+'-]{1,64}@[\w.-]{2,255}")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?[\[(]?\.[\])]?\s?[0-9]{1,3}){3}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){4,7}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[./_ -]?[0-9]{3,6}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,4}(?![0-9])")),
)
_CUES = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "amex", "pay", "credit", "master"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "whatsapp"),
}
_AGAINST = ("version", "isbn", "order", "invoice", "page", "section", "build", "release", "date", "no.", "id")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and then kind."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of the generators."""
    low = text.lower()
    digits = bool(_DIGIT.search(text))
    use = [bool(_AT.search(text)), " at " in low, "@" in text, *[digits] * 4]
    found = set()
    for k, (kind, pattern) in enumerate(_GENERATORS):
        if use[k]:
            found |= {(kind, *m.span()) for m in pattern.finditer(text)}
    return sorted(found, key=lambda s: (s[1], s[2], KINDS.index(s[0])))


def refuted(kind: str, s: str) -> bool:
    """Whether a candidate cannot be what it looks like; others beyond the base patterns are left unmarked in training."""
    parts = re.findall("[0-9]+", s)
    digits = "".join(parts)
    if kind == "card":
        return not (14 <= len(digits) <= 19 and luhn(digits))
    if kind == "ip":
        return ":" not in s and (len(parts) != 4 or any(int(p) > 255 for p in parts))
    return kind == "phone" and not 7 <= len(digits) <= 15


def form(text: str, span: Span) -> list[float]:
    """A candidate's features: its kind and form, then what stands around it."""
    kind, a, b = span
    s = text[a:b]
    digits = "".join(c for c in s if "0" <= c <= "9")
    parts = re.findall("[0-9]+", s)
    before, after = text[max(0, a - 24) : a].lower(), text[b : b + 12].lower()
    return [
        KINDS.index(kind), len(s), len(digits), len(parts), max(map(len, parts), default=0), min(map(len, parts), default=0),
        sum(c.isalpha() for c in s), s.count("."), s.count("-"), s.count(" "), s.count("/") + s.count("_"), s.count(":"),
        sum(c in "()[]{}<>" for c in s), s.count("@"), "dot" in s.lower(), " at " in s.lower() or bool(_AT.search(s)),
        s[:1] in "+(", bool(digits) and luhn(digits), max((int(p[:9]) for p in parts), default=0) <= 255, 14 <= len(digits) <= 19,
        9 <= len(digits) <= 12, s[-3:].isalpha(), before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in ("=", ":", '"', "#", "/"),
        any(c in before for c in _CUES[kind]), any(c in before for c in _AGAINST), len(parts) == 4 and all(len(p) <= 3 for p in parts),
    ]


def _examples(n: int) -> list[tuple[str, Span, int]]:
    """(text, candidate, mark) in forms beyond the base patterns, and look-alikes, the same at every call."""
    rng, out = random.Random(10), []
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvz", k=rng.randint(3, 9)))
    num = lambda k: "".join(rng.choices("0123456789", k=k))

    def card(valid: bool, sep: str) -> str:
        while True:
            d = num(16)
            if luhn(d) == valid:
                return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    octets = lambda: [str(rng.randint(1, 255)) for _ in range(4)]
    makers = (
        ("email", 1, lambda: f"{word()} [at] {word()} [dot] {rng.choice(('com', 'org', 'net', 'de'))}"),
        ("email", 1, lambda: f"{word()}{{at}}{word()}{{dot}}{rng.choice(('com', 'org', 'net', 'de'))}"),
        ("email", 1, lambda: f"{word()}<at>{word()}.{rng.choice(('com', 'org', 'net', 'de'))}"),
        ("email", 1, lambda: f"{word()}.{word()} at {word()} dot {rng.choice(('com', 'org', 'fr'))}"),
        ("email", 1, lambda: f"{word()}{num(2)}@{word()}.{rng.choice(('com', 'org', 'es'))}"),
        ("email", 0, lambda: f"{word()} at {word()} dot {word()} dot {word()}"),
        ("email", 0, lambda: f"{word()}@{word()}"),
        ("ip", 1, lambda: "[.]".join(octets())),
        ("ip", 1, lambda: ":".join(f"{rng.randint(1, 65535):x}" for _ in range(8))),
        ("ip", 0, lambda: f"{rng.randint(0, 9)}. {rng.randint(0, 9)}. {rng.randint(0, 20)}. {rng.randint(0, 99)}"),
        ("ip", 0, lambda: f"{rng.randint(256, 999)}.{rng.randint(0, 999)}.{rng.randint(256, 999)}.{rng.randint(0, 999)}"),
        ("ip", 0, lambda: f"{num(2)}:{num(2)}:{num(2)}:{num(2)}:{num(2)}"),
        ("card", 1, lambda: card(True, rng.choice((".", "/", "_")))),
        ("card", 0, lambda: card(False, rng.choice((".", "/", "_", "", " ", "-")))),
        ("card", 0, lambda: num(rng.choice((10, 11, 12, 13)))),
        ("phone", 1, lambda: f"({num(3)}) {num(3)}-{num(4)}"),
        ("phone", 1, lambda: f"{num(3)}-{num(3)}-{num(4)}"),
        ("phone", 0, lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"),
        ("phone", 0, lambda: f"{num(2)}/{num(2)}/{num(4)}"),
        ("phone", 0, lambda: f"{num(3)} {num(3)}"),
        ("phone", 0, lambda: f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}".replace("-" + num(1), "-12")),
    )
    for i in range(n):
        kind, mark, make = makers[i % len(makers)]
        cue = rng.choice(_CUES[kind]) if mark and rng.random() < 0.7 else rng.choice(_AGAINST) if rng.random() < 0.5 else word()
        head = f"{word()} {cue} "
        body = make()
        out.append((f"{head}{body} {word()}", (kind, len(head), len(head) + len(body)), mark))
    return out


class Cover:
    """What spans cover, as disjoint ranges in order, so that a further span is tested by bisection."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a

    def add(self, a: int, b: int) -> None:
        """Add a range that meets none."""
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


@dataclass
class PiiModel:
    trees: Boosted
    thresholds: dict[str, float]  # log odds per kind

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans, each by start and then kind."""
        base = base_spans(text)
        covered = Cover(base)
        free = [c for c in candidates(text) if not covered.meets(*c[1:])]
        if not free:
            return base, base
        score = self.trees.score(np.array([form(text, c) for c in free], float))
        added: list[Span] = []
        for k in sorted(range(len(free)), key=lambda k: (-score[k], free[k])):
            kind, a, b = free[k]
            if score[k] >= self.thresholds[kind] and not covered.meets(a, b):
                covered.add(a, b)
                added.append(free[k])
        return base, sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0])))


def _bins(forms: list[list[float]]) -> np.ndarray:
    return np.searchsorted(CUTS, np.array(forms, float)).astype(np.uint8)


def forms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``x`` (the features' bins), ``y`` (the mark), ``held`` and ``n``: marked candidates of all documents by form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[bytes, int, bool]] = Counter()
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                exact, covered = set(base), Cover(base)
                marked = [c for c in candidates(text) if c in exact or not covered.meets(*c[1:]) and refuted(c[0], text[c[1] : c[2]])]
                if marked:
                    held = zlib.crc32(text.encode("utf-8", "replace")) % 4 == 3
                    found.update((x.tobytes(), int(c in exact), held) for x, c in zip(_bins([form(text, c) for c in marked]), marked))
            columns = list(zip(*found)) or [(), (), ()]
            types = (pa.binary(), pa.int32(), pa.bool_())
            yield pa.record_batch([*(pa.array(c, t) for c, t in zip(columns, types)), pa.array(list(found.values()), pa.int64())], ["x", "y", "held", "n"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "x binary, y int, held boolean, n long").groupBy("x", "y", "held").agg(F.sum("n").alias("n"))


def _arrays(t: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, marks and counts."""
    x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.uint8).reshape(t.num_rows, -1 if t.num_rows else 1)
    return x, t.column("y").to_numpy(), t.column("n").to_numpy()


def _grown(table: DataFrame, rows: int, task_forms: int) -> Boosted:
    """Trees over a table of forms: few are added up here, more in the tasks, which gives the same sums."""
    bins = len(CUTS) + 1
    total, marked = table.agg(F.sum("n"), F.sum(F.col("y") * F.col("n"))).head()
    if rows <= task_forms:
        x, y, n = _arrays(table.toArrow())

        def sums(model: Boosted, features: np.ndarray, limits: np.ndarray, level: int) -> np.ndarray:
            return model.sums(x, y, n, features, limits, level, bins)

    else:
        dealt = common.written(table.repartition(-(-rows // task_forms)), "forms")

        def sums(model: Boosted, features: np.ndarray, limits: np.ndarray, level: int) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                parts = [model.sums(*_arrays(b), features, limits, level, bins) for b in batches if b.num_rows]
                yield pa.record_batch([pa.array([sum(parts).tobytes()] if parts else [], pa.binary())], ["h"])

            parts = [np.frombuffer(r.h) for r in dealt.mapInArrow(run, "h binary").collect()]
            return np.sum(parts, axis=0).reshape(2, 2**level, -1, bins)

    features = len(table.select("x").head().x)
    return Boosted.grow(sums, features, bins, total, marked)


def fit(docs: DataFrame, text_col: str = "text", task_forms: int = TASK_FORMS) -> PiiModel:
    """Trees and thresholds from the marked candidates of all documents and the written-out examples."""
    spark = docs.sparkSession
    found = common.written(forms(docs, text_col), "forms")
    count, total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    made = _examples(EXAMPLES)
    weight = max(1, -(-total // len(made)))
    examples = Counter((x.tobytes(), m, i % 4 == 3) for i, (x, m) in enumerate(zip(_bins([form(t, c) for t, c, _ in made]), (m for _, _, m in made))))
    examples = spark.createDataFrame([(bytearray(x), m, held, n * weight) for (x, m, held), n in examples.items()], found.schema)
    every = found.unionByName(examples)
    trees = _grown(every.filter("not held").drop("held"), count + EXAMPLES, task_forms)
    limits = thresholds(every.filter("held").drop("held"), trees)
    common.discard(found)
    return PiiModel(trees.named([CUTS] * len(form("", ("email", 0, 0)))), limits)


def thresholds(held: DataFrame, trees: Boosted) -> dict[str, float]:
    """Per kind the least score from which on the precision of these forms is PRECISION or more, 0 at least; infinite if none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, n = _arrays(b)
            yield pa.record_batch([pa.array(x[:, 0].astype(np.int32)), pa.array(trees.score(x)), pa.array(n * (y == 1)), pa.array(n)], ["kind", "score", "good", "n"])

    scored = held.mapInArrow(run, "kind int, score double, good long, n long").groupBy("kind", "score").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    scored = common.written(scored, "scores")
    order = [F.col("kind"), F.desc("score")]
    upto = running_total(running_total(scored, order, "good", "good_to"), order, "n", "n_to")
    before = {k: (0, 0) for k in range(len(KINDS))}
    for r in scored.groupBy("kind").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect():
        for k in range(r.kind + 1, len(KINDS)):
            before[k] = (before[k][0] + r.good, before[k][1] + r.n)
    of = lambda i: F.element_at(F.array(*(F.lit(before[k][i]) for k in range(len(KINDS)))), F.col("kind") + 1)
    precise = upto.filter(F.col("good_to") - of(0) >= PRECISION * (F.col("n_to") - of(1)))
    least = dict(precise.groupBy("kind").agg(F.min("score")).collect())
    return {kind: max(least[k], 0.0) if k in least else float("inf") for k, kind in enumerate(KINDS)}


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's id, ``n_<kind>`` of base spans, and ``base`` and ``spans`` as kind:start:end lists."""
    rows = common.id_and_text(docs, id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [model.spans(t) for t in batch.column(1).to_pylist()]
                n = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                texts = [pa.array([joined(f[i]) for f in found], pa.string()) for i in (0, 1)]
                yield pa.record_batch([batch.column(0), *n, *texts], [id_col, *counts, "base", "spans"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, {', '.join(c + ' long' for c in counts)}, base string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """Each group of overlapping spans becomes the name of its first kind in brackets."""
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, model: PiiModel, text_col: str = "text") -> DataFrame:
    """The documents with their columns, spans replaced in the text; texts without spans, and nulls, stay as they are."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = pa.array([None if t is None else redacted(t, model.spans(t)[1]) for t in batch.column(text_col).to_pylist()], pa.string())
                yield pa.record_batch([texts if c == text_col else batch.column(c) for c in names], names)

    return docs.mapInArrow(run, docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
