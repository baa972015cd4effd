"""Secret scans with a randomness test battery.

Three patterns find assigned values, access keys and long hex runs. Every other long token is then tested: its
encoding is inferred from its symbols, and a chi-squared test of the alphabet, a runs test over character classes and
a lag-one serial correlation say whether it could be a uniform string of that encoding; a token that could not, such
as a path with a key in it, is tested again part by part. The same statistics, and the letters' frequencies, are held
against ordinary words, and a weighted Benjamini-Hochberg step over the tokens of all documents, with weights that grow
with a token's length, bounds the share of ordinary words among the tokens it reports.

The step needs no sorted list of tokens: p-values are counted in narrow classes on a logarithmic scale, a table of
bounded size, and a class counts as its upper edge.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: Fixed patterns of the base kinds. Letters of the names count in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Longest runs of encoding symbols. Access keys and hex runs of their least lengths lie inside such runs.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
KINDS = ("assign", "access", "hex", "random")
#: Encodings by rising alphabet; the first that has all symbols of a token is taken.
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = {
    "decimal": _DIGITS, "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER, "base62": _DIGITS + _UPPER + _LOWER, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_SETS = {k: frozenset(v) for k, v in ENCODINGS.items()}
#: Ordinary words: chance that two of their letters are the same, that a class change follows a letter, and that a place between letters is a digit.
WORD_COLLISION, WORD_SWITCH, WORD_DIGIT = 0.07, 0.12, 0.05
#: Percentages of the letters a to z in running text, about the middle of English, German, French and Spanish.
LETTERS = (8.2, 1.5, 3.2, 4.3, 14.4, 1.4, 1.8, 3.2, 7.2, 0.4, 0.7, 4.4, 2.7, 8.0, 5.9, 2.1, 0.7, 6.8, 7.2, 7.2, 4.1, 1.1, 1.1, 0.4, 0.9, 0.7)
_LOG = {c: math.log(v / sum(LETTERS)) for c, v in zip(_LOWER, LETTERS, strict=True)}
_LOG_MEAN = sum(v / sum(LETTERS) * _LOG[c] for c, v in zip(_LOWER, LETTERS, strict=True))
_LOG_VAR = sum(v / sum(LETTERS) * (_LOG[c] - _LOG_MEAN) ** 2 for c, v in zip(_LOWER, LETTERS, strict=True))
#: Between the parts of a path, a prefixed key or a grouped number.
SEPARATOR = re.compile("[/+_-]+")
GROUPED = re.compile("(?:[0-9a-f]{4,}-)+[0-9a-f]{4,}|(?:[0-9A-F]{4,}-)+[0-9A-F]{4,}")
#: Classes of p-values per power of ten.
_CLASSES = 20


def _normal(z: float) -> float:
    """P(Z <= z)."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _chi_tail(x: float, degrees: int) -> float:
    """P(chi-squared > x) for at most three degrees of freedom."""
    if degrees == 0:
        return 1.0
    if degrees == 2:
        return math.exp(-x / 2)
    return math.erfc(math.sqrt(x / 2)) + (math.sqrt(2 * x / math.pi) * math.exp(-x / 2) if degrees == 3 else 0.0)


def _fisher(ps: list[float]) -> float:
    """Fisher's combination of independent p-values."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    term, total = 1.0, 1.0
    for k in range(1, len(ps)):
        term *= half / k
        total += term
    return min(1.0, math.exp(-half) * total)


def infer_encoding(token: str) -> str | None:
    symbols = set(token)
    return next((name for name, allowed in _SETS.items() if symbols <= allowed), None)


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def battery(token: str) -> tuple[str, float, float] | None:
    """(encoding, p if uniform, p if an ordinary word) of a token without padding; None if no encoding fits."""
    name = infer_encoding(token)
    if name is None:
        return None
    alphabet, n = ENCODINGS[name], len(token)
    k = len(alphabet)
    counts = Counter(token)
    same = sum(c * (c - 1) for c in counts.values()) / 2
    pairs = n * (n - 1) / 2
    # chi-squared of the alphabet; with few symbols per cell its exact mean and variance serve better than its table
    chi = k / n * sum(c * c for c in counts.values()) - n
    p_chi = 2 * min(_normal(z := (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)), 1 - _normal(z))
    shares = Counter(map(_class, alphabet))
    mixed = Counter(map(_class, token))
    grouped = sum((mixed[c] - n * s / k) ** 2 / (n * s / k) for c, s in shares.items())
    p_classes = _chi_tail(grouped, len(shares) - 1)
    switches = sum(_class(a) != _class(b) for a, b in zip(token, token[1:], strict=False))
    rate = 1 - sum((s / k) ** 2 for s in shares.values())
    spread = math.sqrt(max(1e-9, (n - 1) * rate * (1 - rate)))
    p_runs = 2 * min(_normal(z := (switches - (n - 1) * rate) / spread), 1 - _normal(z)) if len(shares) > 1 else 1.0
    index = {c: i for i, c in enumerate(alphabet)}
    x = [index[c] - (k - 1) / 2 for c in token]
    serial = sum(a * b for a, b in zip(x, x[1:], strict=False)) / math.sqrt(n - 1) / ((k * k - 1) / 12)
    p_serial = 2 * min(_normal(serial), 1 - _normal(serial))
    uniform = min(1.0, 4 * min(p_chi, p_classes, p_runs, p_serial))
    # the same statistics if the token were a word: few equal letters and many class changes speak against it
    word_chi = _normal((same + 0.5 - pairs * WORD_COLLISION) / math.sqrt(pairs * WORD_COLLISION * (1 + WORD_COLLISION * n / 2)))
    word_runs = _normal(-(switches - 0.5 - (n - 1) * WORD_SWITCH) / math.sqrt((n - 1) * WORD_SWITCH * (1 - WORD_SWITCH)))
    logs = [_LOG[c] for c in token.lower() if c in _LOG]
    word_letters = _normal((sum(logs) - len(logs) * _LOG_MEAN) / math.sqrt(1.5 * len(logs) * _LOG_VAR)) if logs else 1.0
    inner = token.strip(_DIGITS)
    digits = sum(c in _DIGITS for c in inner)  # digits come in groups, so their number varies more than by chance
    word_digits = _normal(-(digits - 0.5 - WORD_DIGIT * len(inner)) / math.sqrt(4 * WORD_DIGIT * (1 - WORD_DIGIT) * len(inner))) if digits else 1.0
    return name, uniform, _fisher([min(1.0, 2 * min(word_chi, word_letters)), min(1.0, 2 * min(word_runs, word_digits))])


def examine(token: str, least_uniform: float = 1e-2) -> list[tuple[int, int, float, float]]:
    """(start, end, p if uniform, p if an ordinary word) of a token, or of its parts of 20 symbols or more if it is not uniform as a whole."""
    bare = token.rstrip("=")
    whole = battery(bare.replace("-", "") if GROUPED.fullmatch(bare) else bare)
    if whole and whole[1] >= least_uniform:
        return [(0, len(token), *whole[1:])]
    at, parts = 0, []
    for gap in [*SEPARATOR.finditer(bare), None]:
        end = gap.start() if gap else len(bare)
        if 20 <= end - at < len(bare) and (r := battery(bare[at:end])):
            parts.append((at, end, *r[1:]))
        at = gap.end() if gap else end
    return parts or ([(0, len(token), *whole[1:])] if whole else [])


def false_discovery(ps: list[float], lengths: list[int], level: float) -> list[bool]:
    """Weighted Benjamini-Hochberg: p / weight against the ramp; weights follow the lengths and have mean one."""
    m = len(ps)
    mean = sum(lengths) / m if m else 1
    weighted = [p * mean / n for p, n in zip(ps, lengths, strict=True)]
    order = sorted(range(m), key=weighted.__getitem__)
    last = max((r for r, i in enumerate(order, 1) if weighted[i] <= level * r / m), default=0)
    found = set(order[:last])
    return [i in found for i in range(m)]


def scan_text(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, float, float]]]:
    """The base spans (kind, start, end) of a text, and what the battery says of its other tokens (start, end, p if uniform, p if a word)."""
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    for a, b in tokens:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 24]
    tested = []
    for a, b in tokens:
        if not any(s < b and a < e for _, s, e in spans):
            tested += [(a + x, a + y, *p) for x, y, *p in examine(text[a:b])]
    return spans, tested


def _ordered(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(text: str, level: float = 1e-2, least_uniform: float = 1e-2) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span of a text that stands alone, by start, then kind; offsets in code points, end exclusive."""
    spans, tested = scan_text(text)
    passed = false_discovery([t[3] for t in tested], [t[1] - t[0] for t in tested], level)
    return _ordered(spans + [("random", t[0], t[1]) for t, ok in zip(tested, passed, strict=True) if ok and t[2] >= least_uniform])


def _limit(classes: list[tuple[int, int]], tokens: int, symbols: int, level: float) -> float:
    """Largest p / length that the step over all tokens lets through, from (class, tokens) counts; -1 if none."""
    best, seen = -1.0, 0
    for c, n in sorted(classes, reverse=True):  # from the least p-values on
        seen += n
        edge = 10.0 ** (-c / _CLASSES)
        if edge * symbols / tokens <= level * seen / tokens:
            best = edge
    return best


def scan_secrets(docs: DataFrame, level: float = 1e-2, least_uniform: float = 1e-2) -> DataFrame:
    """One row per row of ``docs``: doc_id, secrets array<struct<kind, start, stop>>.

    Whole texts are read, once; a null text counts as empty and has no secrets. ``level`` bounds the share of ordinary
    words among the random tokens reported over all rows. Other columns are not read; repeated rows get the same result;
    an empty table gives no rows.
    """
    base_kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    test_kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("uniform", pa.float64()), ("q", pa.float64())]))

    def run(batches):
        for batch in batches:
            base, tests = [], []
            for text in batch.column(1):
                spans, tested = scan_text(text.as_py() or "")
                base.append([{"kind": k, "start": a, "stop": b} for k, a, b in _ordered(spans)])
                tests.append([{"start": a, "stop": b, "uniform": u, "q": max(w, 1e-300) / (b - a)} for a, b, u, w in tested])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, base_kind), pa.array(tests, test_kind)], names=["doc_id", "base", "tests"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = cut(rows.mapInArrow(run, "doc_id long, base array<struct<kind:string,start:bigint,stop:bigint>>, tests array<struct<start:bigint,stop:bigint,uniform:double,q:double>>"))
    # an edge is at or above every p of its class
    classes = read.select(F.explode("tests").alias("t")).groupBy(F.floor(-F.log10("t.q") * _CLASSES).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("t.stop") - F.col("t.start")).alias("symbols")).collect()
    tokens, symbols = sum(r["n"] for r in classes), sum(r["symbols"] for r in classes)
    limit = _limit([(r["c"], r["n"]) for r in classes], tokens, symbols, level) if tokens else -1.0
    passed = F.filter("tests", lambda t: (t["q"] <= limit) & (t["uniform"] >= least_uniform))
    added = F.transform(passed, lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["stop"].alias("stop")))
    place = lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("i"), x["stop"].alias("stop"), x["kind"].alias("kind"))
    ordered = F.array_sort(F.transform(F.concat("base", added), place))
    return read.select("doc_id", F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))).alias("secrets"))


def digest_secrets(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text, from scan_secrets."""
    named = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, named), ",")
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] != "random")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), of("random").alias("n_random"),
    )

