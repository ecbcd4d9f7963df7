"""Secret scans: known patterns, and a battery of randomness tests over long tokens with false-discovery control."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import per_batch, stored, texts_of

KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
any_case = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
#: Patterns of the base rules (fixed values).  Spelled-out cases: ignoring case would let other alphabets in.
ASSIGN = re.compile(rf"({'|'.join(map(any_case, ('password', 'passwd', 'secret', 'token')))}|{any_case('api')}_?{any_case('key')})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: '=' pads the end of a token; elsewhere it stands between two of them.
PADDED = re.compile(r"[A-Za-z0-9+/_-]+(?:=+\Z)?")

HEX_DIGITS = "0123456789abcdef"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets from the narrowest on; a token has the first that holds all its characters.  The last holds every sign of a token.
ENCODINGS = (("digits", DIGITS), ("hex", HEX_DIGITS), ("HEX", HEX_DIGITS.upper()), ("upper", UPPER), ("lower", LOWER), ("base32", UPPER + "234567"),
             ("base36", DIGITS + LOWER), ("BASE36", DIGITS + UPPER), ("letters", UPPER + LOWER), ("base62", UPPER + LOWER + DIGITS),
             ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64url", UPPER + LOWER + DIGITS + "-_"), ("any", UPPER + LOWER + DIGITS + "+/-_"))
#: Frequent letter pairs of European languages (fixed values): more than half of the pairs of a word, a ninth of those of drawn letters.
PAIRS = frozenset(("th he in er an re nd on en at ou ed ha to or it is hi es ng st ar te se me al ti nt ve le de ri ro ic ne ea ra ce li ch ll be ma si om ur la el as di "
                   "ei un ie sc ge ss us qu au ue ai os ad co ca io ta ia no na da do").split())


@dataclass(frozen=True)
class Battery:
    """q: rate of random tokens that the tests may lose among those they discard, in each class of length.
    floor: a token with a lower p is never called random, whatever the class allows."""

    q: float = 0.05
    floor: float = 0.02


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three base rules, as (start, end, kind)."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def encoding_of(token: str) -> tuple[str, str] | None:
    """Name and alphabet of the narrowest encoding; None only for a token without a sign, or with one of no alphabet."""
    used = set(token.rstrip("="))
    return None if not used else next(((n, a) for n, a in ENCODINGS if used <= set(a)), None)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def binomial_tail(k: int, n: int, p: float) -> float:
    """Probability of k or more of n."""
    if n > 500:
        return normal_tail((k - 0.5 - n * p) / math.sqrt(n * p * (1 - p)))
    return min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))


def chi_squared(counts: np.ndarray, expected: np.ndarray) -> float:
    """Upper tail of Pearson's statistic (Wilson and Hilferty's approximation)."""
    df = len(counts) - 1
    x = float(((counts - expected) ** 2 / expected).sum())
    spread = 2 / (9 * df)
    return normal_tail(((x / df) ** (1 / 3) - 1 + spread) / math.sqrt(spread))


def p_value(token: str, alphabet: str) -> float:
    """How well the token agrees with uniform draws from the alphabet: up to five tests, combined by Bonferroni."""
    letters = token.rstrip("=")
    place = {c: i for i, c in enumerate(alphabet)}
    v = np.array([place[c] for c in letters], float)
    n, size = len(v), len(alphabet)
    # Uniformity over cells of neighbouring letters, as many as leave three draws to a cell.
    cells = max(2, min(size, n // 3))
    edges = np.linspace(0, size, cells + 1)
    expected = n * np.histogram(np.arange(size), edges)[0] / size
    tests = [chi_squared(np.histogram(v, edges)[0], expected)]
    if size > 36:
        # Words keep to one case; draws mix upper case, lower case, digits and signs.
        parts = [part for part in (UPPER, LOWER, DIGITS) if part[0] in place]
        classes = [sum(c in part for c in letters) for part in parts]
        shares = [sum(c in part for c in alphabet) / size for part in parts]
        tests.append(chi_squared(np.array(classes), n * np.array(shares)))
    if alphabet in (UPPER, LOWER, UPPER + LOWER):
        # Tokens of letters only may be words, which are made of few pairs; draws take all pairs alike.
        low = letters.lower()
        tests.append(binomial_tail(sum(low[i : i + 2] in PAIRS for i in range(n - 1)), n - 1, len(PAIRS) / 26**2))
    # Runs above and below the middle of the alphabet.
    high = v >= size / 2
    a, b = int(high.sum()), int((~high).sum())
    if a and b:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 2 * a * b / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        tests.append(2 * normal_tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 0.0)
    else:
        tests.append(2 * 0.5**n)
    # Serial correlation at lag one.
    c = v - v.mean()
    if (total := float((c * c).sum())) > 0:
        tests.append(2 * normal_tail(abs(float((c[1:] * c[:-1]).sum()) / total + 1 / n) * math.sqrt(n)))
    else:
        tests.append(0.0)
    return min(1.0, len(tests) * min(tests))


def candidates(text: str, base: Iterable[tuple[int, int, str]]) -> list[list[tuple[int, int, str, int, float]]]:
    """Long tokens outside the base spans: start, end, encoding, class of length, p.

    An '=' inside a token ends it, as in NAME=value.  A token with '/' may be a key or a path that holds one: it is
    followed, in its own list, by its long parts between the '/', which count if the whole doesn't.
    """
    out, taken = [], [(s, e) for s, e, _ in base]

    def tested(start: int, end: int) -> list[tuple[int, int, str, int, float]]:
        if end - start < 20 or any(s < end and start < e for s, e in taken) or not (kind := encoding_of(text[start:end])):
            return []
        return [(start, end, kind[0], int(2 * math.log2(end - start)), p_value(text[start:end], kind[1]))]

    for m in TOKEN.finditer(text):
        for t in PADDED.finditer(m[0]):
            at = m.start() + t.start()
            whole = tested(at, at + len(t[0]))
            parts = [x for p in re.finditer("[^/]+", t[0]) for x in tested(at + p.start(), at + p.end())] if "/" in t[0] else []
            if parts and whole and whole[0][2] == "any":
                whole = []  # no encoding has signs of both kinds: a path, whose parts say more
            out += [whole + parts] if whole else [[x] for x in parts]
    return out


def limits(table: Iterable[tuple[str, int, int, int]], battery: Battery) -> dict[tuple[str, int], float]:
    """For each encoding and length class the p from which a token counts as random.

    Benjamini and Hochberg over the histogram of p (cells of a tenth of a decade): tokens below the limit are discarded
    as structured, with at most a share q of random ones among them.  Short tokens have weak tests, so each length
    class gets its own limit.
    """
    classes: dict[tuple[str, int], dict[int, int]] = {}
    for kind, length, cell, n in table:
        classes.setdefault((kind, length), {})[cell] = n
    out = {}
    for name, cells in classes.items():
        total, seen, limit = sum(cells.values()), 0, 0.0
        for cell in sorted(cells, reverse=True):
            seen += cells[cell]
            upper = 10 ** (-cell / 10)
            if upper <= battery.q * seen / total:
                limit = upper
        out[name] = max(limit, battery.floor)
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
TESTED = T.ArrayType(T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("encoding", T.StringType()),
    T.StructField("length", T.LongType()), T.StructField("p", T.DoubleType())])))


def scan(df: DataFrame, battery: Battery = Battery(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of every text: key, base (array of start, end, kind) and found (base and random spans, in order).

    Places are code points, ends exclusive.  The limits come from the tests of all tokens of all texts: the spans, a
    small part of the texts, are written once, counted by class and then judged.  One row per input row, repeated rows
    too; a null or empty text has no spans.  Only key and text are read.
    """
    spark = df.sparkSession
    schema = T.StructType([df.schema[key], T.StructField("base", SPAN), T.StructField("tested", TESTED)])
    as_pa = lambda kind, names: pa.list_(pa.struct([(n, pa.float64() if n == "p" else pa.string() if n in ("kind", "encoding") else pa.int64()) for n in names]))
    base_names, tested_names = ("start", "end", "kind"), ("start", "end", "encoding", "length", "p")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bases, tests = [], []
        for t in texts_of(batch.column(1)):
            b = base_spans(t)
            bases.append([dict(zip(base_names, s, strict=True)) for s in b])
            tests.append([[dict(zip(tested_names, s, strict=True)) for s in ways] for ways in candidates(t, b)])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(bases, as_pa("base", base_names)), pa.array(tests, pa.list_(as_pa("tested", tested_names)))], names=[key, "base", "tested"])

    spans = stored(per_batch(df.select(F.col(key), F.col(text).cast("string")), run, schema))
    cell = F.least(F.lit(300), F.floor(-10 * F.log10(F.greatest("t.p", F.lit(1e-30))))).cast("int")
    # A few encodings, length classes and cells: bounded, whatever the data.
    table = spans.select(F.explode(F.flatten("tested")).alias("t")).groupBy("t.encoding", "t.length", cell.alias("cell")).count()
    judged = limits([(r["encoding"], r["length"], r["cell"], r["count"]) for r in table.collect()], battery)
    least = F.create_map(*[F.lit(x) for (kind, length), p in judged.items() for x in (f"{kind}:{length}", p)]) if judged else None
    passes = (lambda s: s["p"] >= least[F.concat_ws(":", s["encoding"], s["length"])]) if judged else lambda s: F.lit(False)
    random = F.flatten(F.transform("tested", lambda ways: F.when(passes(ways[0]), F.slice(ways, 1, 1)).otherwise(F.filter(ways, passes))))
    added = F.transform(random, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("random").alias("kind")))
    place = F.array(*[F.lit(k) for k in KINDS])
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind"))
    found = F.transform(F.array_sort(F.transform(F.concat("base", added), order)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return spans.select(key, "base", found.alias("found"))


def digest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind and the spans as text, from `scan`."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(key, n("assign"), n("access"), n("hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"))
