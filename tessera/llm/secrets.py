"""Secret scans: patterns, and Markov models of random strings against ordinary identifiers.

Two models of character pairs are trained from labelled samples, one on random strings
and one on ordinary identifiers.  A run of a token's characters is a secret where it has the
largest sum of log-likelihood ratios of the two, and the mean a character passes a threshold.  The counts that a model needs are one row for
each pair of characters and class, so what reaches the driver is bounded by the alphabet.

Scanning is one pass over whole texts, without a shuffle.  Places are code points, ends
exclusive.

Defined results: a null text counts as empty and has no spans; the digest of no spans is that
of an empty string.  Repeated rows repeat results; null ids stay null; only the id and text
columns are read.  Tokens of any length are searched whole; of a token that base
spans meet, the parts outside them are searched.  Tokens of letters of one case, UUIDs, and runs of fewer
than ``DIFFERENT`` characters are no secrets.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

# Base kinds, in order, with their patterns and least lengths.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
#: Cheap tests that a text with a match of the pattern passes.
_ASSIGN_HINT = re.compile(r"[:=]")

#: Tokens that the models score: of the alphabet, this long, and not letters of one case alone.
LEAST = 16
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Pieces that a token is made of; a secret begins and ends where one does.
_PIECE = re.compile(r"[A-Za-z0-9+]+|[/_=-]")
_PLAIN = re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")
#: Identifiers that are random and no secrets; and the least number of different characters of a secret.
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIFFERENT = 7
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Log-likelihood ratio a character from which a token counts as random.
THRESHOLD = 0.5
#: Fall of the summed ratio after which a run has ended.
DROP = 10.0

# Parts of ordinary identifiers for the labelled sample.
PARTS = """get set is has add remove update delete create make build load save read write open close start stop init run test check find
search sort filter map reduce count sum min max mean index key value item list array table row column field name type size length width height
user account group role order price total date time day month year file path dir url host port request response header body client server
session config option default error message log level debug info warning state status result data buffer stream input output text string number
image color pixel point line shape node edge tree graph parent child root next previous first last current new old temp local global public
private static final abstract class interface method function module package import export version build release license""".split()


def labelled_samples(n: int = 3000, seed: int = 11) -> list[tuple[str, int]]:
    """Random strings (1) over common alphabets and ordinary identifiers (0) in common styles, made by a seeded rule."""
    rng, out = random.Random(seed), []
    alphabets = (ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef", "0123456789ABCDEF")
    for i in range(n):
        out.append(("".join(rng.choice(alphabets[i % len(alphabets)]) for _ in range(rng.randint(16, 48))), 1))
        words = [rng.choice(PARTS) for _ in range(rng.randint(2, 6))]
        style = i % 5
        text = ("_".join(words), "-".join(words), words[0] + "".join(w.title() for w in words[1:]), "_".join(words).upper(), "/".join(words))[style]
        out.append((text + (str(rng.randint(0, 2030)) if i % 3 == 0 else ""), 0))
    return out


def pair_counts(samples: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Counts of neighbouring characters by class: ``label``, ``pair``, ``n``."""
    padded = F.concat(F.lit("^"), F.col(text))
    pairs = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    return samples.filter(F.length(text) > 0).select(F.col(label).cast("int").alias("label"), F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n"))


class MarkovRatio:
    """Log-likelihood ratios of character pairs, random over ordinary, with add-one smoothing."""

    def __init__(self, counts: list[tuple[int, str, int]]):
        known, seen, lead = set(ALPHABET), ({}, {}), ({}, {})
        for label, pair, n in counts:
            if pair[1] in known and (pair[0] in known or pair[0] == "^"):
                seen[label][pair] = seen[label].get(pair, 0) + n
                lead[label][pair[0]] = lead[label].get(pair[0], 0) + n
        chance = lambda c, a, b: (seen[c].get(a + b, 0) + 1) / (lead[c].get(a, 0) + len(ALPHABET))
        self.ratio = {a + b: math.log(chance(1, a, b) / chance(0, a, b)) for a in "^" + ALPHABET for b in ALPHABET}

    def score(self, token: str) -> float:
        """Mean ratio a character."""
        at = "^" + token
        return sum(self.ratio[at[i : i + 2]] for i in range(len(token))) / max(1, len(token))

    def runs(self, token: str) -> list[tuple[int, int]]:
        """Runs of characters with the largest sums of ratios, in order; linear time."""
        at, out = "^" + token, []
        start, total, best, end = 0, 0.0, 0.0, 0
        for i in range(len(token)):
            total += self.ratio[at[i : i + 2]]
            if total > best:
                best, end = total, i + 1
            # no suffix of what is left behind here has a positive sum
            elif total <= 0 or best - total >= DROP:
                if end > start:
                    out.append((start, end))
                start, total, best, end = i + 1, 0.0, 0.0, i + 1
        return [*out, (start, end)] if end > start else out

    def secrets(self, token: str, threshold: float) -> list[tuple[int, int]]:
        """Runs widened or narrowed to whole pieces, by which side has more of the piece, that pass the threshold."""
        pieces, out, at = [m.span() for m in _PIECE.finditer(token)], [], 0
        inside = lambda k: 2 * (min(pieces[k][1], e) - max(pieces[k][0], s)) >= pieces[k][1] - pieces[k][0]
        for s, e in self.runs(token):
            # runs and pieces are both in order: those before this run are left behind
            while at < len(pieces) and pieces[at][1] <= s:
                at += 1
            if e - s < LEAST // 2:
                continue
            first, last = at, at
            while last < len(pieces) and pieces[last][0] < e:
                last += 1
            while first < last and not inside(first):
                first += 1
            while first < last and not inside(last - 1):
                last -= 1
            # a separator at an end is not part of a secret, but for padding
            while first < last and token[pieces[first][0]] in "/_=-":
                first += 1
            while first < last and token[pieces[last - 1][0]] in "/_-":
                last -= 1
            if first == last:
                continue
            a, b = pieces[first][0], pieces[last - 1][1]
            part = token[a:b]
            if b - a >= LEAST and len(set(part)) >= DIFFERENT and not _PLAIN.fullmatch(part) and self.score(part) >= threshold:
                out.append((a, b))
        return out


def train(spark: SparkSession, samples: DataFrame | None = None) -> MarkovRatio:
    """Models from a table of ``text`` and ``label`` (1 random, 0 ordinary), or from the made samples."""
    if samples is None:
        samples = spark.createDataFrame(labelled_samples(), "text string, label int")
    return MarkovRatio([tuple(r) for r in pair_counts(samples).collect()])  # at most two classes times the pairs of the alphabet


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the patterns as start, kind's place and end, in order."""
    out = []
    if _ASSIGN_HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def markov_spans(text: str, model: MarkovRatio, base: list[tuple[int, int, int]], threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """Spans of random runs in tokens, outside the base spans."""
    out, taken, before = [], [], 0
    for s, _, e in base:
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    for m in TOKEN.finditer(text):
        if _PLAIN.fullmatch(m[0]) or _UUID.fullmatch(m[0]):
            continue
        # tokens and taken spans are both in order
        while before < len(taken) and taken[before][1] <= m.start():
            before += 1
        at, parts, k = m.start(), [], before
        while k < len(taken) and taken[k][0] < m.end():
            parts.append((at, taken[k][0]))
            at, k = taken[k][1], k + 1
        for a, b in [*parts, (at, m.end())]:
            if b - a >= LEAST:
                out += [(a + s, 3, a + e) for s, e in model.secrets(text[a:b], threshold)]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: MarkovRatio, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: id, counts by base kind, ``base_sha256``, ``n_markov`` and ``spans``."""
    import pyarrow as pa

    kind = docs.schema[id_column].dataType.simpleString()
    frame = docs.select(F.col(id_column).alias("_id"), text_of(docs, text_column).alias("_text"))

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py()
                base = base_spans(text)
                more = markov_spans(text, model, base, threshold)
                by = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*by, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more))))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]], [id_column, "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    return frame.mapInArrow(run, f"`{id_column}` {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")
