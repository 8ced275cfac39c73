"""Secrets in whole texts: three pattern kinds, and a likelihood-ratio test of
two character Markov models for random strings that no pattern names.

The models are first-order chains over 96 symbols (printable ASCII and one
symbol for the border of a string). "Random" is trained on the secret values that the
patterns label, each together with its digest written in the other alphabets that
secrets come in (``ALPHABETS``): labelled values are mostly hexadecimal. "Ordinary" is
trained on the other identifier-like tokens. Both come from all documents; transition
counts are summed by Spark, so the driver sees two 96 x 96 tables. A token of at least
16 characters outside all pattern spans is reported as kind ``markov`` when its mean
log-likelihood ratio per transition reaches a threshold and its sum ``total``.

The threshold is calibrated: a fifth of the labelled and of the ordinary strings, by
hash, takes no part in training; a second pass scores them. The threshold is the lowest
at which at most ``max_false`` of these ordinary tokens are reported, but never so high
that less than ``recall`` of the labelled strings in any alphabet are found (the ordinary
tokens hold unlabelled secrets, too), nor above ``CERTAIN``, and 0 at least: the random model
must be the likelier one. Strings of one character class alone (digits,
lower-case letters) are no target.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.llm.common import SEGMENT
from lendspark.session import ensure_checkpoint_dir

# The pattern kinds, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")      # 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN = 6
KINDS = ("assign", "access", "hex", "markov")

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
KEYWORDS = (b"passw", b"secret", b"token", b"api")
N_SYMBOLS, BORDER = 96, 95
ALPHABETS = {"base64": string.ascii_letters + string.digits + "+/", "base64url": string.ascii_letters + string.digits + "-_",
             "base62": string.ascii_letters + string.digits, "base36": string.ascii_lowercase + string.digits,
             "BASE36": string.ascii_uppercase + string.digits}
FOLDS = 5                 # strings of fold 0 are held out for the threshold
CERTAIN = 0.5             # a mean ratio that is always reported
BIN, BINS = 0.02, 1000    # histogram of mean ratios from -10 to 10
BACK_OFF = 100.0          # weight of the symbol frequencies in a transition row


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of all pattern matches, sorted."""
    spans = []
    raw = text.encode("utf-8", "surrogatepass").lower()
    if any(w in raw for w in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                  if len(m.group(2)) >= MIN_ASSIGN]
    if b"akia" in raw:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def secret_values(text: str) -> list[str]:
    """The secret part of each pattern match (an assignment's value)."""
    out = [m.group(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 2 * MIN_ASSIGN]
    return out + [m.group() for p in (ACCESS, HEX) for m in p.finditer(text)]


def symbols(token: str) -> np.ndarray:
    """Symbol codes of an ASCII token with a border at both ends."""
    c = np.frombuffer(token.encode("ascii", "replace"), np.uint8).astype(np.int64) - 32
    c = np.where((c < 0) | (c >= BORDER), 0, c)
    return np.concatenate(([BORDER], c, [BORDER]))


def in_alphabets(value: str) -> dict[str, str]:
    """A labelled value's digest written in every alphabet of secrets, at its length (20
    to 64 characters)."""
    size = min(64, max(20, len(value)))
    raw = hashlib.blake2b(value.encode("ascii", "replace"), digest_size=64).digest()
    raw += hashlib.blake2b(raw, digest_size=64).digest()
    number, out = int.from_bytes(raw, "little"), {}
    for name, letters in ALPHABETS.items():
        n, chars = number, []
        for _ in range(size):
            n, k = divmod(n, len(letters))
            chars.append(letters[k])
        out[name] = "".join(chars)
    return out


def held_out(token: str) -> bool:
    return zlib.crc32(token.encode("ascii", "replace")) % FOLDS == 0


def free_tokens(text: str, spans, pattern) -> list[tuple[int, int]]:
    """Tokens that touch no pattern span. Overlapping spans are merged first, so each
    token looks at the next one only."""
    merged: list[list[int]] = []
    for s, e in sorted((s, e) for s, _, e in spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    out, k = [], 0
    for m in pattern.finditer(text):
        while k < len(merged) and merged[k][1] <= m.start():
            k += 1
        if k == len(merged) or merged[k][0] >= m.end():
            out.append((m.start(), m.end()))
    return out


def _transitions(tokens) -> np.ndarray:
    """Counts (from * 96 + to) of the transitions of ASCII tokens, borders included."""
    raw = "\x7f" + "\x7f".join(tokens) + "\x7f"          # symbol BORDER
    c = np.frombuffer(raw.encode("ascii"), np.uint8).astype(np.int64) - 32
    return np.bincount(c[:-1] * N_SYMBOLS + c[1:], minlength=N_SYMBOLS * N_SYMBOLS)


def _counts(batches):
    """Transition counts of labelled strings: (label, from * 96 + to, n)."""
    total = np.zeros((2, N_SYMBOLS * N_SYMBOLS), np.int64)
    for b in batches:
        held, size = ([], []), 0
        for v in b.column(0):
            text = v.as_py()
            if not text:
                continue
            spans = pattern_spans(text)
            held[0].extend(t for t in {text[s:e] for s, e in free_tokens(text, spans, ORDINARY)} if not held_out(t))
            for value in secret_values(text) if spans else ():
                if not held_out(value):
                    held[1].extend([value, *in_alphabets(value).values()])
            size += len(text)
            if size >= SEGMENT:
                for label in range(2):
                    if held[label]:
                        total[label] += _transitions(held[label])
                held, size = ([], []), 0
        for label in range(2):
            if held[label]:
                total[label] += _transitions(held[label])
    label, pair = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(label, pa.int32()), pa.array(pair, pa.int32()), pa.array(total[label, pair])],
        names=["label", "pair", "n"])


class Models:
    """Log-likelihood ratios (96 x 96) and the threshold of their mean."""

    def __init__(self, ratio: np.ndarray, threshold: float = CERTAIN, report: dict[str, float] | None = None) -> None:
        self.ratio, self.threshold, self.report = ratio, threshold, report or {}

    def mean(self, token: str) -> float:
        c = symbols(token)
        return float(self.ratio[c[:-1], c[1:]].mean())


def ratio_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratio table (96 x 96) from all documents. Without labelled
    strings it is all zero."""
    rows = (docs.select(F.col(text_col).cast("string"))
            .mapInArrow(_counts, "label int, pair int, n long")
            .groupBy("label", "pair").agg(F.sum("n").alias("n")).collect())   # two tables
    n = np.zeros((2, N_SYMBOLS, N_SYMBOLS))
    for r in rows:
        n[r["label"], r["pair"] // N_SYMBOLS, r["pair"] % N_SYMBOLS] = r["n"]
    if not n[0].sum() or not n[1].sum():
        return np.zeros((N_SYMBOLS, N_SYMBOLS))
    seen = n.sum(1) + 0.5                               # how often each symbol follows any
    q = (seen / seen.sum(1, keepdims=True))[:, None, :]
    p = (n + BACK_OFF * q) / (n.sum(2, keepdims=True) + BACK_OFF)
    return np.log(p[1]) - np.log(p[0])


def _held_out_scores(models: Models):
    """Histogram (kind, bin of the mean ratio, n) of held-out strings: kind 'ordinary',
    'labelled' or an alphabet's name."""
    def run(batches):
        count: dict[tuple[str, int], int] = {}

        def add(kind: str, token: str) -> None:
            k = int(np.clip((models.mean(token) + BIN * BINS / 2) / BIN, 0, BINS - 1))
            count[kind, k] = count.get((kind, k), 0) + 1
        for b in batches:
            for v in b.column(0):
                text = v.as_py()
                if not text:
                    continue
                spans = pattern_spans(text)
                for t in {text[s:e] for s, e in free_tokens(text, spans, TOKEN)}:
                    if held_out(t):
                        add("ordinary", t)
                for value in secret_values(text) if spans else ():
                    if held_out(value):
                        add("labelled", value)
                        for name, t in in_alphabets(value).items():
                            add(name, t)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in count], pa.string()), pa.array([b for _, b in count], pa.int32()),
                                          pa.array(list(count.values()), pa.int64())], names=["kind", "bin", "n"])
    return run


def train(docs: DataFrame, text_col: str = "text", max_false: float = 0.001, recall: float = 0.97) -> Models:
    """Models of all documents with the calibrated threshold; ``report`` has the share of
    held-out strings of each kind that reach it."""
    models = Models(ratio_table(docs, text_col))
    if not models.ratio.any():
        return models
    rows = (docs.select(F.col(text_col).cast("string")).mapInArrow(_held_out_scores(models), "kind string, bin int, n long")
            .groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect())     # (2 + alphabets) x BINS rows at most
    hist: dict[str, np.ndarray] = {}
    for r in rows:
        hist.setdefault(r["kind"], np.zeros(BINS, np.int64))[r["bin"]] = r["n"]
    from_here = np.cumsum(hist.get("ordinary", np.zeros(BINS, np.int64))[::-1])[::-1]       # tokens in this bin or above
    fine = np.flatnonzero(from_here <= max_false * max(1, from_here[0]))
    k = int(fine[0]) if len(fine) else BINS
    for h in (h for kind, h in hist.items() if kind != "ordinary"):
        reached = np.flatnonzero(np.cumsum(h[::-1])[::-1] >= recall * h.sum())
        k = min(k, int(reached[-1]))
    k = min(max(BINS // 2, k), BINS // 2 + round(CERTAIN / BIN))
    models.threshold = (k - BINS / 2) * BIN
    models.report = {kind: float(h[k:].sum() / h.sum()) for kind, h in sorted(hist.items())}
    return models


def markov_spans(text: str, spans, models: Models, total: float):
    out = []
    for s, e in free_tokens(text, spans, TOKEN):
        mean = models.mean(text[s:e])
        if mean >= models.threshold and mean * (e - s + 1) >= total:
            out.append((s, 3, e))
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 total: float = 10.0, max_false: float = 0.001, models: Models | None = None) -> DataFrame:
    """One row per input row: (id, spans array<struct<start, end, kind>>),
    offsets in code points, end exclusive, sorted by start and kind.

    Null and empty texts have no spans. Null ids and repeated rows are kept, and
    the models are trained on them too. Whole texts are scanned, of any length. Other
    columns are not read. An empty table gives an empty result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    if models is None:
        models = train(docs, text_col, max_false)
    table = models         # 96 x 96 doubles and a number

    def scan(batches):
        for b in batches:
            rows = []
            for v in b.column(1):
                text = v.as_py() or ""
                spans = pattern_spans(text)
                spans = sorted(spans + markov_spans(text, spans, table, total))
                rows.append([{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(rows, pa.list_(pa.struct(
                    [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))],
                names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col), F.col(text_col).cast("string"))
            .mapInArrow(scan, f"`{id_col}` {kind}, "
                              "spans array<struct<start:bigint,end:bigint,kind:string>>"))


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of the pattern kinds, the SHA-256 of their spans, and all spans."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(
        ":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"),
                        n("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: s["kind"] == "markov")).cast("long")
                        .alias("n_markov"))


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """The documents, with every found span replaced by ``mark``; ``n_chars``, if
    there, is counted anew where a text changed. Columns and rows stay, of any other
    names; null and empty texts stay as they are, repeated rows are each redacted."""
    ensure_checkpoint_dir(docs.sparkSession)
    models = train(docs, max_false=options.get("max_false", 0.001))
    total = options.get("total", 10.0)
    at = docs.columns.index("text")

    def clean(batches):
        for b in batches:
            texts = []
            for v in b.column(at):
                text = v.as_py()
                if text:
                    spans = pattern_spans(text)
                    spans = sorted(spans + markov_spans(text, spans, models, total))
                    out, last = [], 0
                    for s, _, e in spans:
                        if s >= last:
                            out += [text[last:s], mark]
                        last = max(last, e)
                    text = "".join(out) + text[last:]
                texts.append(text)
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    out = docs.mapInArrow(clean, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").contains(mark),
                                               F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out
