"""Text decoded with a wrong character encoding: find it and undo it.

Model.  Every span of a text (a run of letters that holds a character beyond
ASCII) is either clean or was written in one encoding and read in another, once
or twice: the latent *chain*.  Clean spans follow a character trigram model; a
span under a chain has the probability of what the chain's inverse gives.
A garbled stretch is a run of spans; its evidence is the best sum of log
ratios over consecutive spans.  A record has as many stretches, of as many
chains, as have evidence of their own.  The prior of each chain is kept per field
(documents.source), so weak evidence is pooled across the records of a source.

Expectation-maximization.  E: posterior of each record's chain.  M: the clean
model is counted again without the stretches believed garbled, and the chain
priors of each source are averaged.  Each round is one Spark job over the
spans; what the driver keeps is of fixed size: ``ngrams.BUCKETS`` n-gram counts and
``FIELDS`` x chains priors (sources are hashed to FIELDS groups).

U+FFFD stands for bytes that could not be decoded; such a span is garbled and
cannot be restored, but the other stretches of its record are.

Null, blank and ASCII texts are clean.  Repeated rows of one doc_id count once.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm import ngrams
from codeweft.storage import materialize

FIELDS = 1 << 10
ROUNDS = 2
LOST = "�"
#: prior weight and first value of the share of records that a chain garbled
PSEUDO, FIRST_PRIOR = 200.0, 1e-3
#: a chain's prior never exceeds this, and a stretch needs this log ratio: else
#: a chain that fits many clean words slightly would feed on its own prior
MOST_PRIOR, LEAST_EVIDENCE = 0.02, 5.0

SPAN = r"(?<![A-Za-z])[A-Za-z]*+[^\x00-\x7F](?:[A-Za-z]|[^\x00-\x7F])*"
_span = re.compile(SPAN)
_beyond = re.compile("[^\x00-\x7f\xa0]")

LATIN = ("cp1252", "latin-1", "cp1250", "iso8859-2", "mac_roman", "cp437", "cp850")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
EAST_ASIAN = ("shift_jis", "gb18030", "euc_jp", "big5", "euc_kr")
#: (read as, written in); a double chain is two misreadings of the same kind
CHAINS = (
    [((r, "utf-8"),) for r in LATIN + CYRILLIC]
    + [((r, w),) for r in LATIN for w in LATIN if r != w]
    + [((r, w),) for r in CYRILLIC for w in CYRILLIC if r != w]
    + [((r, w),) for r in LATIN for w in CYRILLIC]
    + [((r, w),) for r in CYRILLIC for w in LATIN]
    + [((r, w),) for r in ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251") for w in EAST_ASIAN]
    + [((r, "utf-8"), (s, "utf-8")) for r in LATIN + CYRILLIC for s in LATIN + CYRILLIC if r == s or {r, s} <= {"cp1252", "latin-1"}]
)
CHAIN_NAMES = [" then ".join(f"{w} read as {r}" for r, w in reversed(c)) for c in CHAINS] + ["lost bytes"]
LOSSY = len(CHAINS)


def _tables():
    """char -> byte of every single-byte encoding; bytes it lacks stand for C1 controls."""
    tables = {}
    for name in LATIN + CYRILLIC:
        back = {}
        for b in range(256):
            try:
                back[bytes([b]).decode(name)] = b
            except UnicodeDecodeError:
                back[chr(b)] = b
        tables[name] = back
    return tables


_BYTES = _tables()
_CHARACTERS = {c for table in _BYTES.values() for c in table}


def _encode(text: str, name: str):
    table = _BYTES[name]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def _plausible(text: str) -> bool:
    return not any(0x7F <= ord(c) <= 0x9F or 0xE000 <= ord(c) <= 0xF8FF or c == LOST for c in text)


def _decode(raw: bytes, name: str):
    if name in _BYTES:
        return raw.decode(name, "ignore")
    try:
        return raw.decode(name)
    except UnicodeDecodeError:
        return None


def undo(text: str, chain: int):
    """The original of ``text`` under a chain, or None."""
    for read, written in CHAINS[chain]:
        raw = _encode(text, read)
        text = _decode(raw, written) if raw is not None else None
        if text is None:
            return None
    return text


_known: dict[str, list[tuple[int, str]]] = {}


def originals(span: str) -> list[tuple[int, str]]:
    """(chain, original) for every chain that can have produced ``span``."""
    found = _known.get(span)
    if found is None:
        if not _beyond.search(span):  # a no-break space between plain words proves nothing
            return []
        if len(_known) > 200_000:
            _known.clear()
        found = [(LOSSY, "")] if LOST in span else []
        if not _CHARACTERS.issuperset(span):  # no single-byte encoding gives such a span
            _known[span] = found
            return found
        raw = {name: _encode(span, name) for name in _BYTES}
        for k, chain in enumerate(CHAINS):
            b = raw[chain[0][0]]
            if b is None:
                continue
            first = _decode(b, chain[0][1])
            text = first if first is None or len(chain) == 1 else undo(first, CHAINS.index(chain[1:]))
            if text and text != span and _plausible(text):
                found.append((k, text))
        _known[span] = found
    return found


class Clean:
    """Interpolated trigram model over hashed counts of fixed size."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.evidence: dict[str, list[tuple[int, float]]] = {}

    def weigh(self, spans) -> None:
        """Keep for each span the chains that explain it better than clean text does."""
        if len(self.evidence) > 300_000:
            self.evidence.clear()
        new = [s for s in spans if s not in self.evidence]
        found = {s: originals(s) for s in new}
        texts = list({t for s, f in found.items() if f for t in (s, *(t for k, t in f if k != LOSSY))})
        logs = dict(zip(texts, ngrams.logs(self.counts, texts).tolist()))
        for s, f in found.items():
            own = logs[s] if f else 0.0
            ratios = [(k, 9.0 if k == LOSSY else min(logs[t] - own, 40.0)) for k, t in f]
            self.evidence[s] = [x for x in ratios if x[1] > 1]


def _best_run(scores: list[float]) -> tuple[float, int, int]:
    """Largest sum of consecutive scores and where it lies (Kadane)."""
    best, at, sum_, start = -1e9, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if sum_ <= 0:
            sum_, start = 0.0, i
        sum_ += s
        if sum_ > best:
            best, at = sum_, (start, i + 1)
    return best, *at


def _runs(hits: dict[int, float]) -> list[tuple[float, int, int]]:
    """All maximal runs (sum, first, end) of spans, each without ``hits`` counting -2 (Ruzzo-Tompa)."""
    out, stack, total, last = [], [], 0.0, None
    for i in sorted(hits):
        if last is not None:
            total -= 2.0 * (i - last - 1)
        last, low = i, total
        total += hits[i]
        first = i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= low:
                j -= 1
            if j < 0:  # no later run can be joined to those before
                out += stack
                stack = [(low, total, first, i + 1)]
                break
            if stack[j][1] >= total:
                stack.append((low, total, first, i + 1))
                break
            low, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(high - low, a, b) for low, high, a, b in out + stack]


def _stretches(evidence: dict[int, dict[int, float]], prior: np.ndarray, sure: bool) -> list[tuple[int, int, int]]:
    """Disjoint stretches (chain, first span, end span) of one record, in order.

    The likeliest comes first (``sure``: it is taken anyway) and takes its spans
    from the others.  Each needs evidence that outweighs its chain's prior, or
    ``LEAST_EVIDENCE`` once the record is known to be garbled by that chain.
    """
    heap, kept, late = [], [], []

    def push(k, hits):
        for score, a, b in _runs(hits):
            if score >= LEAST_EVIDENCE:
                heapq.heappush(heap, (-score - math.log(prior[k]), -k, a, b))

    for k, hits in evidence.items():
        if k != LOSSY:
            push(k, hits)
    owner: dict[int, int] = {}
    while heap or late:
        if not heap:
            known = set(owner.values())
            heap = [x for x in late if -x[1] in known]
            if not heap:
                break
            late = [x for x in late if -x[1] not in known]
            heapq.heapify(heap)
        cost, k, a, b = heapq.heappop(heap)
        k = -k
        free = [i for i in range(a, b) if i not in owner]
        if len(free) < b - a:
            part: dict[int, float] = {}
            for n, i in enumerate(free):
                if n and i > free[n - 1] + 1:
                    push(k, part)
                    part = {}
                if i in evidence[k]:
                    part[i] = evidence[k][i]
            push(k, part)
        elif cost <= 0 or (sure and not kept) or k in owner.values():
            kept.append((k, a, b))
            owner |= dict.fromkeys(range(a, b), k)
        else:
            late.append((cost, -k, a, b))
    lost = sorted(evidence.get(LOSSY, ()))
    for i in lost:
        if kept and kept[-1][0] == LOSSY and kept[-1][2] == i:
            kept[-1] = (LOSSY, kept[-1][1], i + 1)
        else:
            kept.append((LOSSY, i, i + 1))
    return sorted(kept, key=lambda x: (x[1], x[0]))


def judge(spans: list[str], model: Clean, prior: np.ndarray, least: float = 0.01):
    """(posterior that a stretch is garbled, its stretches if that is above ``least``)."""
    evidence: dict[int, dict[int, float]] = {}
    for i, span in enumerate(spans):
        for k, ratio in model.evidence[span]:
            evidence.setdefault(k, {})[i] = ratio
    if not evidence:
        return 0.0, []
    logs = []
    for k, hits in evidence.items():
        low, high = min(hits), max(hits) + 1
        best = _best_run([hits.get(i, -2.0) for i in range(low, high)])[0]
        if best >= LEAST_EVIDENCE:
            logs.append((best + math.log(prior[k]), k))
    if not logs:
        return 0.0, []
    odds = sum(math.exp(min(x[0], 300)) for x in logs)
    p = odds / (1 + odds)
    return p, _stretches(evidence, prior, max(logs)[1] != LOSSY) if p >= least else []


def _field(source) -> int:
    return zlib.crc32((source or "").encode()) % FIELDS


def span_table(documents: DataFrame) -> DataFrame:
    """(doc_id, source, spans) of the texts with characters beyond ASCII."""
    return (
        documents.where(F.col("text").rlike(r"[^\x00-\x7F]"))
        .select("doc_id", "source", F.regexp_extract_all("text", F.lit(f"({SPAN})"), 1).alias("spans"))
    )


def _counted(rows: DataFrame, state) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all records, as one row for each place that isn't zero.

    Without a state: n-gram counts of all spans.  With one (M step): what the
    garbled stretches take away from them, chain sums and record counts by field.
    """
    width = len(CHAIN_NAMES)

    def count(batches):
        sums, chains, records = np.zeros(ngrams.BUCKETS + 1), np.zeros(FIELDS * width), np.zeros(FIELDS)
        if state is not None:
            counts, prior = state.value
            model = Clean(counts)
        for batch in batches:
            spans = [list(x) for x in batch["spans"]]
            if state is None:
                ngrams.add(sums, Counter(s for x in spans for s in x if LOST not in s))
                continue
            model.weigh({s for x in spans for s in x})
            away = Counter()
            for source, own in zip(batch["source"], spans):
                field = _field(source)
                p, found = judge(own, model, prior[field])
                records[field] += 1
                for k in {k for k, _, _ in found}:
                    chains[field * width + k] += p
                if p > 0.5:
                    away.subtract(s for k, a, b in found for s in own[a:b] if LOST not in s)
            ngrams.add(sums, away)
        for kind, x in enumerate((sums, chains, records)):
            at = np.flatnonzero(x)
            yield pd.DataFrame({"kind": np.full(len(at), kind, dtype=np.int32), "slot": at.astype(np.int32), "n": x[at]})

    # at most ngrams.BUCKETS + FIELDS * (chains + 1) rows, whatever the input
    total = rows.mapInPandas(count, "kind int, slot int, n double").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    out = [np.zeros(ngrams.BUCKETS + 1), np.zeros(FIELDS * width), np.zeros(FIELDS)]
    for kind, part in total.groupby("kind"):
        out[kind][part["slot"].to_numpy()] = part["n"].to_numpy()
    return out[0], out[1].reshape(FIELDS, width), out[2]


def garbled(documents: DataFrame, rounds: int = ROUNDS, least: float = 0.5) -> DataFrame:
    """Rows of ``documents`` with a garbled stretch: doc_id, posterior, stretches.

    A stretch has a chain ``k`` and the spans from ``a`` to before ``b``.  Only records with a posterior of at least ``least`` come out.
    """
    spark = documents.sparkSession
    rows = materialize(span_table(documents.select("doc_id", "text", "source")))
    everything, _, _ = _counted(rows, None)
    counts = everything
    prior = np.full((FIELDS, len(CHAIN_NAMES)), FIRST_PRIOR)
    for _ in range(rounds):
        away, chains, records = _counted(rows, spark.sparkContext.broadcast((counts, prior)))
        counts = np.maximum(everything + away, 0)
        overall = (chains.sum(0) + 1e-4 * PSEUDO) / (records.sum() + PSEUDO)
        prior = np.minimum(MOST_PRIOR, (chains + PSEUDO * overall) / (records[:, None] + PSEUDO))
    state = spark.sparkContext.broadcast((counts, prior))

    def judged(batches):
        model = Clean(state.value[0])
        for batch in batches:
            out, all_spans = [], [list(x) for x in batch["spans"]]
            model.weigh({s for x in all_spans for s in x})
            for doc, source, spans in zip(batch["doc_id"], batch["source"], all_spans):
                p, found = judge(spans, model, state.value[1][_field(source)], least)
                if p >= least:
                    out.append((doc, p, [{"k": k, "a": a, "b": b} for k, a, b in found]))
            yield pd.DataFrame(out, columns=["doc_id", "posterior", "stretches"])

    found = rows.mapInPandas(judged, "doc_id bigint, posterior double, stretches array<struct<k: int, a: int, b: int>>")
    return found.dropDuplicates(["doc_id"])


def restore(text: str, stretches) -> str | None:
    """``text`` with every stretch undone that has not lost bytes; null if all have."""
    owner = {i: x["k"] for x in stretches if x["k"] != LOSSY for i in range(x["a"], x["b"])}
    if not owner:
        return None
    at = [0]

    def swap(m):
        i, at[0] = at[0], at[0] + 1
        return dict(originals(m.group())).get(owner[i], m.group()) if i in owner else m.group()

    return _span.sub(swap, text)


def repaired(documents: DataFrame, **kwargs) -> DataFrame:
    """:func:`garbled` with the names of the chains, in their order in the text, and the restored text."""
    found = garbled(documents, **kwargs)
    texts = documents.select("doc_id", "text").where("text is not null").dropDuplicates(["doc_id"]).join(found, "doc_id")

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, p, stretches in zip(*(batch[c] for c in ("doc_id", "text", "posterior", "stretches"))):
                chains = "; ".join(dict.fromkeys(CHAIN_NAMES[x["k"]] for x in stretches))
                out.append((doc, chains, p, restore(text, stretches)))
            yield pd.DataFrame(out, columns=["doc_id", "chain", "posterior", "repaired"])

    return texts.mapInPandas(run, "doc_id bigint, chain string, posterior double, repaired string")
