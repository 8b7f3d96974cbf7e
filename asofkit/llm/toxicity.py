"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are words, and beginnings of words, that chi-squared ties to a label over labelled texts, of which near copies count
once; a text's vector holds (1 + ln tf) * idf of them.
The index holds a bounded sample of labelled vectors in blocks; for each term it has the postings of every block and the
largest weight in the block. A query sums those maxima into a bound for each block and scores blocks by falling bound
until the bound is below the k-th best cosine found, so the k nearest are exact. Their votes, weighted by nearness and
by how much of its class each example stands for, are mixed with the rate of the label; a map fitted on the sample's own
leave-one-out votes calibrates the score.

Nulls and edge cases: a text that is null, empty or without a chosen term has a zero vector and gets the label rate of
training texts without such terms; ties in cosine go to the smaller doc_id; rows without a 0/1 label teach nothing;
with no labelled row the score is 0; rows that repeat a doc_id are scored alike. Only the text is an input of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import lean

WORDS = re.compile(r"[^\W\d_]+")
#: At most about so many labelled texts of each label, so many terms; a term needs so many texts and chi-squared at least.
SAMPLE_TEXTS, TERMS, TERM_TEXTS, TERM_CHI2 = 2000, 2048, 5, 25.0
#: Letters of the beginnings of words that are terms too.
PREFIXES = (4, 5)
BLOCK, NEAREST = 64, 15
THRESHOLD = 0.3


def bag_of(text: str | None) -> Counter:
    """Counts of the words and of their beginnings, which `^` marks."""
    words = Counter(WORDS.findall((text or "").lower()))
    out = Counter(words)
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) > k:
                out["^" + w[:k]] += n
    return out


def first_copies(texts: list[str | None]) -> list[bool]:
    """Whether a text shares none of three minimum hashes of its three-word runs with a text before it; near copies nearly always do."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        words = (text or "").lower().split()
        runs = {zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 2))}
        keys = {(k, min((r * m + k) & 0xFFFFFFFF for r in runs)) for k, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))}
        out.append(not keys & seen)
        seen |= keys
    return out


class BlockMaxIndex:
    """Inverted index of unit vectors: postings by term and block, and the largest weight of a term in a block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.n = len(vectors)
        # similar vectors into one block: sorted by heaviest term, the bounds get tight
        order = sorted(range(self.n), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), i))
        self.ids = np.array(order, np.int64)
        blocks = -(-self.n // BLOCK)
        self.top = np.zeros((terms, blocks), np.float64)
        self.postings: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(blocks)]
        for b in range(blocks):
            by: dict[int, list[tuple[int, float]]] = {}
            for slot, i in enumerate(order[b * BLOCK : (b + 1) * BLOCK]):
                for t, w in zip(*vectors[i], strict=True):
                    by.setdefault(int(t), []).append((slot, float(w)))
            for t, found in by.items():
                self.postings[b][t] = (np.array([s for s, _ in found]), np.array([w for _, w in found]))
                self.top[t, b] = max(w for _, w in found)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest cosine above 0, as (cosine, example), largest first, ties to the smaller example."""
        if not len(terms) or not self.n:
            return []
        bound = weights @ self.top[terms]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) == k and bound[b] < best[-1][0] - 1e-12:
                break
            score = np.zeros(BLOCK)
            post = self.postings[b]
            for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                if t in post:
                    slots, values = post[t]
                    score[slots] += w * values
            found = [(float(score[s]), int(self.ids[b * BLOCK + s])) for s in np.flatnonzero(score > 0)]
            best = sorted([*best, *(x for x in found if x[1] != without)], key=lambda x: (-round(x[0], 12), x[1]))[:k]
        return best


class Model:
    """Terms, index, votes and calibration, fitted on (doc_id, text, label, weight) rows."""

    def __init__(self, rows: list[tuple[int, str, int, float]], nearest: int = NEAREST):
        rows = sorted(rows)
        self.k, self.ids, self.labels = nearest, [r[0] for r in rows], np.array([r[2] for r in rows], float)
        self.weight = np.array([r[3] for r in rows], float)
        bags = [bag_of(r[1]) for r in rows]
        total, all_pos = float(self.weight.sum()), float(self.weight @ self.labels) if rows else 0.0
        df, seen, have, n, plain_pos = Counter(), Counter(), Counter(), 0, 0
        for bag, y, w, new in zip(bags, self.labels, self.weight, first_copies([r[1] for r in rows]), strict=True):
            for t in bag:
                df[t] += w
            if new:  # chi-squared on plain counts, so that neither weights nor copies inflate it
                n, plain_pos = n + 1, plain_pos + int(y)
                seen.update(bag.keys())
                if y:
                    have.update(bag.keys())
        chosen = []
        for t, c in seen.items():
            if c >= TERM_TEXTS and 0 < plain_pos < n:
                a = have[t]
                d = c * (n - c) * plain_pos * (n - plain_pos)
                chi = n * (a * n - c * plain_pos) ** 2 / d if d else 0.0
                if chi >= TERM_CHI2:
                    chosen.append((-chi, t))
        chosen = sorted(chosen)[:TERMS]
        self.terms = {t: i for i, (_, t) in enumerate(chosen)}
        self.idf = np.array([np.log(max(total, 1.0) / max(df[t], 1e-9)) for _, t in chosen]).clip(min=1e-3)
        vectors = [self.vector(b) for b in bags]
        self.rate = all_pos / total if total else 0.0
        zero = np.array([not len(v[0]) for v in vectors], bool)
        rest = float(self.weight[zero].sum()) if rows else 0.0
        self.bare = float((self.weight * self.labels)[zero].sum() + 0.5 * self.rate) / (rest + 0.5) if rows else 0.0
        self.rows = np.flatnonzero(~zero)
        self.index = BlockMaxIndex([vectors[i] for i in self.rows], len(chosen))
        self.steps: tuple[np.ndarray, np.ndarray] | None = None
        raw = np.array([self.vote(vectors[i], without=j)[0] for j, i in enumerate(self.rows)])
        if len(raw):
            self.steps = _isotonic(raw, self.labels[self.rows], self.weight[self.rows])

    def vector(self, bag: Counter) -> tuple[np.ndarray, np.ndarray]:
        found = sorted((self.terms[t], n) for t, n in bag.items() if t in self.terms)
        at = np.array([i for i, _ in found], np.int64)
        w = (1 + np.log(np.array([n for _, n in found], float))) * self.idf[at] if found else np.zeros(0)
        norm = np.sqrt(w @ w)
        return at, w / norm if norm else w

    def vote(self, vector, without: int = -1) -> tuple[float, list[tuple[int, float, int]]]:
        """(weighted share of label 1 among the nearest, evidence as (doc_id, cosine, label))."""
        near = self.index.nearest(*vector, self.k, without)
        up, down, evidence = self.rate * 0.05, 0.05, []
        for cosine, j in near:
            i = self.rows[j]
            w = self.weight[i] / (1.05 - min(cosine, 1.0))
            up += w * self.labels[i]
            down += w
            evidence.append((int(self.ids[i]), cosine, int(self.labels[i])))
        return up / down, evidence

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float, int]]]:
        counts: Counter[str] = Counter()
        for w, n in Counter(WORDS.findall((text or "").lower())).items():
            for t in (w, *("^" + w[:k] for k in PREFIXES if len(w) > k)):
                if t in self.terms:
                    counts[t] += n
        vector = self.vector(counts)
        if not len(vector[0]) or self.steps is None:
            return self.bare, []
        raw, evidence = self.vote(vector)
        return float(np.interp(raw, *self.steps)), evidence


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising map from votes to label rates, by pooling adjacent violators; smoothed towards the ends."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a, b, c = pools.pop()
            pools[-1][0] += a
            pools[-1][1] += b
            pools[-1][2] += c
    return np.array([a / c for a, _, c in pools]), np.array([(b + 0.01 * w.mean()) / (c + 0.02 * w.mean()) for _, b, c in pools])


def train(documents: DataFrame, labels: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> Model:
    """Fit on documents (doc_id, text) and labels (doc_id, label): at most about sample_texts of each label, chosen by a hash of doc_id.

    The sample is drawn from the labels alone, so the join that fetches its texts broadcasts a bounded table.
    """
    rows = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", "label")
    sizes = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    if not sizes:
        return Model([])
    rate = {k: min(1.0, sample_texts / n) for k, n in sizes.items()}
    pick = F.coalesce(*[F.when(F.col("label") == k, F.lit(r)) for k, r in rate.items()])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < pick * (1 << 20))
    return Model([(r.doc_id, r.text, int(r.label), 1 / rate[int(r.label)]) for r in documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").collect()])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with score, predicted (1 from THRESHOLD up) and evidence (the nearest examples that voted)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        m = shared.value
        for b in batches:
            scores, evidence = [], []
            for text in b.column(b.schema.get_field_index("text")):
                s, e = m.score(text.as_py())
                scores.append(s)
                evidence.append([{"doc_id": i, "cosine": c, "label": y} for i, c, y in e[:3]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(evidence, kind)], [*b.schema.names, "score", "predicted", "evidence"])

    base = documents.drop(*[c for c in ("score", "predicted", "evidence") if c in documents.columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(lean(run), f"{schema}, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,label:int>>")
