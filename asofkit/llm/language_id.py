"""Language identification by segmentation-marginalised unigram models over a fixed public vocabulary.

A language is a probability for each piece of the vocabulary. A word's probability is the sum over all its segmentations
into pieces, by the forward algorithm; a text's is the product over its words. The piece probabilities are fitted by
expectation-maximisation over the same segmentations, on word counts of a bounded sample of labelled texts. Characters
outside the vocabulary have one small probability each. Words are taken whole, whatever their length.

Nulls and edge cases: a text that is null or has no letter is `und` with score 0; ties between languages go to the
smaller name; with no training text all is `und`; rows are judged one by one, so repeated rows agree. Only the text is
an input of a prediction.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.common import lean

#: Letters only, so that digits, marks and junk say nothing.
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters from which a word's sums are held with a logarithm beside them, so that they can't run out of range.
LONG_WORD = 24
#: Sample for the fit: at most about so many texts a language, of any length, and so many distinct words.
SAMPLE_TEXTS, SAMPLE_WORDS = 1500, 20_000
ROUNDS = 4
MARK = "▁"
_BASE = np.uint64(0x100000001B3)


def vocabulary(path: str) -> list[str]:
    """Pieces of letters of a public sentencepiece vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in pieces if p and LETTERS.fullmatch(p.removeprefix(MARK) or "a"))


def _codes(words: list[str]) -> np.ndarray:
    """Code points plus one of equally long words, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64) + np.uint64(1)


class Pieces:
    """Vocabulary as sorted hashes behind a bitmap; looks up all stretches of many words at once."""

    BITS = 22

    def __init__(self, pieces: list[str]):
        h = np.empty(len(pieces), np.uint64)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by.setdefault(len(p), []).append(i)
        for rows in by.values():
            code = np.zeros(len(rows), np.uint64)
            for column in _codes([pieces[i] for i in rows]).T:
                code = self._step(code, column)
            h[rows] = code
        self.order = np.argsort(h)
        self.hashes, self.n, self.longest = h[self.order], len(pieces), max(by, default=0)
        self.bitmap = np.zeros(1 << self.BITS, bool)
        self.bitmap[self._bit(h)] = True

    @staticmethod
    def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (h ^ (code * np.uint64(0x9E3779B97F4A7C15))) * _BASE + (h >> np.uint64(29))

    def _bit(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def spans(self, codes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of every stretch that is a piece in some of the rows, by end and then start."""
        n, size = codes.shape
        h, out = np.zeros((n, size), np.uint64), []
        for length in range(1, min(self.longest, size) + 1):
            h = self._step(h[:, : size - length + 1], codes[:, length - 1 :])
            rows, starts = np.nonzero(self.bitmap[self._bit(h)])
            found = h[rows, starts]
            at = np.minimum(np.searchsorted(self.hashes, found), self.n - 1)
            same = self.hashes[at] == found
            rows, starts, at = rows[same], starts[same], self.order[at[same]]
            by = np.argsort(starts, kind="stable")
            rows, starts, at = rows[by], starts[by], at[by]
            where = np.flatnonzero(np.diff(starts, prepend=-1))
            for a, b in zip(where, [*where[1:], len(starts)], strict=False):
                out.append((int(starts[a]), int(starts[a]) + length, rows[a:b], at[a:b]))
        return sorted(out, key=lambda x: (x[1], x[0]))


def grouped(words: list[str]):
    """Yield (rows, codes) of words of one length, with the word mark in front."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for rows in by.values():
        for k in range(0, len(rows), 50_000):
            part = rows[k : k + 50_000]
            yield part, _codes([MARK + words[i] for i in part])


def forward(spans: list, size: int, n: int, prob: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, logs): sums[j] * exp(logs[j]) is the probability of each word's first j characters over all their segmentations.

    spans as Pieces.spans gives them; prob: a row a piece; unknown: what a character by itself has in each row (n or 1 rows).
    """
    alpha, logs, at = np.zeros((size + 1, n, prob.shape[1])), np.zeros((size + 1, n, prob.shape[1])), 0
    alpha[0] = 1
    long = size > LONG_WORD
    for j in range(1, size + 1):
        while at < len(spans) and spans[at][1] == j:
            k, _, rows, piece = spans[at]
            more = alpha[k, rows] * prob[piece]
            alpha[j, rows] += more * np.exp(logs[k, rows] - logs[j - 1, rows]) if long else more
            at += 1
        alpha[j] += alpha[j - 1] * unknown[j - 1]
        if long:
            logs[j] = logs[j - 1] + np.log(alpha[j])
            alpha[j] = 1
    return alpha, logs


def word_logs(words: list[str], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log-probability of each word for each language; prob: pieces + 1 rows, the last for an unknown character."""
    out = np.zeros((len(words), prob.shape[1]))
    for rows, codes in grouped(words):
        n, size = codes.shape
        alpha, logs = forward(pieces.spans(codes), size, n, prob, np.broadcast_to(prob[-1], (size, 1, prob.shape[1])))
        out[rows] = np.log(alpha[size]) + logs[size]
    return out


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Piece probabilities for each language from its word counts, by expectation-maximisation over all segmentations."""
    names, table = sorted(counts), Pieces(pieces)
    length = np.array([len(p) for p in pieces] + [1])
    prob = np.empty((table.n + 1, len(names)))
    for c, name in enumerate(names):
        words = list(counts[name])
        weight = np.array([counts[name][w] for w in words], float)
        groups = []
        for rows, codes in grouped(words):
            n, size = codes.shape
            spans = table.spans(codes)
            lone = np.ones((size, n, 1))  # 1 where a character is no piece
            for k, j, at, _ in spans:
                if j == k + 1:
                    lone[k, at] = 0
            back = sorted(((size - j, size - k, at, piece) for k, j, at, piece in spans), key=lambda x: (x[1], x[0]))
            groups.append((weight[rows], n, size, spans, back, lone))
        p = np.where(length == 1, 1.0, 0.5**length)
        p /= p.sum()
        p[-1] = 1e-7
        for _ in range(rounds):
            got = np.zeros(table.n + 1)
            for w, n, size, spans, back, lone in groups:
                alpha, la = forward(spans, size, n, p[:, None], lone * p[-1])
                beta, lb = forward(back, size, n, p[:, None], lone[::-1] * p[-1])
                alpha, la, beta, lb = alpha[:, :, 0], la[:, :, 0], beta[::-1, :, 0], lb[::-1, :, 0]
                for k, j, rows, piece in spans:
                    share = alpha[k, rows] * p[piece] * beta[j, rows] / alpha[size, rows] * np.exp(la[k, rows] + lb[j, rows] - la[size, rows])
                    got[:-1] += np.bincount(piece, share * w[rows], table.n)
            p = got + 0.01
            p /= p.sum()
            p[-1] = 1e-7
        prob[:, c] = p
    return names, prob


def train(labelled: DataFrame, vocabulary_path: str, sample_texts: int = SAMPLE_TEXTS) -> tuple[list[str], list[str], np.ndarray]:
    """Fit on (doc_id, text, lang) rows: a sample of at most about sample_texts texts a language, chosen by a hash of doc_id."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = rows.groupBy("lang").count().collect()
    pieces = vocabulary(vocabulary_path)
    if not sizes:
        return pieces, [], np.zeros((len(pieces) + 1, 0))
    rate = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, sample_texts / r["count"]))) for r in sizes])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20))

    def words(batches):
        for b in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            flat = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    totals = chosen.select("text", "lang").mapInArrow(lean(words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    for x in totals.withColumn("_r", rank).where(F.col("_r") <= SAMPLE_WORDS).collect():
        counts.setdefault(x.lang, {})[x.word] = x.n
    names, prob = fit({k: v for k, v in counts.items() if v}, pieces)
    return pieces, names, prob


def identify(documents: DataFrame, model: tuple[list[str], list[str], np.ndarray]) -> DataFrame:
    """The documents with lang_pred and score (posterior of that language under equal priors)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        pieces, names, prob = shared.value
        table = Pieces(pieces)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                index: dict[str, int] = {}
                bags = []
                for t in texts:
                    bag = Counter(LETTERS.findall((t or "").lower()))
                    for w in [w for w in bag if not w.isalpha()]:  # digits of other scripts count as word characters
                        n = bag.pop(w)
                        if w := "".join(filter(str.isalpha, w)):
                            bag[w] += n
                    bags.append(([index.setdefault(w, len(index)) for w in bag], list(bag.values())))
                lang, score = [], []
                logs = word_logs(list(index), table, prob) if names else None
                for rows, n in bags:
                    if not rows or not names:
                        lang.append("und")
                        score.append(0.0)
                        continue
                    total = np.array(n, float) @ logs[rows]
                    p = np.exp(total - total.max())
                    k = int(np.argmax(total))
                    lang.append(names[k])
                    score.append(float(p[k] / p.sum()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    base = documents.drop(*[c for c in ("lang_pred", "score") if c in documents.columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(lean(run), f"{schema}, lang_pred string, score double")


def held_out(key: str = "doc_id"):
    """True for rows that no model of this package learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
