"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

Every token is predicted from the WINDOW tokens on either side of it, itself left out, and the conditional
log-probabilities are summed. A token is a lower-cased word. The network predicts the word's class; the word given its
class has the share of the class that the whole corpus's word counts give it, whatever its rank.
The HEAD most frequent words are classes of their own, the rest of the VOCABULARY words that are broadcast is dealt over
TAIL classes by its last letters, and all others over TAIL more; the counts of those are joined by shuffle. A word that
was never counted has the share of one more token of its class.

The network starts from a bounded sample and is then trained on every token of all documents: shards of about
SHARD_TOKENS tokens are trained apart from the same weights, which are averaged by tokens after each pass.

Nulls and edge cases: a null text or one without words has no tokens, a log-likelihood of 0 and a mean of 0; a single
word is predicted from the edges alone; ties in count go to the smaller word; rows that repeat a doc_id are scored alike;
on an empty table nothing is trained or scored; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import Numbers, lean, materialize, most_counted

#: Words broadcast, words with a class of their own, classes for the rest inside and outside the broadcast, tokens on either side, hidden units.
VOCABULARY, HEAD, TAIL, WINDOW, HIDDEN = 30_000, 96, 16, 2, 32
CLASSES = HEAD + 2 * TAIL
#: Texts that the start is fitted on (about, chosen by a hash of doc_id), none longer than so many characters; passes, batch, rate, seed.
SAMPLE_TEXTS, SAMPLE_CHARS, PASSES, BATCH, RATE, SEED = 1500, 20_000, 2, 512, 0.004, 7
#: Tokens a shard, about; and the rows that the weights of all shards are summed to before the driver reads them.
SHARD_TOKENS, SUMS = 2_000_000, 16


def _tail(word: str) -> int:
    return zlib.crc32(word[-2:].encode("utf-8", "replace")) % TAIL


class Network:
    """Class of a token from the classes at its sides: one embedding table a place, a tanh layer, a softmax."""

    def __init__(self, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.places = [k for k in range(-WINDOW, WINDOW + 1) if k]
        self.embed = rng.normal(0, 0.1, (len(self.places), CLASSES + 1, HIDDEN)).astype(np.float32)  # the last row is an edge
        self.bias = np.zeros(HIDDEN, np.float32)
        self.out = rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32)
        self.out_bias = np.zeros(CLASSES, np.float32)

    @staticmethod
    def padded(classes: np.ndarray) -> np.ndarray:
        edge = np.full(WINDOW, CLASSES, classes.dtype)
        return np.concatenate([edge, classes, edge])

    def hidden(self, sides: list[np.ndarray]) -> np.ndarray:
        h = self.embed[0].take(sides[0], 0)
        for e, s in zip(self.embed[1:], sides[1:], strict=True):
            h += e.take(s, 0)
        h += self.bias
        return np.tanh(h, out=h)

    @staticmethod
    def exp_sums(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shift of each row and sum of exp(row - shift), which z becomes; a shift is needed only where float32 would not hold exp(z)."""
        shift = np.zeros((len(z), 1), np.float32)
        if not (z.max() < 80 and z.min() > -80):
            shift = z.max(1, keepdims=True)
            z -= shift
        np.exp(z, out=z)
        return shift[:, 0], z @ np.ones(z.shape[1], np.float32)

    def log_prob(self, padded: np.ndarray, where: np.ndarray) -> np.ndarray:
        """log P(class at each place of padded | its sides)."""
        out = np.empty(len(where), np.float64)
        for a in range(0, len(where), 1024):
            at = where[a : a + 1024]
            z = self.hidden([padded[at + k] for k in self.places]) @ self.out
            z += self.out_bias
            own = z[np.arange(len(at)), padded[at]]
            shift, total = self.exp_sums(z)
            out[a : a + 1024] = own - shift - np.log(total)
        return out

    def weights(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (self.embed, self.bias, self.out, self.out_bias)])

    def set_weights(self, flat: np.ndarray) -> None:
        at = 0
        for name in ("embed", "bias", "out", "out_bias"):
            old = getattr(self, name)
            setattr(self, name, flat[at : at + old.size].astype(np.float32).reshape(old.shape))
            at += old.size

    def train(self, padded: np.ndarray, where: np.ndarray, passes: int = PASSES, seed: int = SEED) -> None:
        """Adam on the mean negative log-probability; all weights are views of one array, so that a step is a few operations."""
        rng = np.random.Generator(np.random.PCG64(seed + 1))
        flat = self.weights()
        first, second, grad, part, t = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat), 0
        embed, bias, out, out_bias = self._views(flat)
        g_embed, g_bias, g_out, g_out_bias = self._views(grad)
        self.embed, self.bias, self.out, self.out_bias = embed, bias, out, out_bias
        place = np.arange(len(self.places))[:, None] * (CLASSES + 1)
        # two units of the embeddings' gradient are added as one complex number
        pairs, pair_of = g_embed.reshape(-1).view(np.complex64), np.arange(g_embed.size // 2).reshape(-1, HIDDEN // 2)
        for _ in range(passes):
            order = rng.permutation(where)
            for a in range(0, len(order), BATCH):
                at = order[a : a + BATCH]
                sides = [padded[at + k] for k in self.places]
                h = self.hidden(sides)
                z = h @ out
                z += out_bias
                _, total = self.exp_sums(z)
                # z stands for total times the difference of both distributions; the division is made on the narrow side
                z[np.arange(len(at)), padded[at]] -= total
                scale = 1 / (total * np.float32(len(at)))
                back = z @ out.T
                back *= (1 - h * h) * scale[:, None]
                g_bias[...], g_out[...], g_out_bias[...] = back.sum(0), (h * scale[:, None]).T @ z, scale @ z
                # sums of back by place and class
                g_embed[...] = 0
                np.add.at(pairs, pair_of.take(place + np.stack(sides), 0).ravel(), np.broadcast_to(back, (len(place), *back.shape)).ravel().view(np.complex64))
                t += 1
                np.subtract(grad, first, out=part)
                part *= 0.1
                first += part
                grad *= grad
                grad -= second
                grad *= 0.001
                second += grad
                np.sqrt(second, out=part)
                part *= 1 / np.sqrt(1 - 0.999**t)
                part += 1e-8
                np.divide(first, part, out=part)
                part *= RATE / (1 - 0.9**t)
                flat -= part
                if t % 64 == 0:
                    # decayed so far that a step no longer moves a weight; as denormal numbers they would cost many times as much
                    first[np.abs(first) < 1e-25] = 0

    def _views(self, flat: np.ndarray) -> list[np.ndarray]:
        """The parts of an array of weights() in their shapes."""
        at, out = 0, []
        for name in ("embed", "bias", "out", "out_bias"):
            old = getattr(self, name)
            out.append(flat[at : at + old.size].reshape(old.shape))
            at += old.size
        return out


def _joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Class sequences with edges between them, and the places of their tokens."""
    padded = [Network.padded(r) for r in rows]
    starts = np.cumsum([0, *(len(p) for p in padded)])
    return np.concatenate(padded), np.concatenate([np.arange(a + WINDOW, a + len(p) - WINDOW) for a, p in zip(starts, padded, strict=False)])


class _Endings(dict):
    """Class and log share of the words not broadcast, by their last two letters."""

    def __init__(self, shares):
        super().__init__()
        self.shares = list(shares)

    def __missing__(self, end: str) -> tuple[int, float]:
        c = _tail(end)
        self[end] = found = (HEAD + TAIL + c, self.shares[c])
        return found


class Coder:
    """Classes of words, and the part of their log shares that needs no counts but the broadcast ones."""

    def __init__(self, words: list[tuple[str, int]], mass_all: dict[int, int]):
        """words: those broadcast, by falling count; mass_all: tokens of the whole corpus by _tail."""
        self.word: dict[str, tuple[int, float]] = {}
        mass, rare = np.zeros(CLASSES), [mass_all.get(c, 0) for c in range(TAIL)]
        for r, (w, n) in enumerate(words):
            mass[r if r < HEAD else HEAD + _tail(w)] += n
            rare[_tail(w)] -= n
        for r, (w, n) in enumerate(words):
            c = r if r < HEAD else HEAD + _tail(w)
            self.word[w] = (c, float(np.log(n / mass[c])))
        #: With one token more, for words never counted.
        self.rare = _Endings(-float(np.log(m + 1)) for m in rare)

    def code(self, w: str) -> tuple[int, float]:
        """Class and log share of a word; for one not broadcast the logarithm of its count is still to be added."""
        return self.word.get(w) or self.rare[w[-2:]]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, float, list[str]]]:
        """(classes, sum of the log shares of code(), words not broadcast) of each text."""
        known = Numbers()
        rows = [np.array(list(map(known.__getitem__, t.lower().split())), np.int64) for t in texts]
        names, pairs = list(known), [self.code(w) for w in known]
        classes, within = np.array([c for c, _ in pairs], np.uint8), np.array([x for _, x in pairs], np.float64)
        return [(classes[r], float(within[r].sum()), [names[k] for k in r[classes[r] >= HEAD + TAIL]]) for r in rows]


def _network_sums(network: Network, rows: list[np.ndarray]) -> list[float]:
    """Sum of the log-probabilities of each class sequence."""
    full = [r for r in rows if len(r)]
    if not full:
        return [0.0] * len(rows)
    logs = network.log_prob(*_joined(full))
    sums = iter(np.add.reduceat(logs, np.cumsum([0, *(len(r) for r in full[:-1])])))
    return [float(next(sums)) if len(r) else 0.0 for r in rows]


class Model:
    def __init__(self, coder: Coder, counts: DataFrame):
        """counts: (word, n) of all words, on the shared folder."""
        self.coder, self.counts, self.network = coder, counts, Network()
        #: The documents it was trained on and encode() of them.
        self.seen: tuple[DataFrame, DataFrame] | None = None

    def fit(self, texts: list[str]) -> None:
        rows = [c.astype(np.int64) for c, _, _ in self.coder.encode(texts) if len(c)]
        if rows:
            self.network.train(*_joined(rows))

    def score(self, texts: list[str]) -> list[tuple[int, float]]:
        """(tokens, log-likelihood) of each of a few texts."""
        coded = self.coder.encode(texts)
        asked = sorted({w for _, _, rare in coded for w in rare})
        found = self.counts.join(self.counts.sparkSession.createDataFrame([(w,) for w in asked], "word string"), "word").collect() if asked else []
        n = {r.word: r.n for r in found}
        sums = _network_sums(self.network, [c.astype(np.int64) for c, _, _ in coded])
        return [(len(c), x + within + float(sum(np.log(n.get(w, 1)) for w in rare))) for (c, within, rare), x in zip(coded, sums, strict=True)]


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) over all documents."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 4000):
                c: Counter[str] = Counter()
                for t in b.column(0).slice(a, 4000).to_pylist():
                    c.update((t or "").lower().split())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    return documents.select("text").mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode(documents: DataFrame, coder: Coder) -> DataFrame:
    """row, doc_id, classes (a byte a token), within and rare, as Coder.encode gives them; row tells apart rows of one doc_id."""
    shared = documents.sparkSession.sparkContext.broadcast(coder)

    def run(batches):
        m = shared.value
        for b in batches:
            for a in range(0, b.num_rows, 500):
                got = m.encode([t or "" for t in b.column(2).slice(a, 500).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, 500), b.column(1).slice(a, 500), pa.array([c.tobytes() for c, _, _ in got], pa.binary()), pa.array([x for _, x, _ in got], pa.float64()), pa.array([w for _, _, w in got], pa.list_(pa.string()))],
                    ["row", "doc_id", "classes", "within", "rare"],
                )

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lean(run), "row long, doc_id long, classes binary, within double, rare array<string>")


def _pass(encoded: DataFrame, network: Network, shards: int, seed: int) -> None:
    """One pass of training over all rows: every shard from the network's weights, then their average by tokens."""
    shared = encoded.sparkSession.sparkContext.broadcast(network.weights())

    def fit(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "classes"])
        mine = Network()
        mine.set_weights(shared.value)
        padded, where = _joined([np.frombuffer(c, np.uint8) for c in group.classes])
        mine.train(padded, where, 1, seed + key[0])
        return pd.DataFrame({"shard": [key[0]], "n": [len(where)], "w": [(mine.weights().astype(np.float64) * len(where)).tobytes()]})

    def add(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        w = np.zeros(len(shared.value))
        for x in group.w:
            w += np.frombuffer(x, np.float64)
        return pd.DataFrame({"part": [key[0]], "n": [group.n.sum()], "w": [w.tobytes()]})

    rows = encoded.where(F.length("classes") > 0).select("doc_id", "classes", F.pmod(F.xxhash64("doc_id", "classes"), F.lit(shards)).alias("shard"))
    fitted = rows.groupBy("shard").applyInPandas(fit, "shard long, n long, w binary").withColumn("part", F.col("shard") % SUMS)
    sums = sorted(fitted.groupBy("part").applyInPandas(add, "part long, n long, w binary").collect())
    if sums:
        network.set_weights(sum(np.frombuffer(r.w, np.float64) for r in sums) / sum(r.n for r in sums))


def train(documents: DataFrame, sample_texts: int = SAMPLE_TEXTS, passes: int = PASSES) -> Model:
    """Counts of all words from all documents; the network from a bounded sample of them and then from all."""
    counts = materialize(word_counts(documents), "counts")
    tail = (F.crc32(F.encode(F.right("word", F.lit(2)), "utf-8")) % TAIL).alias("c")
    mass = {r.c: r.n for r in counts.groupBy(tail).agg(F.sum("n").alias("n")).collect()}
    words = sorted(((r.word, r.n) for r in most_counted(counts, "n", VOCABULARY).collect()), key=lambda x: (-x[1], x[0]))
    model = Model(Coder(words, mass), counts)
    rows = documents.where(F.col("doc_id").isNotNull() & (F.length("text").between(1, SAMPLE_CHARS)))
    rate = min(1.0, sample_texts / max(rows.select("doc_id").count(), 1))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20)).select("doc_id", "text")
    model.fit([r.text for r in sorted(chosen.collect())])
    encoded = materialize(encode(documents, model.coder), "encoded")
    for k in range(passes):
        _pass(encoded, model.network, -(-sum(mass.values()) // SHARD_TOKENS) or 1, SEED + 1 + k)
    model.seen = documents, encoded
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and mean_log_prob (per token) of every document."""
    encoded = model.seen[1] if model.seen and model.seen[0] is documents else materialize(encode(documents, model.coder), "encoded")
    shared = documents.sparkSession.sparkContext.broadcast(model.network)

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 500):
                rows = [np.frombuffer(c, np.uint8).astype(np.int64) for c in b.column(2).slice(a, 500).to_pylist()]
                sums = _network_sums(shared.value, rows) + b.column(3).slice(a, 500).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, 500), b.column(1).slice(a, 500), pa.array([len(r) for r in rows], pa.int64()), pa.array(sums, pa.float64())], ["row", "doc_id", "n_tokens", "x"])

    plain = encoded.select("row", "doc_id", "classes", "within").mapInArrow(lean(run), "row long, doc_id long, n_tokens long, x double")
    rare = encoded.select("row", F.explode("rare").alias("word")).join(model.counts, "word").groupBy("row").agg(F.sum(F.log("n")).alias("rare"))
    total = F.col("x") + F.coalesce("rare", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).otherwise(0.0)
    return plain.join(rare, "row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"), mean.alias("mean_log_prob"))
