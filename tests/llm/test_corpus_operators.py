import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from asofkit.llm import ann, bpe, common, fingerprint, language_id, masked_lm, ngram_jaccard, packing, substring_dedup, toxicity, url_rules
from asofkit.llm.language_id import held_out
from asofkit.llm.parameters import bpe_json, bpe_ranks, split_pattern, unigram_vocabulary
from asofkit.llm.queries import ORACLE, QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept int, score string"


def frame(spark, texts, start=0):
    """Documents with columns whose names clash with those that operators add."""
    return spark.createDataFrame([(start + i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", "s", 0, "x", 1, "y") for i, t in enumerate(texts)], SCHEMA)


def prose(seed, n, words=300):
    rng = np.random.Generator(np.random.PCG64(seed))
    return [f"w{k}" for k in rng.integers(0, words, n)]


def edge_texts():
    return [None, "", " \n\t ", "one", "one", "a b c d", "é中 １²", "x" * 3000, " ".join(prose(1, 4000)), (5, "one"), (None, "null id"), (None, None)]


def linked_by_force(rows, percent=75):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n, seed=3):
    """Copies of one text with many kinds of edits, some too far to link, and others that share a passage only."""
    rng = np.random.Generator(np.random.PCG64(seed))
    base, out = prose(2, 120, 5000), []
    for i in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(0, len(w)))] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
        if i % 3 == 0:
            out.append(" ".join([*base[:40], *prose(100 + i, 80, 5000)]))
        if i % 10 == 0:
            out.append(" ".join(base).upper())
    return out


def test_ngram_links_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SMALL", 8)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 50)
    texts = [*near_copies(150), None, "", "one two", "One TWO", *[" ".join(prose(k, 30, 40)) for k in range(30)]]
    docs = frame(spark, texts)
    want = linked_by_force(list(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.link_documents(docs).collect()}
    assert got == want


def test_ngram_edges(spark):
    got = ngram_jaccard.link_documents(frame(spark, edge_texts())).collect()
    assert len(got) == len(edge_texts())
    assert {r.component_id for r in got if r.doc_id in (3, 4)} == {3}
    assert ngram_jaccard.link_documents(frame(spark, []).limit(0)).count() == 0


def test_repeats_are_those_of_brute_force(spark):
    shared = " ".join(prose(9, 60, 9999))
    texts = [*near_copies(40), *[f"{' '.join(prose(k, 20, 9999))} {shared} {' '.join(prose(-k + 99, 9, 9999))}" for k in range(20)], None, "", "short one"]
    docs = frame(spark, texts)
    want = substring_dedup.reference(list(enumerate(texts)))
    for batches in (1, 2, 5):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(substring_dedup.remove_repeats(docs, batches=batches)).collect()}
        assert got == want


def test_repeats_edges(spark):
    assert substring_dedup.remove_repeats(frame(spark, edge_texts())).count() == len(edge_texts())
    assert substring_dedup.remove_repeats(frame(spark, []).limit(0)).count() == 0


def test_index_compacts_and_finds_history(spark):
    index = substring_dedup.WindowIndex(fanout=2)
    text = " ".join(prose(5, 40, 9999))
    assert index.append(frame(spark, [text])).count() == 0
    assert index.append(frame(spark, [" ".join(prose(6, 40, 9999))], 10)).count() == 0
    assert len(index.runs()) == 1
    assert index.append(frame(spark, [text], 20)).count() > 0


def test_index_goes_on_in_a_second_session(spark, tmp_path):
    folder, text, other = str(tmp_path), " ".join(prose(5, 40, 9999)), " ".join(prose(6, 40, 9999))
    index = substring_dedup.WindowIndex(folder=folder)
    assert index.append(frame(spark, [text])).count() == 0
    again = substring_dedup.WindowIndex.load(spark.newSession(), folder)
    assert [len(x) for x in again.levels] == [1] and again.append(frame(spark, [other], 10)).count() == 0
    third = substring_dedup.WindowIndex.load(spark, folder)
    assert [len(x) for x in third.levels] == [0, 1]
    assert third.append(frame(spark, [text], 20)).count() > 0
    # what an append writes before it dies is not part of the index
    broken = substring_dedup.WindowIndex.load(spark, folder)
    broken._written(substring_dedup.fingerprints(frame(spark, [other], 30).select("doc_id", "text"), 13, 4).withColumns({"first": F.col("doc_id"), "last": F.col("doc_id")}), 0)
    assert substring_dedup.WindowIndex.load(spark, folder).paths == third.paths
    assert substring_dedup.WindowIndex.load(spark, folder).append(frame(spark, []).limit(0)).count() == 0


def test_fragments_cut_the_global_order(spark):
    texts = [*near_copies(30), None, "one two"]
    often = np.array([], np.uint64)
    every = [s for _, s in ngram_jaccard.sets_of(__import__("pyarrow").array([t or "" for t in texts]), 5)]
    often = np.unique(np.concatenate(every))[::7]
    docs = frame(spark, texts)
    pairs = spark.createDataFrame([(i, j) for i in range(0, len(texts), 3) for j in range(i + 1, len(texts), 4)], "a long, b long")
    got = {(r.a, r.b): r.overlap for r in ngram_jaccard.overlaps(pairs, docs, 5, often).collect()}
    for r in pairs.collect():
        assert got.get((r.a, r.b), 0) == len(np.intersect1d(every[r.a], every[r.b]))
    parts = {r.fragment for r in ngram_jaccard._fragments(docs, 5, often).collect()}
    assert parts == set(range(ngram_jaccard.FRAGMENTS + 1))


def test_frequent_grams_are_counted_over_all_documents(spark):
    least = ngram_jaccard.LEAST
    texts = [f"{'a b c d e' if i < least + 5 else 'f g h i j' if i < 2 * least + 5 else 'k l m n o'} own{i}" for i in range(3 * least + 4)]
    hashes = [ngram_jaccard.frequent_grams(frame(spark, [t] * least), 5)[0] for t in ("f g h i j", "a b c d e")]
    assert ngram_jaccard.frequent_grams(frame(spark, texts), 5).tolist() == hashes  # k l m n o is held by one too few


def test_counted_grams_are_shuffled_packed(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "CUT_BITS", 3)
    monkeypatch.setattr(ngram_jaccard, "COUNTED", 500)
    texts = [" ".join(prose(k % 6, 200)) for k in range(40)]
    packed = ngram_jaccard.packed_grams(frame(spark, texts).repartition(2), 5)
    rows = packed.collect()
    assert len(rows) <= 8 * 2 * 12  # a row for each cut and count of a task, where a row for each n-gram would be over 1,000
    got = {}
    for r in rows:
        for h, c in zip(np.frombuffer(r.grams, "<u8").tolist(), np.frombuffer(r.counts, "<u4").tolist(), strict=True):
            assert h >> 61 == r.cut
            got[h] = got.get(h, 0) + c
    monkeypatch.setattr(ngram_jaccard, "LEAST", 7)
    want = {}
    for t in texts:
        for g in {tuple(t.split()[k : k + 5]) for k in range(196)}:
            want[g] = want.get(g, 0) + 1
    assert sorted(got.values()) == sorted(want.values())
    assert set(ngram_jaccard.frequent_grams(frame(spark, texts), 5).tolist()) == {h for h, c in got.items() if c >= 7}


def test_bpe_is_tiktoken(spark):
    import tiktoken

    ranks = bpe.load_ranks(bpe_ranks())
    engine = tiktoken.Encoding("t", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})
    texts = [*edge_texts()[:9], "it's  two\n\n \x85x <|endoftext|>", "é" * 100, "a" * 500, "ab" * 90]
    docs = frame(spark, texts)
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in bpe.encode(docs, bpe_ranks(), split_pattern()).collect()}
    assert got == {i: (engine.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)}
    odd = [(None, "null id"), (None, None), (5, "one"), (5, "one"), (5, "two words")]
    rows = sorted(((r.doc_id, bytes(r.decoded), len(r.ids) // 4) for r in bpe.encode(frame(spark, odd), bpe_ranks(), split_pattern()).collect()), key=str)
    assert rows == sorted(((i, (t or "").encode(), len(engine.encode_ordinary(t or ""))) for i, t in odd), key=str)
    assert bpe.digest(bpe.encode(frame(spark, []).limit(0), bpe_ranks(), split_pattern())).count() == 0
    row = bpe.digest(bpe.encode(docs, bpe_ranks(), split_pattern())).where("doc_id = 3").first()
    assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, engine.encode_ordinary("one"))).encode()).hexdigest()


def test_bpe_words_of_several_blocks_are_merged_once(spark, monkeypatch):
    import tiktoken

    monkeypatch.setattr(bpe, "BLOCK_CHARS", 200)
    texts = [" ".join(f"zq{k}xv{i // 2 if k else i}" for k in range(8)) for i in range(60)]  # all but the first word in two documents
    docs, written = frame(spark, texts).repartition(4, "doc_id"), []
    keep = bpe.materialize
    monkeypatch.setattr(bpe, "materialize", lambda df, name, *a: written.append((name, keep(df, name, *a))) or written[-1][1])
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(docs, bpe_ranks(), split_pattern()).collect()}
    engine = tiktoken.Encoding("t", pat_str=split_pattern(), mergeable_ranks=bpe.load_ranks(bpe_ranks()), special_tokens={})
    assert got == {i: engine.encode_ordinary(t) for i, t in enumerate(texts)}
    rare = [w for r in dict(written)["blocks"].collect() for w in r.rare]
    assert len(rare) == len(set(rare))  # a word that two blocks hold is among the common ones
    assert bpe.COMMON > 1_000_000


def test_positions_hold_the_word_itself():
    import pyarrow as pa

    words = pa.array(["a", "bb", "", "é", "ccc"])
    hashes = common.string_hashes(words)
    order = np.argsort(hashes)
    words = words.take(pa.array(order))
    asked = pa.array(["é", "zz", "", "ccc", "a", "b"])
    at = bpe.positions(hashes[order], words, asked)
    assert [words[int(k)].as_py() if k >= 0 else None for k in at] == ["é", None, "", "ccc", "a", None]
    assert bpe.positions(hashes[:0], words.slice(0, 0), asked).tolist() == [-1] * 6
    # one hash for all: only the word that stands there is found
    assert bpe.positions(hashes[order], pa.array(["other"] * 5), asked).tolist() == [-1] * 6


def test_packing_ids_and_places(spark):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(bpe_json())
    path, pattern = bpe_json(), split_pattern()
    texts = [*edge_texts(), "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", " ".join(prose(7, 700)), " ".join(prose(8, 700))]
    docs = frame(spark, texts)
    want = sorted((i if not isinstance(t, tuple) else t[0], tuple([*exact.encode((t[1] if isinstance(t, tuple) else t) or "", add_special_tokens=False).ids, 0])) for i, t in enumerate(texts) if not isinstance(t, tuple) or t[0] is not None)
    cut = packing.pieces(docs, lambda: packing.Encoder(path, pattern), 512).cache()
    for shard_docs in (10**6, 4):
        got = packing.pack(cut, docs.count(), 512, shard_docs).toPandas()
        assert len(got) == cut.count() and got.doc_id.isna().sum() == 2
        # each document is there as often as it comes, with all its ids; pieces of rows that repeat a doc_id differ by length
        assert got[got.piece == 0].doc_id.dropna().astype(int).tolist().count(5) == 2
        for i, ids in want:
            if i == 5:
                continue
            mine = got[got.doc_id == i].sort_values("piece")
            assert mine.length.sum() == len(ids) and (mine.length <= 512).all() and (mine.length.iloc[1:] == 512).all()
            for p in mine.itertuples():
                assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert (s.offset.to_numpy() == np.concatenate([[0], np.cumsum(s.length)[:-1]])).all() and s.length.sum() <= 512
    assert packing.pack(packing.pieces(docs.limit(0), lambda: packing.Encoder(path, pattern)), 0).count() == 0


def packed_by_force(lengths, limit):
    """Lengths of each bin's items by the rule itself, over plain lists."""
    left, bins = list(lengths), []
    while left:
        mine = [max(left)]
        left.remove(mine[0])
        while True:
            while fits := [x for x in left if x <= limit - sum(mine)]:
                mine.append(max(fits))
                left.remove(max(fits))
            gap, small = limit - sum(mine), min(mine)
            pairs = [(x + y, max(x, y), min(x, y)) for i, x in enumerate(left) for y in left[i + 1 :] if small < x + y <= gap + small]
            if not gap or not pairs:
                break
            _, x, y = max(pairs)
            mine.remove(small)
            left.remove(x)
            left.remove(y)
            mine += [x, y]
            left.append(small)
        bins.append(sorted(mine))
    return sorted(bins)


def test_best_two_fit_follows_the_rule():
    for seed in range(40):
        rng = np.random.Generator(np.random.PCG64(seed))
        lengths = rng.integers(1, [8, 25, 60][seed % 3], int(rng.integers(0, 40)))
        limit = [12, 40, 60][seed % 3]
        where, _ = packing.best_two_fit(lengths, limit)
        assert sorted(sorted(lengths[where == b].tolist()) for b in range(where.max() + 1 if len(where) else 0)) == packed_by_force(lengths.tolist(), limit)


def test_best_two_fit_is_tight():
    rng = np.random.Generator(np.random.PCG64(1))
    lengths = np.minimum(2048, rng.lognormal(6, 1, 5000).astype(int) + 1)
    where, offset = packing.best_two_fit(lengths)
    used = np.bincount(where, lengths)
    assert used.max() <= 2048 and len(used) <= lengths.sum() / 2048 * 1.01 + 1
    assert packing.best_two_fit(np.zeros(0, int))[0].size == 0


def test_fingerprints(spark):
    rows = [(i, t) for i, t in enumerate([*near_copies(20), None, "", "one"])]
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, [t for _, t in rows])).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    assert fingerprint.fingerprints(frame(spark, edge_texts())).count() == len(edge_texts())
    assert fingerprint.fingerprints(frame(spark, []).limit(0)).count() == 0


def test_short_texts_have_a_likeness(spark):
    texts = [" ".join(prose(50 + k // 2, 9) + [f"end{k % 2}"]) for k in range(40)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, texts)).collect()}
    for k in range(1, 40, 2):  # 5 of 6 shingles are those of the document that follows
        assert abs(got[k].near_next - 5 / 6) < 1e-9, (k, got[k].near_next)
    assert 0 in {got[k].near_next for k in range(0, 40, 2)}


def test_sketch_of_union_is_union_of_sketches(spark):
    a, b = " ".join(prose(1, 400)), " ".join(prose(2, 50))
    r = spark.sql("select 1").select(fingerprint.merge(fingerprint.sketch(F.lit(a)), fingerprint.sketch(F.lit(b))).alias("u"), fingerprint.sketch(F.lit(a)).alias("a")).first()
    assert set(r.a) <= set(r.u) and len(r.a) > 20


def test_neighbours_are_mostly_exact(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    x = rng.normal(size=(2000, 64))
    x[500:1100] = x[500]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(3000, None, 0), (3001, [0.0] * 64, 0), (3002, [float("nan")] * 64, 0), (3003, [1.0, 2.0], 0), (3004, [], 0), (None, [1.0] * 64, 0)]
    got = ann.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int"), F.pmod("vec_id", F.lit(50)) == 0).toPandas()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q, g in got.groupby("query_id"):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        hit += len(set(np.lexsort((np.arange(len(s)), -s))[:5]) & set(g.vec_id))
        assert list(g.sort_values("rank")["rank"]) == [1, 2, 3, 4, 5]
    assert hit / (40 * 5) >= 0.9
    assert ann.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, rank int"), F.pmod("vec_id", F.lit(50)) == 0).count() == 2


def test_neighbours_do_not_depend_on_input_size(spark, monkeypatch):
    x = np.random.Generator(np.random.PCG64(5)).normal(size=(2000, 64))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    find = lambda: sorted(ann.search(rows, F.pmod("vec_id", F.lit(50)) == 0).collect())
    whole = find()
    # 2,000 vectors are then as far past CELL_ROWS a cell as 2.56 million are past 20,000
    monkeypatch.setattr(ann, "CELL_ROWS", 15)
    assert find() == whole and len(whole) == 200


def test_tied_neighbours_come_by_id(spark):
    rng = np.random.Generator(np.random.PCG64(14))
    x = rng.normal(size=(300, 16))
    x[20:200] = x[0]  # 181 equal vectors: more ties than a cell may hand on
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(7, [float(v) for v in x[7]])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(rows, F.pmod("vec_id", F.lit(50)) == 0).collect()}
    assert [got[0, k][0] for k in range(1, 6)] == [20, 21, 22, 23, 24] and [got[50, k][0] for k in range(1, 6)] == [0, 20, 21, 22, 23]
    assert all(abs(got[0, k][1] - 1) < 1e-12 for k in range(1, 6))
    assert ann.search(rows.limit(0), F.pmod("vec_id", F.lit(50)) == 0).count() == 0


def test_url_rules(spark):
    urls = ["http://A.net/x", "http://x.example.net/en/1", "http://example.com/de/1?q#f", "https://b.org/fr/", "http://c.net", None, "no scheme", "http://other.com/en/", "http://a.net/x", "http://net/", "http://notnet/"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(0, "http://A.net/x", "z")], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_rules.judge(pages, URL_RULES).collect()}
    assert [got[i].rule for i in range(11)] == ["net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None, "net/", "net/", None]
    assert (got[0].host, got[0].path, got[5].host, got[2].path) == ("a.net", "/x", "", "/de/1")
    assert got[6].verdict == "allow" and url_rules.judge(pages, URL_RULES).count() == 12
    assert url_rules.judge(pages.limit(0), URL_RULES).count() == 0


def test_mined_rules_are_pruned_and_decide(spark):
    rows = [(["a", "b"], "block")] * 40 + [(["a"], "allow")] * 20 + [(["c"], "allow")] * 40 + [(["b", "c"], "block")] * 10
    rules = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.8).collect()
    assert {(tuple(r.tokens), r.verdict) for r in rules} == {(("b",), "block"), (("c",), "allow")}


def test_language_and_toxicity_hold_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = language_id.train(docs.where(~held_out()), unigram_vocabulary(), 300)
    out = language_id.identify(docs.where(held_out()).limit(1500), model)
    assert out.where("lang = lang_pred").count() >= 0.99 * out.count()
    tox = toxicity.train(docs, labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label")))
    got = toxicity.score(docs.where(held_out()).join(labels, "doc_id"), tox).toPandas()
    assert got[got.toxic == 1].predicted.mean() >= 0.9 and got[got.toxic == 0].predicted.mean() <= 0.02
    edges = language_id.identify(frame(spark, edge_texts()), model).collect()
    assert {r.lang_pred for r in edges if not r.text or not r.text.strip()} == {"und"}
    assert toxicity.score(frame(spark, edge_texts()), tox).count() == len(edge_texts())
    none = language_id.train(docs.limit(0), unigram_vocabulary())
    assert language_id.identify(frame(spark, ["word"]), none).first().lang_pred == "und"
    assert toxicity.train(docs.limit(0), labels.select("doc_id", F.col("toxic").alias("label")).limit(0)).score("x") == (0.0, [])


def test_language_of_long_texts_is_learned(spark):
    long, short = " ".join(["zug", "weg", "tag", "berg"] * 2000), "rue eau feu lieu"
    run = "k" * 48 + "zyx" * 8
    rows = [(i, long, "de") for i in range(3)] + [(10 + i, short, "fr") for i in range(3)] + [(20 + i, run, "xx") for i in range(3)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), unigram_vocabulary())
    asked = frame(spark, ["zug tag weg", "eau feu", "zyxzyxzyx"])
    assert {r.doc_id: r.lang_pred for r in language_id.identify(asked, model).collect()} == {0: "de", 1: "fr", 2: "xx"}


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "▁", "▁a"]
    prob = np.array([[0.2], [0.1], [0.3], [0.15], [0.25], [1e-7]])
    got = np.exp(language_id.word_logs(["ab"], language_id.Pieces(pieces), prob))[0, 0]
    by_hand = 0.15 * 0.2 * 0.1 + 0.15 * 0.3 + 0.25 * 0.1
    assert got == pytest.approx(by_hand, rel=1e-4)


def every_segmentation(word, pieces, prob):
    """Sum over all segmentations by exact fractions, a character by itself also as an unknown one."""
    from fractions import Fraction

    text, sums = language_id.MARK + word, [Fraction(1)]
    for j in range(1, len(text) + 1):
        sums.append(sum((sums[k] * Fraction(prob[pieces.index(text[k:j])]) for k in range(j) if text[k:j] in pieces), sums[j - 1] * Fraction(prob[-1])))
    return sums[-1]


def test_forward_over_long_words():
    from fractions import Fraction

    pieces, rng = ["a", "b", "ab", "ba", "abab", "aabbaabbaabb", "▁", "▁a"], np.random.Generator(np.random.PCG64(6))
    prob = np.concatenate([rng.random(8) / 50, [1e-7]])
    for n in (1, 5, 24, 25, 49, 200, 900):
        for letters in ("ab", "abx", "x"):
            word = "".join(rng.choice(list(letters), n))
            want = every_segmentation(word, pieces, prob.tolist())
            log = float(np.log(float(want * Fraction(10) ** (8 * n)))) - 8 * n * np.log(10) if n < 36 else None
            got = language_id.word_logs([word], language_id.Pieces(pieces), np.stack([prob, prob], 1))[0]
            if log is None:
                log = (want.numerator.bit_length() - want.denominator.bit_length()) * np.log(2)
                assert abs(got[0] - log) < 1.5
            else:
                assert got[0] == pytest.approx(log, rel=1e-9)
            assert np.isfinite(got).all() and got[0] == got[1]


def test_fit_counts_long_and_short_words_alike():
    pieces = ["a", "b", "ab", "▁"]
    names, once = language_id.fit({"x": {"ab" * 10: 3}}, pieces)
    _, twice = language_id.fit({"x": {"ab" * 60: 3}}, pieces)
    assert names == ["x"] and np.isfinite(twice).all() and twice[2, 0] > twice[0, 0] and once[2, 0] > once[0, 0]


def test_language_scores_are_finite(spark):
    rows = [(0, "zug weg tag", "de"), (1, "rue eau feu", "fr"), (2, "rue eau feu", "fr"), (3, "abc", None), (4, None, "de")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), unigram_vocabulary())
    texts = ["ᏣᎳᎩ" * 16, "x" * 3000, "é" * 500, "zug", "zug", "１２", "zug rue zug rue"]
    got = {r.doc_id: r for r in language_id.identify(frame(spark, texts), model).collect()}
    assert all(0 <= got[i].score <= 1 for i in range(len(texts))) and got[3].lang_pred == "de" and got[3].score == got[4].score
    assert (got[5].lang_pred, got[5].score) == ("und", 0.0)
    # languages learned from the same texts tie: the smaller name is taken
    both = language_id.train(spark.createDataFrame([(0, "zug weg", "b"), (1, "zug weg", "a")], "doc_id long, text string, lang string"), unigram_vocabulary())
    assert language_id.identify(frame(spark, ["zug"]), both).first().lang_pred == "a"


def test_block_max_index_is_exact():
    rng = np.random.Generator(np.random.PCG64(2))
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(40, 5, replace=False))
        w = rng.random(5)
        vectors.append((t, w / np.sqrt(w @ w)))
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = toxicity.BlockMaxIndex(vectors, 40)
    for i in range(0, 500, 25):
        s = np.round(dense @ dense[i], 12)
        want = [j for j in np.lexsort((np.arange(500), -s))[:10] if s[j] > 0]
        assert [j for _, j in index.nearest(*vectors[i], 10)] == want


def test_masked_lm_prefers_real_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = masked_lm.train(docs)
    texts = [r.text for r in docs.limit(100).collect()]
    rng = np.random.Generator(np.random.PCG64(3))
    mean = lambda x: sum(v for _, v in x) / sum(n for n, _ in x)
    assert mean(model.score(texts)) > mean(model.score([" ".join(rng.permutation(t.split())) for t in texts])) + 0.05
    got = {r.doc_id: r for r in masked_lm.score(frame(spark, ["", None, "one"]), model).collect()}
    assert (got[0].n_tokens, got[1].log_likelihood, got[2].n_tokens) == (0, 0.0, 1)
    assert masked_lm.score(docs.limit(0), masked_lm.train(docs.limit(0))).count() == 0


def test_masked_lm_counts_every_word(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "VOCABULARY", 5)
    monkeypatch.setattr(masked_lm, "SAMPLE_TEXTS", 3)
    letters = "abcdefghij"
    often, once = [f"{a}{b}zz" for a in letters for b in letters], [f"q{a}{b}zz" for a in letters for b in letters]
    texts = ["t u v w x " * 200] + [f"t {a} u" for a in often for _ in range(4)] + [f"t {a} u" for a in once]
    docs = frame(spark, texts)
    model = masked_lm.train(docs)
    got = {r.doc_id: r for r in masked_lm.score(docs, model).collect()}
    assert len(got) == len(texts)
    # both words have the class of the ending "zz", past the broadcast ones: only their counts, 4 and 1, tell them apart
    assert abs(got[1].log_likelihood - got[401].log_likelihood - np.log(4)) < 1e-6
    for i, (n, x) in zip((0, 1, 401), model.score([texts[0], texts[1], texts[401]]), strict=True):
        assert n == got[i].n_tokens and abs(x - got[i].log_likelihood) < 1e-6


def test_masked_lm_trains_on_long_texts(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "SHARD_TOKENS", 20_000)
    docs = frame(spark, ["a b c d e f " * 2000 for _ in range(4)] + ["z"])
    model = masked_lm.train(docs)
    # within the repeated run every word follows from its neighbours
    n, x = model.score(["a b c d e f " * 100])[0]
    assert x / n > -0.5


def test_masked_lm_step_is_adam_on_the_gradient():
    """One step, and the log-probabilities, against plain sums in double precision; a decayed moment doesn't stay as a denormal number."""
    rng = np.random.Generator(np.random.PCG64(5))
    net, start = masked_lm.Network(), masked_lm.Network()
    padded, where = masked_lm._joined([rng.integers(0, 40, k).astype(np.uint8) for k in (1, 30, 200)])
    embed, bias, out, out_bias = (np.float64(getattr(start, k)) for k in ("embed", "bias", "out", "out_bias"))
    sides = np.stack([padded[where + k] for k in start.places])
    h = np.tanh(bias + sum(embed[p][s] for p, s in enumerate(sides)))
    z = h @ out + out_bias
    log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(start.log_prob(padded, where), log_p[np.arange(len(where)), padded[where]], atol=1e-5)
    d = np.exp(log_p)
    d[np.arange(len(where)), padded[where]] -= 1
    d /= len(where)
    back = (d @ out.T) * (1 - h * h)
    g_embed = np.zeros_like(embed)
    for p, s in enumerate(sides):
        np.add.at(g_embed[p], s, back)
    net.train(padded, where, 1)
    for g, k in ((g_embed, "embed"), (back.sum(0), "bias"), (h.T @ d, "out"), (d.sum(0), "out_bias")):
        step = masked_lm.RATE * g / (np.abs(g) + 1e-8)
        sure = (np.abs(g) > 1e-6) | (g == 0)
        assert np.allclose((getattr(start, k) - getattr(net, k))[sure], step[sure], atol=masked_lm.RATE * 0.03)
    big = np.full((2, masked_lm.CLASSES), 500, np.float32)
    big[1] = -500
    shift, total = masked_lm.Network.exp_sums(big)
    assert np.allclose(shift + np.log(total), np.array([500, -500]) + np.log(masked_lm.CLASSES))


def test_components(spark):
    rng = np.random.Generator(np.random.PCG64(8))
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if n != r}


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, common.materialize(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count()
        if name == "ngram_jaccard":
            force = linked_by_force([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in force.items() if c == i}
        if name == "substring_dedup":
            force = substring_dedup.reference([(r.doc_id, r.text) for r in before.collect()])
            want = {i: sha for i, (n, gone, sha) in force.items() if gone < n or not n}
            got = {r.doc_id: hashlib.sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest() for r in kept.collect()}
            assert got == want
    last = corpus_pipeline.run(spark, SF)
    assert last.select("doc_id").distinct().count() == kept.count()


def test_stages_take_odd_rows(spark):
    """Nulls in any column, repeated and null ids, empty texts and an empty table, in every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = docs.orderBy("doc_id").limit(3).collect()
    odd = [(None, None, None, None, None), (None, whole[0].text, "en", None, 1), (10**9, "", "en", "s", 0), (10**9, None, "de", "s", None), (10**9 + 1, whole[1].text, None, "s", 5), (10**9 + 1, whole[1].text, None, "s", 5), (10**9 + 2, "word " * 3000, "en", "s", 15000)]
    rows = spark.createDataFrame([tuple(r) for r in whole] + odd, docs.schema).withColumn("score", F.lit("clash"))
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.toxic(spark, rows, SF).where("text is null or text = ''").count() == 3
    near = corpus_pipeline.near_duplicates(spark, rows, SF)
    assert near.columns == plain and near.where(f"doc_id = {10**9 + 1}").count() == 0 and near.where("doc_id is null").count() == 2
    cut = corpus_pipeline.repeated_passages(spark, rows, SF)
    assert cut.columns == plain and {r.doc_id for r in cut.collect()} >= {r.doc_id for r in whole} | {None, 10**9}
    packed = corpus_pipeline.packed(spark, rows, SF).toPandas()
    assert (packed.piece == 0).sum() == rows.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0 and name.startswith("op")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = QUERIES[name](spark, sf)
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall())
