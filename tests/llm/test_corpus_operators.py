"""Encoding, packing, lengths, near duplicates, neighbours and the pipeline against brute force."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from revgraph.llm import bpe, jaccard, neighbours, packing, quality, queries, secrets, tokens, toxicity

ODD = [None, "", " ", "\n\n x", "a" * 3000, "naïve café 😀 don't  stop", "tab\there nbsp em", "\x1c\x1f", "x\0y", "12345 ١٢٣ ²³", "<|endoftext|>"]


def encoding(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path).ids, special_tokens={})


def fuzz(n, seed=5):
    rng = random.Random(seed)
    letters = "abz 'sstTHEthe\n\t\x1c\x85\xa0 éßж中😀1²٣.,!<|>_\0 "
    return ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(n)]


def test_encoder_against_the_library():
    for path in (queries.MULTI, queries.SINGLE):
        e, known = bpe.Encoder(path, public_tokenizers.PATTERN, limit=500), encoding(path)
        texts = [*filter(None, ODD), *fuzz(3000)]
        for text, ids in zip(texts, e.encode(texts, step=5000), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text), ascii(text)
            assert e.decode(ids) == text.encode()


def test_encoder_remembers_what_recurs(monkeypatch):
    # A full memory is replaced, but a word that occurs again and again is merged once.
    merged, real = [], bpe.merge_rows
    monkeypatch.setattr(bpe, "merge_rows", lambda words, *more: merged.extend(words) or real(words, *more))
    e = bpe.Encoder(queries.SINGLE, public_tokenizers.PATTERN, limit=40)
    for k in range(50):
        other = [f"q{chr(97 + k % 26)}x{chr(97 + k // 26)}zvk{chr(97 + i)}" for i in range(10)]
        list(e.encode([" ".join(["x", "qqzzvvkkxx", *other])]))
        assert len(e.known) + len(e.before) <= 80
    assert merged.count(b" qqzzvvkkxx") == 1


def test_encoder_merges_a_word_once_whatever_follows(monkeypatch):
    # A word of the older memory is taken over when marks follow it, too.
    merged, real = [], bpe.merge_rows
    monkeypatch.setattr(bpe, "merge_rows", lambda words, *more: merged.extend(words) or real(words, *more))
    e, known = bpe.Encoder(queries.SINGLE, public_tokenizers.PATTERN, limit=40), encoding(queries.SINGLE)
    others = " ".join(f"q{chr(97 + i)}xzvk" for i in range(25))
    for text in ("x qqzzvvkkxx " + others, "x qqzzvvkkxx.", "x " + others, "x qqzzvvkkxx&&& qqzzvvkkxx'*** qqzzvvkkxx's"):
        (ids,) = e.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text)
    assert merged.count(b" qqzzvvkkxx") == 2  # the last is cut at the pattern's 's


def test_encoder_learns_for_millions_of_characters_at_once(monkeypatch):
    # Words of a text that comes back after two others of half a million characters are merged once.
    rng = random.Random(3)
    texts = [" ".join(["x", *("".join(rng.choices("aeioubcdnrst", k=10)) for _ in range(60_000))]) for _ in range(3)] * 2
    merged, real = [], bpe.merge_rows
    monkeypatch.setattr(bpe, "merge_rows", lambda rows, *more: merged.extend(rows) or real(rows, *more))
    e, known = bpe.Encoder(queries.SINGLE, public_tokenizers.PATTERN, limit=1000), encoding(queries.SINGLE)
    got = list(e.encode(texts))
    assert len(merged) == len(set(merged))
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [*map(known.encode_ordinary, texts)]
    short = [x for k in range(200) for x in ("", texts[0][70 * k : 70 * k + 60])]
    for part in (1, 7, 100, 10**6):
        assert list(e.encode(short, part=part)) == list(bpe.Encoder(queries.SINGLE, public_tokenizers.PATTERN).encode(short))


def test_digests(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    known = encoding(queries.MULTI)
    got = {r.doc_id: r for r in tokens.bpe_digests(docs, queries.MULTI, queries.PATTERN).collect()}
    for i, text in enumerate(ODD):
        ids = known.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    row = tokens.bpe(docs, queries.MULTI, queries.PATTERN).where("doc_id = 5").first()
    assert bytes(row.decoded).decode() == ODD[5]
    assert tokens.bpe_digests(docs.limit(0), queries.MULTI, queries.PATTERN).count() == 0


def test_length_table(spark):
    rng = random.Random(1)
    lens = [rng.choice([0, 1, 5, 5, 1023, 1024, 3000, rng.randint(0, 5000)]) for _ in range(500)]
    made = tokens.length_table(spark.createDataFrame([(i, n) for i, n in enumerate(lens)], "doc_id long, n_tokens long"))
    got, known = made.collect(), sorted(set(lens))
    assert [r.n_tokens for r in sorted(got)] == known
    for r in got:
        n = r.n_tokens
        assert r.until == next((x for x in known if x > n), None)
        assert r.docs == lens.count(n)
        assert r.docs_from == sum(x >= n for x in lens)
        assert r.tokens_from == sum(x for x in lens if x >= n)
        assert r.truncated_tokens == sum(min(x, n) for x in lens)
        assert r.docs_cut == sum(x > n for x in lens)
        assert abs(r.share_to - sum(x <= n for x in lens) / 500) < 1e-12
    limits = [0, 2, 6, 1000, 1022, 1023, 2047, 2048, 4999, 9999]
    answers = {r.context_limit: r for r in tokens.for_limits(made, limits).collect()}
    assert sorted(answers) == limits
    for n, r in answers.items():
        assert (r.docs_cut, r.truncated_tokens) == (sum(x > n for x in lens), sum(min(x, n) for x in lens))
        assert abs(r.share_to - sum(x <= n for x in lens) / 500) < 1e-12
    some = tokens.length_table(spark.createDataFrame([(1, 7), (1, 7)], "doc_id long, n_tokens long"))
    assert [(r.context_limit, r.docs_cut, r.truncated_tokens) for r in tokens.for_limits(some, [3, 8]).orderBy("context_limit").collect()] == [(3, 2, 6), (8, 0, 14)]
    docs = spark.createDataFrame([(1, "a b", 1), (2, None, 2)], "doc_id long, text string, n_tokens int")
    assert {r.n_tokens for r in tokens.length_table(tokens.lengths(docs, queries.SINGLE, queries.PATTERN)).collect()} == {0, 2}
    assert tokens.length_table(tokens.lengths(docs.limit(0), queries.SINGLE, queries.PATTERN)).count() == 0


def check_packing(spark, texts):
    docs = spark.createDataFrame([(i, x, "p") for i, x in enumerate(texts)], "doc_id long, text string, class string").repartition(3)
    got = packing.pack(docs, queries.SINGLE, queries.PATTERN, packing.special_tokens(queries.SINGLE_JSON)).toPandas()
    known = Tokenizer.from_file(queries.SINGLE_JSON)
    ids = {i: np.array([*known.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in enumerate(texts)}
    taken = collections.Counter()
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        taken.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
    assert set(taken.values()) <= {1}
    assert len(taken) == sum(map(len, ids.values()))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all()
        assert s.length.sum() <= 2048
    return got


def test_packing(spark):
    rng = random.Random(2)
    texts = [*ODD, "a <|endoftext|>b<|endoftext|><|endoftext|> c <|endoftext|", "word " * 5000, *fuzz(200), *(" ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(0, 900))) for _ in range(300))]
    got = check_packing(spark, texts)
    assert got.length.sum() / (got.sequence_id.nunique() * 2048) > 0.95
    check_packing(spark, ["same text"] * 50)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), queries.SINGLE, queries.PATTERN).count() == 0


def test_patterns_cover_the_demand_near_the_bound():
    rng = np.random.default_rng(0)
    sizes = np.arange(1, 65)
    demand = rng.integers(0, 60, 64).astype(float)
    sizes, demand = sizes[demand > 0], demand[demand > 0]
    plan = packing.patterns(sizes, demand, 64)
    assert (sum(p * t for p, t in plan) == demand).all()
    assert all(p @ sizes <= 64 for p, _ in plan)
    assert sum(t for _, t in plan) <= 1.03 * (sizes @ demand) / 64 + 2


def brute_components(texts):
    sets = []
    for x in texts:
        w = (x or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        k = len(sets[i] & sets[j])
        if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
            a, b = sorted((top(i), top(j)))
            up[b] = a
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def near_texts(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = [None, "", " \n", "One two", "one TWO", "a b c d e", "a b c d e f", "A b c d e", "b c d e f a"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([8, 12, 20, 60, 200]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy[: len(copy) - rng.randint(0, 2)]))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(10, 90))) for _ in range(25)]
    texts += [" ".join(str(k) for k in range(n, n + 10)) for n in range(12)]
    rng.shuffle(texts)
    return texts


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    for seed in (4, 5):
        texts = near_texts(seed)
        want = brute_components(texts)
        docs = spark.createDataFrame([(i, x, "k") for i, x in enumerate(texts)], "doc_id long, text string, class string").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
        assert got == dict(enumerate(want))
        kept = {r.doc_id for r in jaccard.deduplicated(docs).collect()}
        assert kept == {c for _, c in want}
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_blocks_of_a_large_group(spark):
    rows = [(0, c, 40, t) for t in range(30) for c in range(50)]
    lists = spark.createDataFrame(rows, "hub long, class long, n int, key long")
    met = set()
    for _, g in jaccard.grouped(lists, block=8).toPandas().groupby("group"):
        met |= {(a, b) for a, b in itertools.combinations(sorted(g["class"]), 2)}
    assert met == set(itertools.combinations(range(50), 2))


def test_small_sets_by_subsets(spark):
    assert jaccard.boundary({}) == 0
    assert jaccard.boundary({1: 100, 2: 100, 3: 100, 4: 100}) > 0
    rng = random.Random(0)
    sets = {c: frozenset(rng.sample(range(9), rng.randint(1, 6))) for c in range(60)}
    rows = spark.createDataFrame([(c, len(s), t) for c, s in sets.items() for t in s], "class long, n int, token long")
    edges = {(r.u, r.v) for r in jaccard.light_edges(rows, 6).collect()}
    label = {c: c for c in sets}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    other = {c: c for c in sets}
    for _ in range(60):
        for a, b in itertools.combinations(sets, 2):
            if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                other[a] = other[b] = min(other[a], other[b])
    assert label == other


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600 + i, x[3].tolist()) for i in range(40)]
    rows += [(700, None), (750, [0.0] * 16), (800, [float("nan")] * 16), (850, [None] * 16), (900, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).repartition(3)
    got = neighbours.search(vectors, centroids=8, share=0.6, block=64).toPandas()
    ids, data = np.array([i for i, _ in rows[:640]]), np.array([v for _, v in rows[:640]], float)
    norm = np.linalg.norm(data, axis=1)
    hits = total = 0
    for q in range(0, 640, 50):
        score = data @ data[q] / (norm * norm[q])
        want = sorted((-round(s, 12), i) for s, i in zip(score, ids, strict=True) if i != q)[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(mine.score, score[mine.vec_id], rtol=0, atol=1e-12)
        hits += len({i for _, i in want} & set(mine.vec_id))
        total += 5
    assert hits / total >= 0.9
    assert set(got.query_id) == set(range(0, 640, 50))
    twin = got[got.query_id == 600].sort_values("rank")
    assert twin.vec_id.tolist() == [3, 601, 602, 603, 604]
    whole = neighbours.search(vectors, centroids=4, share=1.0, block=64).toPandas()
    assert whole[whole.query_id == 50].sort_values("rank").vec_id.tolist() == [i for _, i in sorted((-s, i) for s, i in zip(data @ data[50] / norm, ids, strict=True) if i != 50)[:5]]
    assert neighbours.search(vectors.limit(0)).count() == 0


def test_repeated_rows_hide_no_neighbours(spark):
    rows = [(3, [1.0, 0.0, 0.0, 1.0])] * 9 + [(i, [1.0, 0.0, 0.0, 1.0]) for i in (0, 7, 9, 11, 12, 13, 14)] + [(20, [0.0, 1.0, 0.0, 0.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, k + 1, v) for k, v in enumerate((3, 7, 9, 11, 12))]
    assert all(abs(r.score - 1) < 1e-12 for r in got)


def test_cells_come_by_distance():
    rng = np.random.default_rng(3)
    a, b = rng.random(7), rng.random(5)
    got = [a[i] + b[j] for i, j in neighbours.cells_by_distance(a, b)]
    assert got == sorted(got)
    assert len(got) == 35


def test_pipeline(spark, tmp_path):
    prose = [" ".join(f"{w}{k * 7 + i * 131}" if k % 3 else w for k, w in enumerate("the river of time is in a valley that leads to the sea and on ".split() * 6)) for i in range(60)]
    texts = [*prose, prose[0], prose[1] + " more", prose[2] + ' token = "deadbeef0123"', "short", None, *(p + " you utter fool" for p in prose[3:33])]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int("fool" in (x or ""))) for i, x in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    for (_, stage), check in zip(corpus_pipeline.STAGES[:4], (quality.good, lambda d: toxicity.civil(d, spark.read.parquet(str(tmp_path / "labels.parquet"))), jaccard.deduplicated, secrets.redacted), strict=True):
        now = stage(spark, kept, str(tmp_path))
        assert now.columns == docs.columns
        assert {r.doc_id for r in now.collect()} == {r.doc_id for r in check(kept).collect()}
        kept = spark.createDataFrame(now.collect(), docs.schema)
    assert {r.doc_id for r in kept.collect()} == set(range(60))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(range(60))


def test_batches_of_texts_are_bounded(spark):
    # The repetitions of a long text would come to Python in one batch otherwise.
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a word").alias("text"))
    packing.pack(docs, queries.SINGLE, queries.PATTERN).count()
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert max(r.n for r in sizes) <= 1000
