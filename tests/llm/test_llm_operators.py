"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loregraph.llm import _pretokens, _scan, decontaminate, exact_dedup, language_id, line_dedup, ngram_join, packing, quality, sharding, token_counts, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "the quick brown fox jumps over the lazy dog and runs away from all of the others in that old yard near home"
LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(20000))
TEXTS = [
    (1, BASE), (2, BASE.upper()), (3, BASE + "  "), (4, BASE.replace("fox", "cat")), (5, None), (6, ""), (7, " \n\t "), (8, "12 34"), (9, LONG), (10, LONG + " end"),
    (11, "a b c"), (12, "a b c"), (12, "a b c"), (None, "a b c"), (None, None), (13, "été à la plage, n'est-ce pas? <|endoftext|> don't 'S  x"), (14, "one\ntwo\nthree\nfour"),
    (15, "zero\none\ntwo\nthree\nfour"), (16, "one\ntwo\nother\none\ntwo\nthree\nfour"), (17, BASE + " extra"), (18, "x\nx\nx\nx\nx"), (13, "other text under the same id"),
]


def table(spark, rows=TEXTS):
    rows = [(i, t, ["en", "fr", None][k % 3], ["s0", "s0", "s1", None][k % 4], len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.vocabulary_path())


def test_pretokens_follow_the_library():
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    rng = np.random.default_rng(3)
    parts = ["a", "s", "'", "'s", "'ll", "'re", " ", "  ", "\n", "\t", "1", "é", "中", "!", " ", "́", "🙂", "²", "\x1c", "\x85", "'D"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(1500)] + ["", None]
    for lo, hi, data, offsets in _scan.pieces(pa.array(texts)):
        words = _pretokens.cut(data, offsets)
        for k in range(hi - lo):
            own = [words.text(j) for j in range(words.first[k], words.first[k + 1])]
            assert len(own) == len(cut(texts[lo + k] or "")) and "".join(own) == (texts[lo + k] or "")


@pytest.mark.parametrize("shard_tokens", [1 << 20, 300])
def test_op1_questions_to_the_files(spark, tmp_path, shard_tokens):
    """Counts, occurrences and tokens at places, from the files alone, against the library's ids."""
    path, t = f"file://{tmp_path}/tokens", tokenizer()
    rows = [(i, x) for i, x in TEXTS if i is not None and i != 12]
    wavelet.write_tokens(table(spark, rows), path, shard_tokens=shard_tokens)
    order = sorted(rows, key=lambda r: r[0])
    ids = {}
    flat = []
    for i, x in order:
        if i != 13:  # two texts share this id
            ids[i] = [*t.encode(x or "", add_special_tokens=False).ids, 2]
    listed = {r.doc_id: r.start for r in wavelet.read_tokens(spark, path).where("doc_id != 13").collect()}
    every = [2, ids[1][0], ids[9][0], ids[9][1], ids[9][3], 50255]
    found = collections.defaultdict(set)
    for r in wavelet.find_tokens(spark, path, every).where("doc_id != 13").collect():
        assert r.position == listed[r.doc_id] + r.offset
        found[r.token].add((r.doc_id, r.offset))
    assert {k: found[k] for k in every} == {k: {(i, j) for i, own in ids.items() for j, x in enumerate(own) if x == k} for k in every}
    whole = {r.token: r.n for r in wavelet.count_tokens(spark, path, every).collect()}
    assert whole == {k: wavelet.find_tokens(spark, path, [k]).count() for k in every}
    places = [listed[9], listed[9] + 777, listed[10] + len(ids[10]) - 1, listed[5], 10**9, -1]
    flat = {r.position: r.token for r in wavelet.tokens_at(spark, path, places).collect()}
    assert flat == {listed[9]: ids[9][0], listed[9] + 777: ids[9][777], listed[10] + len(ids[10]) - 1: 2, listed[5]: 2}


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (1, 511, 512, 513, 3000):
        ids = rng.integers(0, 50, n).astype(np.uint32) * 1000
        m = wavelet.WaveletMatrix.build(ids, 16)
        assert (m.decode() == ids).all()
        for i in rng.integers(0, n, 10):
            assert m.access(int(i)) == ids[i]
        for t in [*set(ids[:5].tolist()), 7]:
            at = np.flatnonzero(ids == t)
            end = int(rng.integers(0, n + 1))
            assert m.rank(t) == len(at) and m.rank(t, end) == (ids[:end] == t).sum()
            assert [m.select(t, k) for k in range(len(at))] == at.tolist() and m.select(t, len(at)) == -1
            assert m.occurrences(int(t)).tolist() == at.tolist()


@pytest.mark.parametrize("shard_tokens", [1 << 20, 20])
def test_op1_tokens(spark, docs, shard_tokens):
    t = tokenizer()
    rows = wavelet.token_report(docs, shard_tokens=shard_tokens).orderBy("start").collect()
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])])[:-1].tolist()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))

    def digest(text):
        own = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        return len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())

    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == collections.Counter((i, *digest(x)) for i, x in TEXTS)


def thue_morse() -> tuple[str, str]:
    """Two words that polynomial hashes modulo a power of two take for one."""
    one = "".join("ab"[k.bit_count() & 1] for k in range(1024))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    a, b = thue_morse()
    rows = [(1, f"x {a} {b}"), (2, f"x {b} {a}"), (3, a), (4, b), (5, f"{a} w1 w2"), (6, f"{b} w1 w2")]
    t = tokenizer()
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(table(spark, rows)).collect()}
    assert counts == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in rows}
    crcs = {r.doc_id: r.ids_crc32 for r in wavelet.token_report(table(spark, rows)).collect()}
    assert crcs == {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for i, x in rows}
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contamination_report(table(spark, rows), bench).collect() if r.n_hit} == {1, 2, 3, 5}
    assert all(r.component_id == r.doc_id for r in ngram_join.similarity_report(table(spark, rows)).collect())


def test_word_table_fills_up(monkeypatch):
    """Words are counted and encoded alike when the table that remembers them is emptied over and over."""
    init = _pretokens.WordTable.__init__
    monkeypatch.setattr(_pretokens.WordTable, "__init__", lambda self, bits=5: init(self, bits))
    t, path = tokenizer(), token_counts.vocabulary_path()
    texts = [" ".join(f"w{k}x{j} internationalisation{k % 7}" for j in range(k)) for k in range(12)]
    counter, encoder = token_counts._Counter(path), wavelet.Encoder(path)
    for text in [*texts, *texts[::-1]]:
        raw = text.encode()
        data, offsets, want = np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), t.encode(text, add_special_tokens=False).ids
        assert counter.counts(data, offsets).tolist() == [len(want)]
        assert encoder.encode(data, offsets)[0].tolist() == [*want, 2]


def test_other_tokenizers_are_refused(tmp_path):
    """A file whose settings the pre-tokeniser here does not follow."""
    with open(token_counts.vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps({**spec, **change}), encoding="utf-8")
        for reader in (token_counts.MergeRules, wavelet.Encoder):
            with pytest.raises(ValueError, match="byte-level"):
                reader(str(path))


def test_op1_and_op8_empty(spark, empty):
    assert wavelet.token_report(empty).collect() == [] and token_counts.token_counts(empty).collect() == []


def test_op8_counts(docs):
    t = tokenizer()
    want = collections.Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in TEXTS)
    rows = token_counts.token_counts(docs).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)


def brute_pack(pieces, capacity):
    bins = []
    for size, s, c in pieces:
        fit = [(b["free"], k) for k, b in enumerate(bins) if b["free"] >= size and (s < 0 or s not in b["s"]) and (c < 0 or c not in b["c"])]
        if not fit:
            bins.append({"free": capacity, "s": set(), "c": set()})
        at = min(fit)[1] if fit else len(bins) - 1
        b = bins[at]
        b["free"] -= size
        b["s"].add(s)
        b["c"].add(c)
        yield at


def test_op2_best_fit_against_brute_force():
    rng = np.random.default_rng(5)
    n = 700
    lengths, s, c = rng.integers(1, 101, n), rng.integers(-1, 70, n), rng.integers(-1, 300, n)
    s[: n // 3] = 0
    lengths = -np.sort(-lengths)
    bins, slots = packing.best_fit(lengths, s, c, 100)
    order = np.argsort(-lengths, kind="stable")
    want = list(brute_pack([(int(lengths[k]), int(s[k]), int(c[k])) for k in order], 100))
    # bins without room left take nothing, so numbers agree
    assert [int(bins[k]) for k in order] == want
    for b in range(bins.max() + 1):
        own = bins == b
        assert lengths[own].sum() <= 100 and sorted(slots[own]) == list(range(own.sum()))


def test_op2_packing(docs, empty):
    rows = packing.packing_report(docs, capacity=300, group_rows=8).collect()
    per_bin = collections.defaultdict(list)
    for r in rows:
        per_bin[r.bin_id].append(r)
    assert all(sum(r.length for r in own) == own[0].bin_used <= 300 for own in per_bin.values())
    total = collections.Counter()
    for r in rows:
        total[r.doc_id] += r.length
    want = collections.Counter()
    for i, t in TEXTS:
        want[i] += len((t or "").encode()) + 1
    assert total == want
    assert packing.packing_report(empty).collect() == []


def test_op2_pack_against_brute_force(spark, docs):
    """One group: every piece is where a plain best fit over one list puts it; repeated, long and null rows included."""
    rng = np.random.default_rng(11)
    rows = [(int(i) if i % 9 else None, int(n), None if n % 7 == 0 else f"s{n % 5}", int(c) if c % 3 else None) for i, n, c in rng.integers(1, 400, (150, 3))]
    rows += [(5, 350, "s0", 4)] * 3 + [(None, 700, None, None)] * 4 + [(6, 0, "s1", 1), (6, None, "s1", 1), (8, 100, "s1", 9), (9, 101, "s2", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, n long, source string, cluster long").repartition(5)
    args = (F.col("n"), "doc_id", "source", F.col("cluster"), 100, 10**6)
    out = packing.pack(frame, *args).collect()
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.bin_id].append(r)
    for own in bins.values():
        assert sum(r.length for r in own) == own[0].bin_used <= 100 and sorted(r.slot for r in own) == list(range(len(own)))
    numbered, seen = [], collections.Counter()
    for row in rows:
        if row[1]:
            numbered.append((row[0], row[1], row[2], row[3], seen[row]))
            seen[row] += 1
    typed = "doc_id long, size long, source string, cluster long, copy long"
    ties = {(r.doc_id, r.size, r.source, r.cluster, r.copy): r.tie for r in spark.createDataFrame(numbered, typed).selectExpr("*", "xxhash64(doc_id, size, source, cluster, copy) tie").collect()}
    rest = sorted((-(n % 100), ties[(i, n, s, c, k)], n, s, c, i) for i, n, s, c, k in numbered if n % 100)
    sources = {None: -1} | {f"s{k}": k for k in range(5)}
    want = list(brute_pack([(-x[0], sources[x[3]], -1 if x[4] is None else x[4]) for x in rest], 100))
    filled = collections.defaultdict(list)
    for x, b in zip(rest, want, strict=True):
        filled[b].append((x[5], x[2] // 100, -x[0]))
    full = [(i, k, 100) for i, n, *_ in numbered for k in range(n // 100)]
    assert collections.Counter(tuple(sorted(((r.doc_id, r.piece, r.length) for r in own), key=str)) for own in bins.values()) == collections.Counter(
        [tuple(sorted(own, key=str)) for own in filled.values()] + [(x,) for x in full]
    )
    again = packing.pack(frame.repartition(2), *args).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, out))


def test_op3_sharding(spark, docs, empty):
    rows = sharding.shard_report(docs, limit_bytes=400).collect()
    size = collections.Counter()
    for r, (i, t) in zip(sorted(rows, key=lambda r: str(r.doc_id)), sorted(TEXTS, key=lambda x: str(x[0])), strict=True):
        assert r.doc_id == i
        size[r.shard] += len((t or "").encode())
    shards = {r.shard: (r.depth, r.shard_bytes) for r in rows}
    h = {i: int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16) for i, _ in TEXTS}

    def brute(prefix, ids):
        own = [(i, t) for i, t in TEXTS if i in ids]
        b = sum(len((t or "").encode()) for _, t in own)
        if b <= 400 or len(own) == 1:
            return {"b" + prefix: b} if own else {}
        split = [{i for i in ids if h[i] >> (59 - len(prefix)) & 1 == bit} for bit in (0, 1)]
        return brute(prefix + "0", split[0]) | brute(prefix + "1", split[1])

    assert {s: b for s, (_, b) in shards.items()} == brute("", set(h))
    assert size == collections.Counter({s: b for s, (_, b) in shards.items()})
    assert {r.shard for r in sharding.shard_report(docs, limit_bytes=1 << 30).collect()} == {"b"}
    assert sharding.shard_report(empty).collect() == []
    clash = docs.withColumnRenamed("lang", "shard").withColumnRenamed("source", "__h")
    assert sharding.assign_shards(clash, limit_bytes=400).count() == len(TEXTS)


def test_op3_keys_above_the_limit(spark):
    """Rows of one key, of a null key, and repeated rows are split; only a single row may exceed the limit."""
    rows = [(None, f"{k} " * 100) for k in range(10, 30)] + [(7, "same " * 60)] * 12 + [(8, "x" * 5000), (9, None)] + [(k, "y" * 30) for k in range(100, 140)]
    out = sharding.assign_shards(table(spark, rows), limit_bytes=1000).collect()
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter(rows)
    shards = collections.defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
    for name, own in shards.items():
        total = sum(len(r.text or "") for r in own)
        assert {(r.depth, r.shard_bytes) for r in own} == {(len(name) - 1, total)} and (total <= 1000 or len(own) == 1)
    assert max(r.depth for r in out) > 60


def test_op4_quality(spark, docs, empty):
    rng = np.random.default_rng(2)
    good = ["".join(rng.choice(["the ", "house ", "runs ", "well ", "over. ", "hill "]) for _ in range(40)) for _ in range(300)]
    bad = ["".join(rng.choice(["$$$ ", "XX!! ", "### ", "A|B ", "%% "]) for _ in range(40)) for _ in range(120)]
    rows = [(k, t) for k, t in enumerate(good + bad)] + [(900, None), (901, ""), (None, "x")]
    labels = spark.createDataFrame([(k, int(k < 300)) for k in range(420)] + [(0, None), (5, 1), (None, 1)], "doc_id long, quality int")
    out = quality.quality_report(table(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 420]
    assert held and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in out if r.doc_id is not None)
    assert sum(r.predicted == int(r.doc_id < 300) for r in held) / len(held) > 0.97
    none = labels.limit(0)
    assert {r.score for r in quality.quality_report(docs, none).collect()} == {0.5}
    assert quality.quality_report(empty, labels).collect() == []


def test_op4_isotonic():
    rng = np.random.default_rng(0)
    x, n = np.sort(rng.normal(size=60)), rng.integers(1, 9, 60).astype(float)
    good = np.minimum(n, rng.integers(0, 9, 60)).astype(float)
    points, rates = quality.isotonic(x, n, good)
    assert (np.diff(points) > 0).all() and (np.diff(rates) > 0).all()
    fitted = np.interp(x, points, rates)
    assert abs((fitted - good / n).mean()) < 0.2


def test_op4_isotonic_against_brute_force():
    """Rates at the points against the max-min formula of isotonic regression."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        k = int(rng.integers(1, 25))
        x, n = np.sort(rng.choice(1000, k, replace=False)).astype(float), rng.integers(1, 9, k).astype(float)
        good = np.minimum(n, rng.integers(0, 9, k)).astype(float)
        points, rates = quality.isotonic(x, n, good)
        want = [max(min(good[a : b + 1].sum() / n[a : b + 1].sum() for b in range(j, k)) for a in range(j + 1)) for j in range(k)]
        block = np.searchsorted(np.unique(want), want) if len(set(np.round(want, 12))) == len(np.unique(want)) else None
        assert np.allclose(sorted(set(np.round(want, 9))), rates)
        if block is not None:
            assert np.allclose(points, [np.average(x[block == j], weights=n[block == j]) for j in range(len(rates))])


def test_op4_features_approximate_the_kernel(monkeypatch):
    monkeypatch.setattr(quality, "N_FEATURES", 20_000)
    d = len(quality.STATISTICS)
    model = quality.QualityModel(np.zeros(d), np.ones(d), np.zeros(1), np.zeros(1), np.zeros(1))
    x = np.random.default_rng(1).normal(size=(12, d))
    z = model.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * quality.WIDTH**2 * d))
    assert np.abs(z @ z.T - exact).max() < 0.04


def test_op4_weights_against_a_direct_solve(spark):
    """The summed normal equations give the ridge regression over all rows at once, and calibration is that of its raw scores."""
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(["the ", "House ", "x1 ", "!! ", "\n", "long-word "], 30)) for _ in range(300)]
    y = rng.integers(0, 2, 300)
    stats = quality.text_statistics(table(spark, list(enumerate(texts)))).repartition(7)
    model = quality.fit(stats, spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, quality int"))
    rows = [r for r in stats.collect() if r.bucket > 1]
    x, t = np.array([r.stats for r in rows], dtype=float), np.array([y[r.doc_id] for r in rows], dtype=float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.spread, np.where(x.std(0) > 1e-9, x.std(0), 1.0), atol=1e-6)
    z = model.features(x)
    penalty = np.sqrt(np.append(np.full(quality.N_FEATURES, quality.RIDGE * len(x) / quality.N_FEATURES), 1e-9))
    direct = np.linalg.lstsq(np.vstack([z, np.diag(penalty)]), np.append(t, np.zeros(len(penalty))), rcond=None)[0]
    assert np.allclose(z @ model.weights, z @ direct, atol=1e-4)
    # labels of one class, ties and no calibration fold
    ones = quality.fit(stats, spark.createDataFrame([(k, 1) for k in range(300)], "doc_id long, quality int"))
    assert np.allclose(ones.score(x), 1.0)
    train_only = stats.where("bucket > 1")
    assert len(quality.fit(train_only, spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, quality int")).levels) > 1


def norm(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


@pytest.mark.parametrize(("digest_bytes", "broadcast"), [(32, 500_000), (0, 500_000), (32, -1), (1, -1)])
def test_op5_exact(docs, monkeypatch, digest_bytes, broadcast):
    """A digest of no bytes makes all texts collide; full bytes still tell them apart."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_DIGESTS", broadcast)
    rows = exact_dedup.exact_duplicates(docs, digest_bytes=digest_bytes).collect()
    groups = collections.defaultdict(list)
    for i, t in TEXTS:
        groups[norm(t)].append((i, t))
    want = collections.Counter()
    for n, own in groups.items():
        keep = min(own, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0]
        for i, _ in own:
            want[(i, keep, len(own), i == keep, hashlib.sha256(n.encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows) == want


def test_op5_goes_on_with_its_state(spark, docs, tmp_path):
    dedup = exact_dedup.StreamingDeduplicator(spark, f"file://{tmp_path}/state")
    first, second = docs.where("doc_id <= 6"), docs.where("doc_id > 6 OR doc_id IS NULL")
    dedup.add(first)
    dedup.add(second)
    sizes = sorted(r.group_size for r in dedup.keepers().collect())
    assert sizes == sorted(collections.Counter(norm(t) for _, t in TEXTS).values())
    # a locator finds the text that it was made for
    kept = {(r.file, r.row): r.digest for r in dedup.keepers().select("digest", "locator.*").collect()}
    stored = {(r.file, r.row): r for r in dedup.content().select("norm", "digest", F.inline(F.array(exact_dedup._locator()))).collect()}
    assert all(stored[at].digest == d and hashlib.sha256(stored[at].norm.encode()).digest() == bytes(d) for at, d in kept.items())


def test_op5_stage(docs, empty):
    left = exact_dedup.keep_first_copies(docs.withColumnRenamed("lang", "__keep"))
    assert left.columns == ["doc_id", "text", "__keep", "source", "n_chars"]
    assert left.count() == len({norm(t) for _, t in TEXTS})
    assert exact_dedup.keep_first_copies(empty).collect() == [] and exact_dedup.exact_duplicates(empty).collect() == []


def brute_lines(rows, hashes, weight=50):
    """Every run of lines that also stands earlier goes, if it has three lines or ``weight`` words; straight from the definition."""
    order = sorted({(i is None, i or 0, hashes[t or ""], i, t or "") for i, t in rows})
    texts = [t.split("\n") for *_, t in order]
    full = [[(k, x) for k, x in enumerate(own) if x.strip(" \t\n\v\f\r")] for own in texts]
    gone = [set() for _ in order]
    for d, own in enumerate(full):
        for e in range(d + 1):
            for i in range(len(own)):
                for j in range(i if e == d else len(full[e])):
                    n = 0
                    while i + n < len(own) and j + n < len(full[e]) and own[i + n][1] == full[e][j + n][1]:
                        n += 1
                    if sum(max(17, len(re.findall("[^\x20\x09-\x0d]+", x))) for _, x in own[i : i + n]) >= weight:
                        gone[d] |= set(range(i, i + n))
    out = {}
    for (*_, i, t), lines, own, dead in zip(order, texts, full, gone, strict=True):
        cut = {own[k][0] for k in dead}
        for k in dead & {x - 1 for x in dead}:
            cut |= set(range(own[k][0], own[k + 1][0]))
        out[(i, t)] = (len(lines), len(cut), "\n".join(x for k, x in enumerate(lines) if k not in cut))
    return out


@pytest.mark.parametrize("broadcast", [200_000, -1])
def test_op6_lines(spark, monkeypatch, docs, empty, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast)
    rng = np.random.default_rng(8)
    long_line, half = " ".join(f"p{k}" for k in range(51)), " ".join(f"q{k}" for k in range(26))
    rows = [*TEXTS, (16, "x\nx\nx\nx\nx"), (16, "x\nx\nx\nx\nx"), (19, "\n\n\n\n"), (20, "a\n\nb\n \nc"), (21, "z\na\n\n\nb\nc\n\nd")]
    # one long line between others; two lines of half the length; no two lines that are too short; a run whose edges stand in different documents
    rows += [(30, f"u\n{long_line}\nv"), (31, f"w\n{long_line}\ny"), (32, f"{half}\n{half}1"), (33, f"r\n{half}\n{half}1\ns"), (34, f"{half}\nother"), (35, long_line)]
    rows += [(40, "p\na1\nb1\nc1\ns"), (41, "x1\na1\nb1\nc1\ne1"), (42, "x1\na1\nb1\nc1\ne1"), (43, f"{long_line}\n{long_line}\ntail")]
    lines = ["a", "b", "c", "", "d", " ", half, long_line]
    rows += [(100 + k, "\n".join(rng.choice(lines, rng.integers(1, 14)))) for k in range(60)]
    texts = sorted({t or "" for _, t in rows})
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    want = brute_lines(rows, hashes)
    assert want[(42, rows[-62][1])][1] == 5 and want[(34, f"{half}\nother")][1] == 0
    out = line_dedup.remove_repeated_runs(table(spark, rows)).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert collections.Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in out) == collections.Counter((i, *want[(i, t or "")]) for i, t in rows)
    assert line_dedup.line_report(empty).collect() == []
    clash = docs.withColumnRenamed("lang", "n_lines").withColumnRenamed("source", "__key")
    assert line_dedup.remove_repeated_runs(clash).count() == len(TEXTS)


def test_op6_many_equal_lines(spark):
    """Costs grow with the lines of a text, not with their square."""
    rows = [(1, "\n".join(["same"] * 20_000)), (2, "\n".join(f"line {k} of many" for k in range(20_000))), (3, "\n".join(f"line {k} of many" for k in range(5, 19_000)))]
    out = {r.doc_id: r.n_removed for r in line_dedup.line_report(table(spark, rows)).collect()}
    assert out == {1: 19_999, 2: 0, 3: 18_995}


def test_op6_is_native(docs):
    plan = line_dedup.line_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op7_language(spark, docs, empty):
    rng = np.random.default_rng(4)
    words = {"en": ["the", "house", "which", "th", "with"], "fr": ["été", "où", "maison", "les", "ça"], "de": ["über", "straße", "das", "nicht", "schön"]}
    rows = [(k, " ".join(rng.choice(words[lang], 12)), lang, "s", 0) for k, lang in enumerate(rng.choice(list(words), 400))]
    rows += [(1000, None, "en", "s", 0), (1001, "12 3", "en", "s", 0), (1002, "", None, "s", 0), (None, "the house", None, "s", 0)]
    out = language_id.language_report(spark.createDataFrame(rows, SCHEMA)).collect()
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert held and all(r.lang_pred == lang[r.doc_id] for r in held)
    assert {(r.lang_pred, r.score) for r in out if r.doc_id in (1000, 1001, 1002)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in out)
    assert language_id.language_report(empty).collect() == []
    kept = language_id.keep_identified(docs.withColumnRenamed("source", "lang_pred"))
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "n_chars"]
    assert not {5, 6, 7, 8} & {r.doc_id for r in kept.collect()}


def test_op7_keeps_every_byte(spark):
    """Rare scripts cost the same whatever room the tables have."""
    texts = {"en": "the cat and the dog sat on a mat " * 30, "el": "λόγος και θάλασσα", "he": "שלום עולם", "th": "สวัสดีชาวโลก"}
    rows = spark.createDataFrame([(k, t, lang, "s", 0) for k, (lang, t) in enumerate(texts.items())], SCHEMA)
    probes = [*texts.values(), "γος", "לום", "ชาว", "zq é"]
    raw = [t.encode() for t in probes]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole, small = (language_id.fit(rows, table_bytes=b).code_lengths(data, offsets) for b in (1 << 40, 20_000))
    assert (whole == small).all()


def test_op7_stage_keeps_close_calls(spark):
    """A share of a third is a language all the same."""
    rows = [(k, "same words", f"l{k % 3}", "s", 0) for k in range(60)]
    assert language_id.keep_identified(spark.createDataFrame(rows, SCHEMA)).count() == 60


def test_op7_code_lengths_by_hand():
    """Costs against a plain PPM of the same order."""
    text = b"abracadabra abrac"
    counts = collections.Counter()
    padded = b"\n\n" + text
    for i in range(2, len(padded)):
        counts[padded[i - 2 : i + 1]] += 1

    def cost(ctx, sym):
        if ctx is None:
            return 8.0
        n, q, own = collections.Counter(), 0, 0
        for k, v in counts.items():
            if k[: 2][2 - len(ctx) :] == ctx:
                n[k[2]] += v
        total, q, own = sum(n.values()), len(n), n[sym]
        shorter = ctx[1:] if ctx else None
        if own:
            return -np.log2(own / (total + q))
        return (-np.log2(q / (total + q)) if total else 0.0) + cost(shorter, sym)

    batch = pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([text.decode()])], names=["lang", "text"])
    key, n = (next(language_id._count_trigrams(iter([batch]))).column(c).to_numpy() for c in ("key", "n"))
    cube = np.zeros((256, 256, 256), dtype=np.int64)
    cube[key >> 16, (key >> 8) & 255, key & 255] = n
    table_ = language_id._tables(cube)
    for probe in (b"abra", b"zzz", b"cab", b"a a"):
        p = b"\n\n" + probe
        want = sum(cost(p[i - 2 : i], p[i]) for i in range(2, len(p)))
        got = sum(table_[(p[i - 2] * 256 + p[i - 1]) * 256 + p[i]] for i in range(2, len(p))) / language_id.UNIT
        assert abs(want - got) < 0.05


def shingles(text, n):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while True:
        old = list(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    return [(i, len(sets[k]), least.get(label[k])) for k, (i, _) in enumerate(rows)]


def near_copies(seed, groups=25):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(vocab, 30))
    rows = []
    for _ in range(groups):
        words = list(rng.choice(vocab, rng.integers(3, 70)))
        if rng.random() < 0.4:
            words += passage
        for _ in range(rng.integers(1, 12)):
            own = list(words)
            for _ in range(rng.integers(0, 4)):
                own[rng.integers(0, len(own))] = str(rng.choice(vocab))
            if rng.random() < 0.3:
                own = own[: -int(rng.integers(1, 4))] or own
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize(("seed", "n", "percent", "bounds"), [(1, 4, 85, {}), (2, 5, 80, {}), (3, 4, 85, {"BROADCAST_IDS": -1, "MARK_BITS": 10, "MAX_FREQUENT": 3})])
def test_op9_components(spark, monkeypatch, seed, n, percent, bounds):
    """Bounds change plans only: shuffles for broadcasts, a full bitmap, a threshold of frequency that doubles."""
    for name, value in bounds.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = near_copies(seed) + [(i if i is None else i + 1000, t) for i, t in TEXTS]
    out = ngram_join.similarity_report(table(spark, rows), n=n, percent=percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == collections.Counter(brute_components(rows, n, percent))


@pytest.mark.parametrize("bits", [27, 8])
@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_op9_short_variants(spark, monkeypatch, bits, n, percent):
    """Variants of one short text share frequent tokens only, so combinations of these alone link them; a full bitmap loses nothing."""
    monkeypatch.setattr(ngram_join, "MARK_BITS", bits)
    texts = [" ".join(f"g{g}w{k}" for k in range(length)) for g, length in enumerate(range(8, 16))]
    rows = list(enumerate(x for t in texts for x in [t, *[f"{t} own{k}" for k in range(4)]]))
    out = ngram_join.similarity_report(table(spark, rows), n=n, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_components(rows, n, percent)


@pytest.mark.parametrize("node_bits", [1, 3])
def test_op9_sets_of_one_short_hash_stay_apart(spark, node_bits):
    rows = near_copies(3) + [(i if i is None else i + 1000, t) for i, t in TEXTS]
    out = ngram_join.similarity_report(table(spark, rows), node_bits=node_bits).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == collections.Counter(brute_components(rows, 4, 85))


def test_op9_bitmaps_differ_in_no_more_bits_than_sets_differ_in_tokens():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 3000, int(rng.integers(1, 900)))).astype(np.uint64) for _ in range(2))
        b = np.union1d(b, rng.permutation(a)[: int(rng.integers(0, len(a) + 1))])
        bits = np.bitwise_count((ngram_join.sketch(a) ^ ngram_join.sketch(b)).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(a, b)) and not (ngram_join.sketch(a) ^ ngram_join.sketch(a)).any()


def test_op9_bitmaps_of_tokens_are_small_where_tokens_are_few_and_pass_through_the_driver_once(spark, docs, monkeypatch):
    rng = np.random.default_rng(5)
    few, many, other = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (50, 3000, 3000))
    made = [ngram_join.Marks.of(spark.createDataFrame([(int(t),) for t in x], "token long")) for x in (few, many)]
    assert [m.words.nbytes <= 2 * ngram_join.SPARSE * n // 8 for m, n in zip(made, (50, 3000), strict=True)] == [True, True]
    both = made[0] | made[1]
    assert made[0].has(few).all() and both.has(few).all() and both.has(many).all() and both.has(other).mean() < 0.1
    none = ngram_join.Marks.of(spark.createDataFrame([], "token long"))
    assert not none.has(few).any() and ((none | made[1]).words == made[1].words).all()
    sent = both.sent(spark)
    assert sent.has(many).all()
    sent.drop()
    emit = ngram_join._emit_keys
    monkeypatch.setattr(ngram_join, "_emit_keys", lambda *marks: emit(*marks) if len(cloudpickle.dumps(emit(*marks))) < 5_000 else pytest.fail("a function that carries a bitmap"))
    assert ngram_join.similarity_report(docs).count() == docs.count()


def test_op9_keys_lose_no_pair():
    """Sets that link share a key that both may use, whatever tokens are frequent."""
    rng = np.random.default_rng(9)
    bounds = ngram_join.Bounds(85)
    for _ in range(400):
        n = int(rng.integers(7, 90))
        a = rng.choice(5000, n, replace=False)
        gone = rng.permutation(n)[: int(rng.integers(0, max(1, n // 10) + 1))]
        b = np.concatenate([np.delete(a, gone), rng.choice(np.arange(5000, 9000), int(rng.integers(0, max(1, n // 10) + 1)), replace=False)])
        a, b = np.unique(a).astype(np.uint64), np.unique(b).astype(np.uint64)
        i = len(np.intersect1d(a, b))
        t = -(-85 * (len(a) + len(b)) // 185)
        if i < t:
            continue
        frequent = ngram_join.Marks.none(14)
        for token in rng.choice(9000, int(rng.integers(0, 9000))).tolist():
            frequent.words[token >> 6] |= np.uint64(1 << (token & 63))
        (ka, na), (kb, nb) = (ngram_join.keys_of(x, len(x), frequent, bounds) for x in (a, b))
        usable = [set(k[need <= len(x) - t].tolist()) for k, need, x in ((ka, na, a), (kb, nb, b))]
        assert usable[0] & usable[1]


def test_op9_stage(docs, empty):
    left = ngram_join.keep_one_per_component(docs.withColumnRenamed("lang", "__row"))
    assert left.columns == ["doc_id", "text", "__row", "source", "n_chars"]
    ids = collections.Counter(r.doc_id for r in left.collect())
    comps = brute_components(TEXTS, 4, 85)
    assert all(ids[i] == (2 if i == 13 else 1) for i, n, c in comps if i is not None and i == c)
    assert not [i for i, n, c in comps if i is not None and i != c and ids[i]]
    assert ngram_join.similarity_report(empty).collect() == [] and ngram_join.keep_one_per_component(empty).collect() == []


def item_words(t):
    low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute_contamination(rows, items):
    for i, t in rows:
        w, hit, found = item_words(t), set(), set()
        for k, x in items:
            own = item_words(x)
            size = min(13, len(own))
            for s in range(len(own) - size + 1 if own else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == own[s : s + size]:
                        hit |= set(range(p, p + size))
                        found.add(str(k))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield i, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_bytes", [32 << 20, 60])
def test_op10_contamination(spark, empty, block_bytes):
    items = [(1, BASE), (2, "Quick, brown!"), (10, "é x1 <y>"), (3, None), (4, "--"), (5, BASE.replace("dog", "hen")), (2, "lazy dog")]
    rows = [*TEXTS, (50, f"é X1 y {BASE[20:]} tail"), (60, f"{LONG} {BASE} {LONG}"), (51, "quick é x1 y"), (52, "lazy"), (53, "and dog"), (54, BASE + " " + BASE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination_report(table(spark, rows), bench, block_bytes=block_bytes, shard_words=40).collect()
    want = collections.Counter(brute_contamination(rows, items))
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out) == want
    assert decontaminate.contamination_report(empty, bench).collect() == []
    assert {r.n_hit for r in decontaminate.contamination_report(table(spark, rows), bench.limit(0)).collect()} == {0}
    found = decontaminate.find_contamination(table(spark, [(54, BASE + " " + BASE), (55, "new " + BASE[4:])]), bench, block_bytes=block_bytes).select("doc_id", "matches").collect()
    n = len(BASE.split())
    assert [(m.item_id, m.start, m.item_start, m.length) for r in found if r.doc_id == 54 for m in r.matches if m.item_id == "1"] == [("1", 0, 0, n), ("1", n, 0, n)]
    assert [(m.start, m.item_start, m.length) for r in found if r.doc_id == 55 for m in r.matches if m.item_id == "1"] == [(1, 1, n - 1)]
    kept = decontaminate.remove_contaminated(table(spark, rows).withColumnRenamed("lang", "spans"), bench)
    assert kept.columns == ["doc_id", "text", "spans", "source", "n_chars"] and kept.count() == sum(n for w, n in want.items() if not w[-1])


def test_op3_many_equal_rows_of_one_key(spark):
    """More repeats than any short hash tells apart: every shard keeps the limit, and shards do not hang on partitions."""
    rows = [(7, "r" * 600)] * 8000 + [(7, "s" * 400)] * 3 + [(8, "t" * 300), (8, "u" * 900), (None, "v" * 5000)]
    found = []
    for parts in (3, 11):
        out = sharding.assign_shards(table(spark, rows).repartition(parts), limit_bytes=1000).select("doc_id", "text", "shard", "depth", "shard_bytes").collect()
        shards = collections.defaultdict(list)
        for r in out:
            shards[r.shard].append(len(r.text))
        assert len(out) == len(rows) and all(sum(x) <= 1000 or len(x) == 1 for x in shards.values())
        assert all(r.shard_bytes == sum(shards[r.shard]) and r.depth == len(r.shard) - 1 for r in out)
        found.append(collections.Counter((r.shard, r.shard_bytes) for r in out))
    assert found[0] == found[1]


def test_op3_directory_of_uneven_groups(spark):
    """A group of many shards next to one of few: cells hold a bounded list each, whatever the other groups are."""
    shards = [(1, 12, p, 10, 1) for p in range(4096)] + [(2, 1, 0, 10, 1), (2, 2, 2, 10, 1), (2, 3, 6, 10, 1), (2, 3, 7, 10, 1)] + [(3, 0, 0, 5, 1)]
    df = spark.createDataFrame(shards, "g long, d int, p long, b long, n long")
    rows = sharding.directory_entries(df).collect()
    assert {r.g: r.width for r in rows} == {1: 12, 2: 2, 3: 0} and max(len(r.parts) for r in rows) == 2
    assert sum(len(r.parts) for r in rows) <= 2 * len(shards)


def test_op5_every_long_id(spark):
    least, most = -(1 << 63), (1 << 63) - 1
    rows = [(least, "a b"), (most, "ab"), (0, "a  b"), (-1, " ab"), (least, "c"), (most, "c "), (None, "c\n"), (most, "d"), (least, "d")]
    for digest_bytes in (32, 1):
        out = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(table(spark, rows), digest_bytes=digest_bytes).collect()}
        c = {(least, most, 3, False), (most, most, 3, True), (None, most, 3, False)}
        assert out == {(0, 0, 4, True), (least, 0, 4, False), (most, 0, 4, False), (-1, 0, 4, False), (least, least, 2, True), (most, least, 2, False)} | c


def test_new_words_are_tokenized_without_cutting_each(monkeypatch):
    encoder = wavelet.Encoder(wavelet.vocabulary_path(wavelet.VOCABULARY))
    special = next(iter(encoder.specials), "")
    texts = ["Ein Wort, größer als 12 🙂🙂 don't", "", f"a{special}b {special}", " \n\n x y ", "日本語 text " * 3]
    asked = []
    own = wavelet._pretokens.Words.text
    monkeypatch.setattr(wavelet._pretokens.Words, "text", lambda words, k: asked.append(own(words, k)) or asked[-1])
    data = "".join(texts).encode()
    flat, count = encoder.encode(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
    expected = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, wavelet.END_ID] for t in texts]
    assert flat.tolist() == [x for ids in expected for x in ids] and count.tolist() == [len(ids) for ids in expected]
    assert set(asked) <= set(encoder.specials)  # all others are spans of one string


def test_components_need_no_job_to_see_that_they_are_done(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from loregraph.llm._components import components

    monkeypatch.setattr(DataFrame, "take", lambda *a: pytest.fail("a job of its own"))
    chain = [(k, k + 1) for k in range(0, 40) if k != 25] + [(7, 7), (60, 50), (50, 55)]
    found = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert found == {**{k: 0 if k <= 25 else 26 for k in range(41)}, 50: 50, 55: 50, 60: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
