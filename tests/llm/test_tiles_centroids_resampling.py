"""SimHash, annulus clustering and importance resampling against brute-force versions."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from test_llm_operators import TEXTS, table

from loregraph.llm import _scan, centroids, resampling, simhash

LOWER = {i: i + 32 for i in range(65, 91)}


def near_copies(n=40):
    """One text of 120 words with ever more words changed, besides copies of it in capitals."""
    base = [f"word{i * 7 % 113}" for i in range(120)]
    out = []
    for k in range(n):
        words = list(base)
        for j in range(k % 8):
            words[(k * 31 + j * 17) % 120] = f"other{k * j % 29}"
        out.append((100 + k, " ".join(words).upper() if k % 9 == 0 else "  ".join(words)))
    return out


def fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(len(w) - 3, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, linked):
    up = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = i, j
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                up[max(a, b)] = min(a, b)
    out = []
    for i in range(n):
        while up[i] != i:
            i = up[i]
        out.append(i)
    return out


def test_xxh64_of_spans():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 9000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 8000, 2500))
    ends = starts + np.concatenate([np.arange(1000), rng.integers(0, 60, 1500)])
    assert simhash.xxh64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("small", [3, 64, 1000])
def test_tile_links_connect_what_all_pairs_connect(small):
    rng = np.random.default_rng(small)
    seeds = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    f = np.unique(np.concatenate([seeds[rng.integers(0, 12, 300)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 3)).astype(np.uint64), axis=1), seeds]))
    near = np.bitwise_count(f[:, None] ^ f) <= 4
    at = {int(x): i for i, x in enumerate(f)}
    side = rng.random(len(f)) < 0.4
    for left, right, both in ((f, None, near), (f[side], f[~side], near & (side[:, None] != side))):
        a, b = simhash.tile_links(left, right, 4, small)
        assert len(a) < len(f) and (np.bitwise_count(a ^ b) <= 4).all()
        found = {(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)}
        own = roots(len(f), lambda i, j, found=found: (i, j) in found or (j, i) in found)
        assert own == roots(len(f), lambda i, j, both=both: both[i, j])


@pytest.mark.parametrize("tile", [simhash.TILE, 4])
def test_op11_against_all_pairs(spark, tile):
    rows = TEXTS + near_copies()
    out = simhash.near_duplicates(table(spark, rows), tile=tile).collect()
    f = [fingerprint(t) for _, t in rows]
    comp = roots(len(rows), lambda i, j: (f[i] ^ f[j]).bit_count() <= 4)
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    expected = sorted((str(i), f"{x:016x}", str(least.get(c))) for (i, _), x, c in zip(rows, f, comp, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out) == expected
    assert len(set(comp)) < len(set(f))  # some links are not between equal fingerprints


def test_op11_empty_table_and_clashing_columns(spark):
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    odd = table(spark).withColumns({c: F.lit("x") for c in ("node", "fingerprint", "component_id", "own", "l")})
    assert sorted(map(str, simhash.near_duplicates(odd).collect())) == sorted(map(str, simhash.near_duplicates(table(spark)).collect()))


def vectors(n=300, odd=True):
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 0.2, (6, 64))
    x = (middle[rng.integers(0, 6, n)] + rng.normal(0, 0.05, (n, 64))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), *((1000 + i, [0.5] * 64) for i in range(40)), (2000, [-3.25] * 64)]
    if odd:
        v = rows[0][1]
        rows += [(3000, None), (3001, []), (3002, v[:63]), (3003, [*v, 0.0]), (3004, [None, *v[1:]]), (3005, [float("nan"), *v[1:]]), (3006, [float("inf"), *v[1:]]), (3007, [2e5, *v[1:]]), (None, v)]
    return rows


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 131072 for x in v)]
    order = sorted(range(len(kept)), key=lambda r: (hashlib.sha256(f"3:{'' if kept[r][0] is None else kept[r][0]}".encode()).hexdigest(), kept[r][1]))
    c = [kept[r][1] for r in order[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        own = nearest()
        for j in range(len(c)):
            if mine := [v for (_, v), (_, o) in zip(kept, own, strict=True) if o == j]:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = nearest()
    total = [sum(d for d, o in own if o == j) for j in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(str((i, j, d, total[j], sum(total), digest[j])) for (i, _), (d, j) in zip(kept, own, strict=True))


@pytest.mark.parametrize("take", [None, 5, 1])
def test_op12_against_whole_search(spark, take):
    rows = vectors()[:take] if take else vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    out = centroids.cluster_report(df.withColumns({"cluster": F.lit(1), "v": F.lit("x"), "home": F.lit(None).cast("int")}))
    assert sorted(str(tuple(r)) for r in out.collect()) == brute_clusters(rows)


def test_op12_nothing_to_cluster(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        assert centroids.cluster_report(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_annulus_compares_few_and_keeps_ties():
    rng = np.random.default_rng(2)
    c = np.array([[r * 100, 0] for r in range(1, 60)] + [[100, 0], [0, 100]])
    x = rng.integers(-30, 30, (500, 2)) + c[rng.integers(0, len(c), 500)]
    x[:2] = [[150, 0], [50, 50]]  # between two centroids; as far from three of one norm
    d = ((x[:, None] - c) ** 2).sum(axis=2)
    home = np.argsort(d, axis=1)[:, 1]
    best, least, compared = centroids.Annulus(c).search(x, home)
    assert best.tolist() == d.argmin(axis=1).tolist() and least.tolist() == d.min(axis=1).tolist()
    assert compared < 0.2 * d.size


def brute_sample(rows, target, buckets=10_000, min_words=20, percent=25):
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))

    def found(t):
        w = words(t)
        return [zlib.crc32(x.encode()) % buckets for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]

    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, x in rows:
        np.add.at(s, found(x), 1)
    for x in target:
        np.add.at(t, found(x), 1)
    out = []
    for i, x in rows:
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in found(x)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(gain), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(str(tuple(r[:5])) for r in out)


@pytest.mark.parametrize("percent", [25, 100, 0])
@pytest.mark.parametrize("target", [["The quick brown fox, word5 word12 word19!", None, ""], []])
def test_op13_against_sorting(spark, percent, target):
    rows = TEXTS + near_copies() + [(100, near_copies()[0][1])] * 3 + [(600, "é" * 200 + " x"), (601, " ".join(["y" * 90] * 25))]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    docs = table(spark, rows).withColumns({"score": F.lit("x"), "rank": F.lit(1), "bucket": F.lit(2)})
    out = resampling.resample_report(docs, bench, percent=percent).collect()
    assert sorted(str(tuple(r)) for r in out) == brute_sample(rows, target, percent=percent)
    drawn = resampling.resample(docs, bench, percent=percent)
    ids = {r.doc_id for r in out if r["rank"] is not None}
    assert drawn.columns == docs.columns and drawn.count() == sum(i in ids for i, _ in rows)


def test_op13_few_scores_are_ranked_by_id(spark):
    scored = spark.createDataFrame([(i, i % 3, 1, 1) for i in range(31)] + [(None, 2, 1, 1)], "doc_id long, score long, n_features long, weight long")
    out = resampling.ranked(scored, "doc_id is null or doc_id > 3", 70).collect()
    able = sorted(((r.doc_id, r.score) for r in out if r.doc_id is None or r.doc_id > 3), key=lambda x: (-x[1], x[0] is None, x[0]))
    expected = {x: k + 1 for k, x in enumerate(able[: 70 * len(able) // 100])}
    assert len(out) == 32 and all(r["rank"] == expected.get((r.doc_id, r.score)) for r in out)


def test_op13_empty_documents(spark):
    assert resampling.resample_report(table(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_crc32_continues():
    texts = ["", "a", "ab" * 50, "été 12", "x" * 64, "y" * 65]
    for _, _, data, offsets in _scan.pieces(pa.array(texts)):
        got = resampling.crc32_from(np.full(len(texts), zlib.crc32(b"before "), dtype=np.uint32), data, offsets[:-1], offsets[1:])
        assert got.tolist() == [zlib.crc32(b"before " + t.encode()) for t in texts]
