"""Jaccard join on word n-grams with token-combination prefixes.

A document is the set of its distinct word shingles, as 63-bit hashes, which
are the tokens here. Documents with one set form a node, told apart by two hashes of the set. Tokens are ordered
rare ones first, then frequent ones, each class by hash. Two sets of n and m that
share at least t tokens share one among the first n - t + 1 of the one and the
first m - t + 1 of the other. So

* a set indexes its rare tokens in its longest prefix one by one;
* each key carries what its set needs for it (``need``): a pair only uses a key that
  lies in the prefix that the two sizes together ask for, on either side;
* a set with fewer rare tokens than the prefix is long (a *dense* one) extends the
  prefix by ``k`` more tokens and indexes combinations of two frequent tokens
  that follow each other in it. Two dense sets that share no rare token
  share k frequent ones within the extended prefixes, and at most k - 2 tokens
  of either set are missing in the other, so some two of the shared ones follow
  each other in both.

Frequencies come from prefixes that are a little longer than needed, counted over
all nodes; for dense sets all tokens are counted. Every list of sets with a
common key is linked like a star to one centre, and lists that fell into one
component are done, as are lists of two. For what is left, all pairs across
components are tested, so no link is lost. Pairs are verified on the words of
their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.llm import _scan
from loregraph.llm._components import components
from loregraph.llm._scratch import fresh, stage

N = 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A token in more prefixes is frequent; doubled until at most MAX_FREQUENT tokens are.
FREQUENT = 3
MAX_FREQUENT = 4_000_000
#: Up to this many ids are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Tokens are marked in bitmaps of SPARSE bits for each, but at most 2 to the power of MARK_BITS.
SPARSE = 128
MARK_BITS = 27

#: Lists are dealt to other centres once more while they hold more than so many pairs for each entry.
MANY_PAIRS = 32
#: So many of the least keys of a set are carried along to make a pair of sets once, not at every key that they share.
LEAST_KEYS = 8

#: Bits of a set's bitmap, in words of 64.
SKETCH_WORDS = 8

_MULTS = np.random.default_rng(4).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text."""
    h, first = _scan.words(data, offsets, _scan.space_words())
    m = len(h)
    acc = np.zeros(max(m - n + 1, 0), dtype=np.uint64)
    for k in range(n):
        acc += h[k : m - n + 1 + k] * _MULTS[k]
    full = _scan.mix(acc) >> np.uint64(1)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(full[a : b - n + 1]))
        elif b > a:
            own = (h[a:b] * _MULTS[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(_scan.mix(own + _MULTS[60:61] * np.array([b - a], dtype=np.uint64)) >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Bounds:
    """Prefix lengths for 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent

    def large(self, n: int) -> int:
        """Prefix of the not smaller set: the overlap is at least percent / 100 of n."""
        return n - -(-self.percent * n // 100) + 1

    def more(self, n: int) -> int:
        """k - 1 for dense sets: tokens of the two that are not shared are (100 - percent) / percent of the smaller at most."""
        return (100 - self.percent) * n // self.percent + 1

    def measured(self, n: int) -> int:
        return min(n, self.large(n) + 8 + n // 50)

    def alone(self, n: int) -> bool:
        """No other set than an equal one can link: even with one token more or less."""
        return 100 * n < self.percent * (n + 1)


def node_of(tokens: np.ndarray) -> int:
    total = _scan.mix(tokens ^ _MULTS[40]).sum(dtype=np.uint64, keepdims=True) * _MULTS[41:42]
    return int(_scan.mix(total + np.array([len(tokens)], dtype=np.uint64)).view(np.int64)[0])


def second_hash(tokens: np.ndarray) -> int:
    """Another hash of the set, independent of ``node_of``."""
    return int(_scan.mix(tokens * _MULTS[42] ^ _MULTS[43]).sum(dtype=np.uint64, keepdims=True).view(np.int64)[0])


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Bits on which an odd number of the tokens fall."""
    at = (_scan.mix(tokens ^ _MULTS[44]) & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _scan_sets(n: int, percent: int, whole: bool, node_bits: int = 64):
    bounds = Bounds(percent)
    mask = (1 << node_bits) - 1 if node_bits < 64 else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _scan.pieces(batch.column("text")):
                sets = shingle_sets(data, offsets, n)
                kept = sets if whole else [s[: bounds.measured(len(s))] if len(s) and not bounds.alone(len(s)) else s[:0] for s in sets]
                at = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
                flat = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)
                own = [
                    pa.array([node_of(s) & mask if len(s) else None for s in sets], pa.int64()),
                    pa.array([second_hash(s) for s in sets], pa.int64()),
                    pa.array([sketch(s).tolist() if len(s) else None for s in sets], pa.list_(pa.int64())),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
                ]
                cols = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([*cols, *own], names=["doc_id", "row", "node", "second", "sketch", "n", "tokens"])

    return run


_SETS = "doc_id long, row long, node long, second long, sketch array<long>, n long, tokens array<long>"


def _renamed(rows: DataFrame, clashing: DataFrame | None) -> DataFrame:
    """``rows`` whose node stands for several sets get a node made from both hashes."""
    if clashing is None:
        return rows
    hit = clashing.select(F.col("node").alias("c_node"))
    out = rows.join(F.broadcast(hit) if hit.count() <= BROADCAST_IDS else hit, F.col("node") == F.col("c_node"), "left")
    return out.withColumn("node", F.when(F.col("c_node").isNull(), F.col("node")).otherwise(F.xxhash64("node", "second"))).drop("c_node")


class Marks:
    """Marked tokens as a bitmap over their low bits: it knows every marked token, and takes a few others for marked.

    Which class a token falls in, and whether a lone key is made, may hang on such a mistake; links do not, since
    every set is held against the same bitmap.
    """

    def __init__(self, held: np.ndarray | Broadcast):
        self.held = held

    @property
    def words(self) -> np.ndarray:
        return self.held.value if isinstance(self.held, Broadcast) else self.held

    @classmethod
    def none(cls, bits: int | None = None) -> Marks:
        return cls(np.zeros(1 << max((bits or MARK_BITS) - 6, 0), dtype=np.uint64))

    @classmethod
    def of(cls, tokens: DataFrame, name: str = "token") -> Marks:
        """What reaches the driver is the bitmap, at most 2 ** (MARK_BITS - 6) words."""
        bits = min(MARK_BITS, (SPARSE * tokens.count()).bit_length())
        at = F.col(name).bitwiseAND((1 << bits) - 1)
        bit = F.expr(f"shiftleft(1L, cast({name} & 63 as int))")
        rows = tokens.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        out = cls.none(max(bits, 6))
        for part in rows.to_batches():
            out.words[part.column("word").to_numpy()] = part.column("bits").to_numpy().view(np.uint64)
        return out

    def __or__(self, other: Marks) -> Marks:
        less, more = sorted((self.words, other.words), key=len)
        return Marks(more | np.tile(less, len(more) // len(less)))

    def sent(self, spark: SparkSession) -> Marks:
        """The same bitmap as a broadcast, which all functions that it is given to share; else each would carry a copy through the driver."""
        return Marks(spark.sparkContext.broadcast(self.words))

    def drop(self) -> None:
        """Nothing will ask the sent bitmap again."""
        self.held.destroy()

    def has(self, tokens: np.ndarray) -> np.ndarray:
        words = self.words
        at = (tokens & np.uint64(64 * len(words) - 1)).astype(np.int64)
        return (words[at >> 6] >> (tokens & np.uint64(63))) & np.uint64(1) > 0


def _frequent(tokens: DataFrame) -> Marks:
    """Tokens of ``tokens`` (token, c) with more than FREQUENT, or so much more that at most MAX_FREQUENT are left."""
    at_least = FREQUENT
    while tokens.where(F.col("c") > at_least).count() > MAX_FREQUENT:
        at_least *= 2
    return Marks.of(tokens.where(F.col("c") > at_least))


def keys_of(tokens: np.ndarray, n: int, frequent: Marks, bounds: Bounds, shared: Marks | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(keys, need of each) from the first tokens of a set of n by hash; None if more tokens are needed than were given.

    With ``shared``, rare tokens that are not marked there are left out; combinations are not counted before, so all stay.

    A partner with which the set must share t tokens uses the keys with
    need <= n - t: rare tokens among the first n - t + 1, and combinations
    whose second token is among the first n - t + k, if the set has no more
    than n - t rare tokens.
    """
    mask = frequent.has(tokens)
    rare, large = tokens[~mask], bounds.large(n)
    single = np.arange(min(len(rare), large))
    if shared is not None:
        single = single[shared.has(rare[single])]
    if len(rare) >= large:
        return rare[single], single
    if len(tokens) < n:
        return None
    common, more = tokens[mask], bounds.more(n)
    run = common[: min(n, large + more) - len(rare)]
    pairs = _scan.mix(run[:-1] * _MULTS[50] + run[1:] * _MULTS[51]) if len(run) > 1 else run[:0]
    second = len(rare) + 1 + np.arange(len(pairs))
    return np.concatenate([rare[single], pairs]), np.concatenate([single, np.maximum(second - more, len(rare))])


def _emit_keys(frequent: Marks, percent: int, shared: Marks | None = None):
    """Keys of each set; with ``shared``, rare tokens only if they are marked there."""
    bounds = Bounds(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            flat, at = np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            nodes, sizes = batch.column("node").to_pylist(), batch.column("n").to_pylist()
            keys, need, owner, n_out = [], [], [], []
            for k, (node, n) in enumerate(zip(nodes, sizes, strict=True)):
                found = keys_of(flat[at[k] : at[k + 1]], n, frequent, bounds, shared)
                if found is not None:
                    keys.append(found[0])
                    need.append(found[1])
                    owner.append(np.full(len(keys[-1]), node, dtype=np.int64))
                    n_out.append(np.full(len(keys[-1]), n, dtype=np.int64))
            if keys:
                cols = [np.concatenate(keys).view(np.int64), np.concatenate(owner), np.concatenate(n_out), np.concatenate(need)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "node", "n", "need"])

    return run


_KEYS = "key long, node long, n long, need long"


def _dense(frequent: Marks, percent: int, known: Marks | None):
    """Nodes whose measured tokens hold too few rare ones, and, where ``known`` is given, did not with those frequent tokens."""
    bounds = Bounds(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            flat, at = np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            n = np.asarray(batch.column("n"))
            need = n - -(-bounds.percent * n // 100) + 1

            def short(marks: Marks) -> np.ndarray:
                rare = np.concatenate([[0], np.cumsum(~marks.has(flat))])
                return rare[at[1:]] - rare[at[:-1]] < need

            mask = short(frequent) & (np.diff(at) < n)
            if known is not None:
                mask &= ~short(known)
            yield batch.select(["node", "doc_id", "row"]).filter(pa.array(mask))

    return run


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, row, text) that ``wanted`` (doc_id, row) names."""
    few = wanted.count() <= BROADCAST_IDS
    right = wanted.select(F.col("doc_id").alias("w_id"), F.col("row").alias("w_row"))
    return docs.join(F.broadcast(right) if few else right, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("row") == F.col("w_row")), "left_semi")


def _whole_sets(docs: DataFrame, wanted: DataFrame, n: int, percent: int, node_bits: int, clashing: DataFrame | None) -> DataFrame:
    """(node, n, tokens) of the documents ``wanted`` (doc_id, row), one of each node."""
    sets = _renamed(_texts_of(docs, wanted).mapInArrow(_scan_sets(n, percent, True, node_bits), _SETS), clashing)
    found = stage(sets.select("node", "n", "tokens"), "jaccard-sets")
    # a document is found again only where rows repeat its id and text
    return found if found.count() <= wanted.count() else stage(found.dropDuplicates(["node"]), "jaccard-sets")


def word_shingles(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    words = (text or "").encode().lower().split()  # of bytes: A-Z alone, and the six blanks
    return set(zip(*[words[k:] for k in range(n)], strict=False)) if len(words) >= n else {tuple(words)} if words else set()


def _verify(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, set()
        for batch in batches:
            ends, mask = batch.column("b").to_pylist(), []
            for k, b in enumerate(ends):
                if held is None or held != b:
                    held, own = b, word_shingles(batch.column("text_b")[k].as_py(), n)
                other = word_shingles(batch.column("text_a")[k].as_py(), n)
                both = len(own & other)
                mask.append(100 * both >= percent * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    return run


class _Corpus:
    """Documents (doc_id, row, text), their nodes (node, n, sketch, doc_id, row), and the test of pairs of nodes on their words."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, n: int, percent: int):
        self.docs, self.nodes, self.n, self.percent = docs, nodes, n, percent

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        pairs = stage(pairs, "jaccard-pairs")
        few = pairs.count() <= BROADCAST_IDS
        named = self.nodes.select("node", F.col("doc_id").alias("w_id"), F.col("row").alias("w_row"))
        a = stage(pairs.join(named.withColumnRenamed("node", "a"), "a"), "jaccard-named")
        b = stage(named.withColumnRenamed("node", "b").join(pairs.select("b").distinct(), "b"), "jaccard-named")
        same = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("row") == F.col("w_row"))
        left, right = (self.docs.join(F.broadcast(x) if few else x, same).withColumnRenamed("text", t).drop("doc_id", "row", "w_id", "w_row") for x, t in ((a, "text_a"), (b, "text_b")))
        # a document is found again only where rows repeat its id and text
        return left.join(right.hint("merge"), "b").mapInArrow(_verify(self.n, self.percent), "a long, b long").distinct()


def _fits(percent: int):
    """Two postings (n, need) and (m, other_need) of a key may pair: by the sizes, and by the prefixes that these ask for."""
    t = F.expr(f"({percent} * (n + m) + {99 + percent}) div {100 + percent}")
    by_size = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    return by_size & (F.col("need") <= F.col("n") - t) & (F.col("other_need") <= F.col("m") - t)


def _close(percent: int):
    """The bitmaps differ in no more bits than tokens that two linked sets of these sizes may have in one of them alone."""
    t = F.expr(f"({percent} * (n + m) + {99 + percent}) div {100 + percent}")
    differ = sum((F.bit_count(F.get("sketch", F.lit(k)).bitwiseXOR(F.get("other_sketch", F.lit(k)))) for k in range(SKETCH_WORDS)), F.lit(0))
    return differ <= F.col("n") + F.col("m") - 2 * t


def _paired_before(percent: int):
    """The two sets share a smaller key that they may use, among the least keys of either: the pair is made there."""
    t = F.expr(f"({percent} * (n + m) + {99 + percent}) div {100 + percent}")

    def usable(keys: str, room):
        return F.transform(F.filter(keys, lambda x: (x["key"] < F.col("key")) & (x["need"] <= room)), lambda x: x["key"])

    return F.arrays_overlap(usable("least", F.col("n") - t), usable("other_least", F.col("m") - t))


def _pair(a: str = "node", b: str = "other") -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _across(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs of postings of a key that may link, of different components.

    Both sides rename every column alike, so that one exchange serves both.
    """
    own = ("key", "node", "n", "need", "comp", "least", "sketch")
    left = postings.select(*[F.col(c).alias(f"own_{c}") for c in own])
    right = postings.select(*[F.col(c).alias(x) for c, x in zip(own, ("other_key", "other", "m", "other_need", "other_comp", "other_least", "other_sketch"), strict=True)])
    both = left.join(right, F.col("own_key") == F.col("other_key")).withColumnsRenamed({f"own_{c}": c for c in own})
    apart = (F.col("node") < F.col("other")) & (F.col("comp") != F.col("other_comp")) & _fits(percent)
    return both.where(apart & _close(percent) & ~_paired_before(percent))


def _centres(postings: DataFrame, turn: int) -> DataFrame:
    """Postings with one set of their key (other, m, other_need, other_comp): the one of most weight at first, any other in later turns."""
    rank = F.col("weight") if turn == 0 else F.xxhash64("node", F.lit(turn))
    chosen = F.max(F.struct(rank.alias("rank"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("need").alias("other_need"), F.col("comp").alias("other_comp")))
    return postings.join(postings.groupBy("key").agg(chosen.alias("x")).select("key", "x.other", "x.m", "x.other_need", "x.other_comp"), "key")


def _links(keys: DataFrame, corpus: _Corpus) -> DataFrame:
    """Verified edges (a, b) that connect all that any shared key connects."""
    percent = corpus.percent
    ends = F.struct("node", "n", "need")
    lists = stage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(ends).alias("x"), F.max(ends).alias("y")).where("c > 1"), "jaccard-lists")
    # a list of two is a pair; longer ones are dealt to centres
    twos = lists.where("c = 2").select("key", "x.*", F.col("y.node").alias("other"), F.col("y.n").alias("m"), F.col("y.need").alias("other_need"))
    twos = twos.where((F.col("node") != F.col("other")) & _fits(percent)).select(*_pair())
    long = lists.where("c > 2").select("key", "c")
    long = F.broadcast(long) if long.count() <= BROADCAST_IDS else long
    longer = stage(keys.join(long, "key"), "jaccard-longer")
    weight = longer.groupBy("node").agg(F.sum("c").alias("weight"))
    postings = stage(longer.drop("c").join(weight, "node").withColumn("comp", F.col("node")), "jaccard-open")
    edges, before = None, float("inf")
    for turn in range(4):
        apart = (F.col("comp") != F.col("other_comp")) & _fits(percent)
        pairs = _centres(postings, turn).where(apart).select(*_pair())
        found = corpus.verified((pairs.union(twos) if turn == 0 else pairs).distinct())
        edges = stage(found if edges is None else edges.union(found).distinct(), "jaccard-edges")
        labels = components(edges)
        few = labels.count() <= BROADCAST_IDS
        postings = postings.drop("comp").join(F.broadcast(labels) if few else labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        by_comp = postings.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"))
        spread = by_comp.groupBy("key").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        spread = stage(spread, "jaccard-spread")
        rows, left = spread.agg(F.sum("s"), F.sum(F.col("s") * F.col("s") - F.col("q")) / 2).first()
        if not rows:
            return edges
        postings = stage(postings.join(spread.select("key"), "key"), "jaccard-open")
        if left <= MANY_PAIRS * rows or left > 0.8 * before:
            break
        before = left
    least = F.slice(F.array_sort(F.collect_list(F.struct("key", "need"))), 1, LEAST_KEYS).alias("least")
    sketches = corpus.nodes.select("node", "sketch")
    postings = stage(postings.drop("weight").join(postings.groupBy("node").agg(least).join(sketches, "node"), "node"), "jaccard-across")
    across = _across(postings, percent)
    # written, since it is read more than once
    return stage(edges.union(corpus.verified(across.select(*_pair()).distinct())), "jaccard-edges")


def _one_of_each(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The row of ``rows`` that stands for each node. Rows with sets are not shuffled for it unless very many are copies."""
    several = nodes.where("k > 1").select("node", F.col("doc_id").alias("own_id"), F.col("row").alias("own_row"))
    other = ~(F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("row") == F.col("own_row")))
    copies = rows.select("node", "doc_id", "row").join(several.hint("merge"), "node").where(other).select("doc_id", "row").distinct()
    copies = stage(copies.select(F.col("doc_id").alias("c_id"), F.col("row").alias("c_row")), "jaccard-copies")
    few = copies.count() <= BROADCAST_IDS
    left = rows.join(F.broadcast(copies) if few else copies, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("row") == F.col("c_row")), "left_anti")
    repeated = rows.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("k")).where("k > 1").take(1)
    return stage(left.dropDuplicates(["node"]), "jaccard-one") if repeated else left


def _nodes(rows: DataFrame) -> DataFrame:
    """A row per node: its set's size and bitmap, its first document, its documents, and whether its sets are several."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    own = [F.first("n").alias("n"), F.first("sketch").alias("sketch"), first.alias("x"), F.count(F.lit(1)).alias("k"), (F.min("second") != F.max("second")).alias("several")]
    return stage(rows.where("node is not null").groupBy("node").agg(*own).select("node", "n", "sketch", "x.doc_id", "x.row", "k", "several"), "jaccard-nodes")


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, node_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, row (hash of the text), comp (a label of the component), n_shingles, component_id.

    A set holds the distinct shingles of ``n`` words (A-Z lower-cased, cut at
    ``[\\x20\\x09-\\x0D]``); fewer words are one shingle; null texts and texts
    without words have none and link with nothing: their component is their own
    id. The component is the smallest id that is reachable by links; null ids are
    passed over, and where no other is known it is null. Sets are taken for equal where two 64-bit hashes of their
    shingles are; ``node_bits`` shortens the first one, results stay the same. Links are verified on the words themselves.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    rows = stage(docs.mapInArrow(_scan_sets(n, percent, False, node_bits), _SETS), "jaccard-rows")
    nodes, clashing = _nodes(rows), None
    if nodes.where("several").take(1):
        clashing = nodes.where("several").select("node")
        rows = stage(_renamed(rows, clashing), "jaccard-rows")
        nodes = _nodes(rows)
    rows = rows.drop("second", "sketch")
    can = _one_of_each(rows.where(F.size("tokens") > 0), nodes)

    counts = stage(can.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "jaccard-counts")
    spark = docs.sparkSession
    frequent, dense = _frequent(counts).sent(spark), None
    sent = [frequent]
    # Sets with too few rare tokens among the measured ones are counted as a whole. That makes more tokens frequent, and so
    # some more sets dense; they need no count of their own, since all that matters is that every set sees the same classes.
    for known in (None, frequent):
        found = stage(can.mapInArrow(_dense(frequent, percent, known), "node long, doc_id long, row long"), "jaccard-dense")
        if not found.take(1):
            break
        more = _whole_sets(docs, found, n, percent, node_bits, clashing)
        dense = more if dense is None else dense.unionByName(more)
        if known is None:
            tokens = dense.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
            frequent = (frequent | _frequent(stage(tokens, "jaccard-dense-counts"))).sent(spark)
            sent.append(frequent)
    # a key of one set only links nothing: most such rare tokens are left out before any shuffle
    shared, whole = Marks.of(counts), None
    if dense is not None:
        # rare tokens of dense sets may be others than those that were counted
        whole = stage(dense.mapInArrow(_emit_keys(frequent, percent), _KEYS), "jaccard-dense-keys")
        shared = shared | Marks.of(whole, "key")
    shared = shared.sent(spark)
    keys = can.mapInArrow(_emit_keys(frequent, percent, shared), _KEYS)
    keys = stage(keys if whole is None else keys.unionByName(whole), "jaccard-keys")
    for marks in (*sent, shared):
        marks.drop()
    labels = components(_links(keys, _Corpus(docs, nodes, n, percent)))
    placed = nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    placed = stage(placed.join(least, "comp").select("node", "comp", "component_id"), "jaccard-components")
    return rows.join(placed.hint("merge"), "node", "left").select(
        "doc_id", "row", "comp", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def similarity_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return similarity_components(docs, **options).drop("row", "comp")


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the row of the smallest id of each component; columns stay.

    Rows without words stay. Where rows repeat the smallest id within a component,
    the one with the least text hash stays; rows that repeat id and text are one.
    """
    rows = similarity_components(docs, id_col, text_col, **options)
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    rows = stage(rows, "jaccard-result")
    own = rows.where(first & (F.col("n_shingles") > 0)).groupBy("comp").agg(F.min("row").alias("best"), F.countDistinct("row").alias("k"))
    twice = own.where("k > 1").select("comp", "best")
    gone = rows.where(~first).select("doc_id", "row")
    if twice.take(1):
        gone = gone.union(rows.where(first).join(twice, "comp").where("row != best").select("doc_id", "row"))
    h, key_id, key_row = fresh(docs, "row", "id", "key")
    gone = stage(gone.select(F.col("doc_id").alias(key_id), F.col("row").alias(key_row)).distinct(), "jaccard-gone")
    marked = docs.withColumn(h, F.xxhash64(text_col))
    same = marked[id_col].cast("long").eqNullSafe(gone[key_id]) & (marked[h] == gone[key_row])
    left = marked.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, same, "left_anti")
    again = rows.where(first).groupBy("doc_id", "row").count().where("count > 1").take(1)
    return (left.dropDuplicates([id_col, h]) if again else left).drop(h)
