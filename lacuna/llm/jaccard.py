"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

1. Every text becomes its sorted set of shingle hashes. Texts with equal sets are one
   class from here on, known by the set's digest.
2. Linked sets have sizes within the threshold of each other, so sizes fall into bands
   and only sets of the same or neighbouring bands can link. In a tile of two such bands linked sets
   differ in at most d shingles; the hash range is cut into more than d parts, so
   they agree on one part at least. Each part's content, hashed, is a key under
   which sets meet. Nothing is missed.
3. Keys that two sets may share are found by counting 40 bits of each, with partial sums, so that a key of very
   many sets is never held by one task. A filter of bounded size, which loses none of them, picks the few keys that are
   worth moving. Where sets meet, hashed bitmaps come along: bit counts bound the overlap of a pair
   from above, and a meeting keeps only the pairs the bound lets through, as few edges as connect them. So a passage
   that many texts share brings them together under a key but doesn't tie them into one cluster.
4. In the clusters that remain, pairs are intersected exactly, again behind the bound.

Meetings and clusters are worked through in bounded tiles. Pairs already connected are
not compared again, so a family of near copies costs about one comparison each, and no
list of all pairs ever exists.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .runtime import BROADCAST_BYTES, arrow_map, chunks, join_counted, materialize, release, spread, unused

#: Sets in a block of a large group; a tile holds two blocks at most.
BLOCK = 512
#: Sets that stand in every block of a large group, to connect blocks cheaply.
PIVOTS = 8
#: Bytes of sets or bitmaps that one call gets, in whole tiles.
CALL_BYTES = 8 << 20
#: Bits of a key that are counted, and keys for each word of the filter, which never has more than ``BROADCAST_BYTES``.
COUNTED_BITS, KEYS_A_WORD = 40, 4
#: Keys in a shard of the filter, about, which one call builds.
SHARD_KEYS = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the text's word n-grams; with fewer words, of the whole sequence.

    Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and
    carriage return, with A-Z lower-cased.
    """
    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    size = len(h) - n + 1
    total = h[:size].copy()
    for i in range(1, n):
        total = mix(total) + h[i : i + size]
    return np.unique(mix(total))


class Bands:
    """Bounds of the size bands and, per tile, the number of parts; for a threshold in hundredths."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, -(-self.bounds[-1] * 100 // percent)))
        self.starts = np.array(self.bounds)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    @lru_cache(maxsize=None)  # noqa: B019
    def parts(self, tile: int) -> tuple[int, int, int, int]:
        """(most shingles in which linked sets of the tile differ, parts, smallest part that makes a key, parts that may be smaller).

        Linked sets agree on more parts than may be too small to make a key. Keys of two
        shingles or more are taken where a few more parts than differences leave enough of them.
        """
        a = self.bounds[tile + 1] - 1
        b = min(self.bounds[tile + 2] - 1, a * 100 // self.percent)
        differ = (100 - self.percent) * (a + b) // (100 + self.percent)
        least = self.bounds[tile]
        for small, more in ((2, differ // 2 + 4), (1, differ + 8)):
            for parts in range(differ + 1, differ + more):
                mean = least / parts
                share = np.exp(-mean) * (1 + mean * (small == 2))
                may = parts - differ - 1
                if may >= parts * share + 3 * np.sqrt(parts * share) and mean > 1:
                    return differ, parts, small, may
        may = 1 + differ // 50
        return differ, differ + 1 + may, 1, may

    def keys(self, found: np.ndarray) -> np.ndarray:
        """The keys of a set in the tile that its band begins and in the one that it ends.

        A set with more small parts than foreseen gives keys for all its parts, empty ones
        too; a linked set that agrees with it on small parts only then does as well.
        """
        band = self.band(len(found))
        out = []
        for tile in (band - 1, band):
            if tile < 0:
                continue
            differ, parts, small, may = self.parts(tile)
            if not differ:
                continue  # linked sets of this tile are equal, so of one class
            part = ((found >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            sums = np.add.reduceat(mix(found + np.uint64(tile + 1)), starts)
            at = part[starts]
            large = np.diff(np.r_[starts, len(found)]) >= small
            if parts - int(large.sum()) > may:
                gone = np.setdiff1d(np.arange(parts, dtype=np.uint64), at)
                at, sums = np.r_[at, gone], np.r_[sums, np.zeros(len(gone), np.uint64)]
            else:
                at, sums = at[large], sums[large]
            out.append(mix(mix(sums) + at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tile)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap(found: np.ndarray) -> bytes:
    """The set's hashes as bits of a map at least as wide as the set, from 256 to 16,384 bits."""
    width = 1 << int(np.clip(np.ceil(np.log2(max(1, len(found)))), 8, 14))
    bits = np.zeros(width, np.uint8)
    bits[(found & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(raw: bytes, words: int) -> np.ndarray:
    """A bitmap on fewer bits: those of its equal parts, one over the other."""
    return np.bitwise_or.reduce(np.frombuffer(raw, np.uint64).reshape(-1, words), axis=0)


@lru_cache(maxsize=8)
def bands_of(percent: int) -> Bands:
    return Bands(percent)


SETS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_hash", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("node", T.LongType()),
        T.StructField("bits", T.BinaryType()),
        T.StructField("keys", T.ArrayType(T.LongType(), False)),
        T.StructField("task", T.IntegerType()),
    ]
)


class Known(set):
    """Digests that a task has met, while there is room."""

    def new(self, digest: bytes) -> bool:
        if digest in self:
            return False
        if len(self) < 100_000:
            self.add(digest)
        return True


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def shingle_sets(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Size and digest of each row's set, its bitmap and its keys; a task gives the last two of equal sets once."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches):
        hashes, known, bands, task = WordHashes(), Known(), bands_of(percent), TaskContext.get().partitionId()
        kind = pa.list_(pa.field("element", pa.int64(), nullable=False))
        for batch in chunks(batches, "text", 2 << 20):
            out: dict = {"n": [], "digest": [], "node": [], "bits": []}
            keys: list[np.ndarray | None] = []
            for text in batch.column(2).to_pylist():
                found = shingles(text, n, hashes)
                digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                new = digest is not None and known.new(digest)
                out["n"].append(len(found))
                out["digest"].append(digest)
                out["node"].append(_node(digest) if digest else None)
                out["bits"].append(bitmap(found) if new else None)
                keys.append(bands.keys(found) if new else None)
            offsets = np.concatenate(([0], np.cumsum([0 if k is None else len(k) for k in keys]))).astype(np.int32)
            some = [k for k in keys if k is not None]
            values = np.concatenate(some).view(np.int64) if some else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), type=kind)
            yield out | {"doc_id": batch.column(0), "text_hash": batch.column(1), "keys": lists, "task": [task] * len(keys)}

    return arrow_map(spread(rows), run, SETS)


class KeyFilter:
    """Bloom filters of one word a key, one for each remainder of a key's counted bits. They hold every key that went in, and some others."""

    def __init__(self, words: np.ndarray):
        self.words = words  # a row for each shard

    @staticmethod
    def places(short: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A key's word among its shard's ``size`` and the three bits it has there."""
        h = mix(short + np.uint64(0x9E3779B97F4A7C15))
        one, six = np.uint64(1), np.uint64(63)
        bits = one << (h & six) | one << (h >> np.uint64(6) & six) | one << (h >> np.uint64(12) & six)
        return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64), bits

    @classmethod
    def shard(cls, short: np.ndarray, size: int) -> np.ndarray:
        words = np.zeros(size, np.uint64)
        at, bits = cls.places(short, size)
        np.bitwise_or.at(words, at, bits)
        return words

    def holds(self, short: np.ndarray) -> np.ndarray:
        shards, size = self.words.shape
        at, bits = self.places(short, size)
        return self.words[(short % np.uint64(shards)).astype(np.int64), at] & bits == bits


def key_filter(shared: DataFrame) -> KeyFilter:
    """The filter of the counted bits in ``shared`` (short). With more keys than fit ``BROADCAST_BYTES`` it lets more others through."""
    rows = shared.count()
    shards = rows // SHARD_KEYS + 8
    size = max(1, min(rows // KEYS_A_WORD, max(0, BROADCAST_BYTES) // 8) // shards)
    kind = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("words", T.BinaryType())])
    target = pa.schema([("shard", pa.int32()), ("words", pa.binary())])

    def build(table: pa.Table) -> pa.Table:
        words = KeyFilter.shard(table.column("short").to_numpy().view(np.uint64), size)
        return pa.table({"shard": [table.column("shard")[0].as_py()], "words": [words.tobytes()]}, schema=target)

    built = shared.withColumn("shard", (F.col("short") % shards).cast("int")).groupBy("shard").applyInArrow(build, kind)
    words = np.zeros((shards, size), np.uint64)
    for row in built.collect():
        words[row.shard] = np.frombuffer(row.words, np.uint64)
    return KeyFilter(words)


def meetings(sets: DataFrame) -> DataFrame:
    """(key, node), each once, of all keys that sets of two nodes have and of some others, as a written table.

    The keys lie in the written sets. Of each only the counted bits are shuffled, once; of the whole keys, only those
    that the filter lets through. So bytes moved follow the number of keys at any size.
    """
    holders = sets.where(F.size("keys") > 0).select("node", "keys", "task")
    # Tasks that met equal sets gave their keys more than once; the first task's are enough.
    again = materialize(holders.groupBy("node").agg(F.min("task").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "repeated-sets")
    if again.count() * 64 <= BROADCAST_BYTES:
        holders = holders.join(F.broadcast(again), "node", "left").where("first IS NULL OR first = task")
    low = (1 << COUNTED_BITS) - 1
    short = holders.select(F.explode("keys").alias("key")).select(F.col("key").bitwiseAND(F.lit(low)).alias("short"))
    shared = materialize(short.groupBy("short").agg(F.count("*").alias("c")).where("c > 1").select("short"), "shared-keys")
    held = sets.sparkSession.sparkContext.broadcast(key_filter(shared))

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            passed = np.flatnonzero(held.value.holds(keys.view(np.uint64) & np.uint64(low)))
            nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
            yield {"key": keys[passed], "node": nodes[passed]}

    kind = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", T.LongType())])
    met = materialize(arrow_map(holders.select("node", "keys"), run, kind).distinct(), "meetings")
    release(again, shared)
    held.destroy()
    return met


def candidate_clusters(sets: DataFrame, percent: int) -> DataFrame:
    """(node, cluster) of sets that the bitmaps' bound connects with another set under some key.

    Every shuffle is either pre-aggregated or spread by more than the key.
    """
    met = meetings(sets)
    hashed = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    company = met.groupBy("key").agg(F.count("*").alias("m"), *hashed).where("m > 1")
    # Near copies meet under many keys in the same company; one meeting of each company is enough.
    once = company.groupBy("m", "h1", "h2").agg(F.min("key").alias("key")).select("key", "m", F.col("m").alias("rows"))
    once = materialize(once, "companies")
    maps = sets.where("bits IS NOT NULL").groupBy("node", "n").agg(F.first("bits").alias("payload"))
    members = join_counted(met, once, ["key"]).join(maps, "node")
    members = members.select(F.col("key").alias("cluster"), "m", F.col("node").alias("rep"), F.lit(0).alias("band"), "n", "payload")
    members = materialize(members, "members")
    release(met, once)
    found = components(connect(members, percent, exact=False)).withColumnRenamed("component", "cluster")
    release(members)
    return found


def bound(sizes: np.ndarray, other_size: int, maps: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The most shingles that sets can share with another, by the bits that only one side has."""
    a = sizes - np.bitwise_count(maps & ~other).sum(1, dtype=np.int64)
    b = other_size - np.bitwise_count(other & ~maps).sum(1, dtype=np.int64)
    return np.minimum(a, b)


def link_tile(ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, maps: list[bytes], percent: int, sets: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """Links that connect what the threshold connects among these sets, between different labels only.

    Each set meets the smaller ones that are not yet connected with it, those with the highest
    bound first; within a component the first link ends the search. Without ``sets`` the bound alone decides.
    """
    words = min(map(len, maps)) // 8
    order = np.argsort(sizes, kind="stable")
    sizes, ids = sizes[order], ids[order]
    table = np.stack([folded(maps[i], words) for i in order])
    comp = np.unique(labels[order], return_inverse=True)[1]
    links = []
    for i in range(1, len(order)):
        low = int(np.searchsorted(sizes[:i], -(-percent * sizes[i] // 100)))
        near = low + np.flatnonzero(comp[low:i] != comp[i])
        if not near.size:
            continue
        most = bound(sizes[near], int(sizes[i]), table[near], table[i])
        fits = 100 * most >= percent * (sizes[i] + sizes[near] - most)
        for j in near[fits][np.argsort(-most[fits], kind="stable")].tolist():
            if comp[j] == comp[i]:
                continue
            if sets is not None:
                a, b = sets[order[i]], sets[order[j]]
                at = np.searchsorted(a, b)
                common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                if 100 * common < percent * (len(a) + len(b) - common):
                    continue
            links.append((int(ids[i]), int(ids[j])))
            comp[comp == comp[j]] = comp[i]
    return links


def as_stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges that connect the same, each from a component's smallest member."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return [(x, r) for x in list(top) if (r := root(x)) != x]


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _links(members: DataFrame, percent: int, exact: bool, calls: int) -> DataFrame:
    """Links within each (cluster, tile) of members (cluster, tile, rep, label, n, payload); whole tiles share a call."""
    target = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        group = table.column("group").to_numpy()
        reps, labels, sizes = (table.column(c).to_numpy() for c in ("rep", "label", "n"))
        raw = table.column("payload").to_pylist()
        order = np.lexsort((reps, group))
        starts = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])
        found = []
        for at in np.split(order, starts[1:]):
            at = at[np.unique(reps[at], return_index=True)[1]]
            if len(at) < 2:
                continue
            sets = [np.frombuffer(raw[i], np.uint64) for i in at] if exact else None
            maps = [bitmap(x) for x in sets] if exact else [raw[i] for i in at]
            found += as_stars(link_tile(reps[at], labels[at], sizes[at], maps, percent, sets))
        return pa.table({"a": [x for x, _ in found], "b": [x for _, x in found]}, schema=target)

    keyed = members.withColumn("group", F.xxhash64("cluster", "tile"))
    keyed = keyed.withColumn("call", F.pmod(F.xxhash64("group"), F.lit(calls)))
    return keyed.select("call", "group", "rep", "label", "n", "payload").groupBy("call").applyInArrow(run, LINKS)


def connect(members: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Links among the members (cluster, m, rep, band, n, payload) of each cluster of m, enough to connect all that links connect.

    Clusters of up to two blocks are one tile. Larger ones are cut into blocks by band and
    hash. A first pass connects each block's members and a few pivots that stand in every
    block; clusters that it leaves in several pieces go on to tiles of two blocks, where
    only members of different pieces are compared. ``members`` is a written table.
    """

    def calls(df: DataFrame) -> int:
        rows, size = df.agg(F.count("*"), F.sum(F.octet_length("payload") + 48)).first()
        return max(rows // (2 * BLOCK), (size or 0) // CALL_BYTES) + 1

    fits = F.col("m") <= 2 * BLOCK
    small = members.where(fits).withColumns({"tile": F.lit(""), "label": F.col("rep")})
    links = materialize(_links(small, percent, exact, calls(members)), "links")
    big = members.where(~fits)
    if big.isEmpty():
        return links

    blocks = big.groupBy("cluster", "band").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = materialize(blocks, "blocks")
    total = blocks.groupBy("cluster").agg(F.sum("blocks").alias("all"))
    big = join_counted(big, materialize(blocks.join(total, "cluster"), "blocks"), ["cluster", "band"])
    big = materialize(big.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "large-clusters")
    tile = F.concat_ws("-", "band", "block")
    # About a block's worth of members, by another hash, of which the first few are the pivots.
    drawn = F.when(F.pmod(F.xxhash64("rep", F.lit(1)), F.col("all")) == 0, F.struct(F.xxhash64("rep", F.lit(2)).alias("h"), "rep"))
    pivots = big.groupBy("cluster").agg(F.slice(F.sort_array(F.collect_list(drawn)), 1, PIVOTS).alias("p")).select("cluster", F.explode("p.rep").alias("rep"))
    stands = big.join(pivots, ["cluster", "rep"], "left_semi").select("cluster", "rep", "n", "payload")
    places = big.select("cluster", tile.alias("tile")).distinct()
    first = big.select("cluster", tile.alias("tile"), "rep", "n", "payload").unionByName(places.join(stands, "cluster"))
    first = materialize(first.withColumn("label", F.col("rep")), "blocks-with-pivots")
    links = links.unionByName(materialize(_links(first, percent, exact, calls(first)), "links"))
    release(first)

    labels = components(links).select(F.col("node").alias("rep"), F.col("component").alias("label"))
    tagged = materialize(big.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "labelled-clusters")
    ends = tagged.groupBy("cluster").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("rows")).where("lo <> hi")
    if ends.isEmpty():
        return links
    others = blocks.groupBy("cluster").agg(F.collect_list(F.struct(F.col("band").alias("band"), F.col("blocks").alias("blocks"))).alias("others"))
    tagged = join_counted(tagged, materialize(ends.join(others, "cluster").select("cluster", "others", "rows"), "open-clusters"), ["cluster"])
    beside = F.filter("others", lambda o: F.abs(o["band"] - F.col("band")) <= 1)
    ways = F.flatten(F.transform(beside, lambda o: F.transform(F.sequence(F.lit(0), o["blocks"] - 1), lambda k: F.struct(o["band"].alias("band"), k.alias("block")))))
    paired = tagged.withColumn("theirs", F.explode(ways))
    mine = F.struct("band", "block")
    paired = paired.where(mine != F.col("theirs"))
    tile = F.concat_ws("+", F.least(mine, "theirs").cast("string"), F.greatest(mine, "theirs").cast("string"))
    second = materialize(paired.select("cluster", tile.alias("tile"), "rep", "n", "payload", "label"), "block-pairs")
    links = links.unionByName(materialize(_links(second, percent, exact, calls(second)), "links"))
    release(second)
    return links


def _classes(sets: DataFrame) -> DataFrame:
    """One row per distinct set: digest, node, n, m (its rows), first_id (the smallest id) and source, the row that its text is loaded from."""
    source = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    return sets.where("n > 0").groupBy("digest", "node", "n").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("m"), F.min(source).alias("source"))


def _candidates(docs: DataFrame, sets: DataFrame, classes: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The members (cluster, m, rep, band, n, payload) that the exact pass compares, as a written table."""
    clusters = materialize(candidate_clusters(sets, percent), "clusters")
    size = clusters.groupBy("cluster").agg(F.count("*").alias("m")).select("cluster", "m", F.col("m").alias("rows"))
    clusters = join_counted(clusters, materialize(size, "cluster-sizes"), ["cluster"])
    bound_array = F.array(*[F.lit(b).cast("long") for b in bands_of(percent).bounds])
    wanted = classes.join(clusters.withColumnRenamed("m", "members"), "node")
    wanted = wanted.withColumn("band", F.size(F.filter(bound_array, lambda b: b <= F.col("n"))) - 1)
    wanted = wanted.select("digest", "source", F.col("node").alias("rep"), "cluster", F.col("members").alias("m"), "n", "band")
    wanted = materialize(wanted, "candidates")
    members = materialize(_load(docs, wanted, n, id_col, text_col), "members")
    if members.count() == wanted.count():
        return members
    # Exact copies that share an id, or have none, were all read; one stays.
    keep = [c for c in members.columns if c != "payload"]
    return materialize(members.groupBy(*keep).agg(F.first("payload").alias("payload")), "members")


def _name(sets: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes with component_id, the smallest id among the classes that links connect."""
    tagged = materialize(classes.join(components(links), "node", "left"), "tagged-classes")
    alone, some = tagged.where("component IS NULL"), tagged.where("component IS NOT NULL")
    firsts = some.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("rows"))
    named = join_counted(some, materialize(firsts, "component-ids"), ["component"])
    return named.unionByName(alone.withColumn("component_id", F.col("first_id")))


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id.

    Two texts link when their sets of word n-grams have a Jaccard similarity of at least
    ``percent`` hundredths; the component is the smallest id reachable by links, the text's
    own included. Texts without words (null and empty ones too) have an empty set and
    link with nothing. Sets are told apart by their content, so ids may repeat: the texts of one id link each
    for itself. Rows with a null id take part; a component of such rows alone has
    a null component. Other columns are not read; an empty table gives no rows.
    """
    return _found(docs, n, percent, id_col, text_col)[0]


def _found(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """The rows of ``jaccard_classes`` and the scratch tables that they are read from."""
    sets = materialize(shingle_sets(docs, n, percent, id_col, text_col), "shingle-sets")
    classes = materialize(_classes(sets), "classes")
    members = _candidates(docs, sets, classes, n, percent, id_col, text_col)
    named = _name(sets, classes, connect(members, percent, exact=True))
    release(members)
    named = materialize(named.select("digest", "component_id", F.col("m").alias("rows")), "components")
    release(classes)
    some = join_counted(sets.where("n > 0").select("doc_id", "n", "digest"), named, ["digest"])
    none = sets.where("n = 0").select("doc_id", "n", "digest", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id"), (sets, named)


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, but only one of each component: that with the smallest id.

    Where ids repeat or are null, rows are numbered in a written copy first and the first of each component
    stays. Rows without words all stay. Columns may have any names.
    """
    ids = docs.agg(F.count("*"), F.count(id_col), F.count_distinct(id_col)).first()
    columns, key = docs.columns, id_col
    if len(set(ids)) > 1:
        key = unused(docs, "row")[0]
        docs = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    found, tables = _found(docs, n, percent, key, text_col)
    gone_id = unused(docs, "gone")[0]
    gone = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)), "duplicates")
    release(*tables)
    if gone.count() * 64 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    kept = docs.join(gone, F.col(key).cast("long") == F.col(gone_id), "left_anti")
    return kept.select(*columns)


def _load(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Candidates (digest, source, rep, cluster, m, n, band) with their sets as payload.

    A candidate's text is found by id and text hash together, so rows without an id don't
    meet each other; exact copies that also share the id are all read.
    """
    keep = ["cluster", "m", "rep", "band", "n"]
    keys = wanted.select(F.col("source.text_hash").alias("text_hash"), F.coalesce("source.doc_id", F.lit(0)).alias("id"), F.col("source.no_id").alias("no_id"), "digest", *keep)
    if wanted.count() * 160 <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    own, text = F.col(id_col).cast("long"), F.col(text_col)
    rows = docs.select(F.xxhash64(text).alias("text_hash"), F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("no_id"), text.alias("text"))
    schema = T.StructType([*wanted.select(*keep).schema.fields, T.StructField("payload", T.BinaryType())])

    def run(batches):
        hashes = WordHashes()
        for batch in chunks(batches, "text", 2 << 20):
            out: dict = {f.name: [] for f in schema}
            columns = [c.to_pylist() for c in batch.columns]
            for text, digest, *rest in zip(*columns):
                found = shingles(text, n, hashes).tobytes()
                if xxhash.xxh3_128_digest(found) == digest:
                    for name, value in zip(out, (*rest, found)):
                        out[name].append(value)
            yield out

    return arrow_map(rows.join(keys, ["text_hash", "id", "no_id"]).select("text", "digest", *keep), run, schema)


def links_of_tile(own: bool, left: np.ndarray, ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """All links of a tile: among all its sets if it is a block's own, else between those of ``left`` and the others."""
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    maps = [bitmap(x) for x in sets]
    words = min(map(len, maps)) // 8
    table = np.stack([folded(maps[i], words) for i in order])
    sizes, left = sizes[order], left[order]
    links = []
    for i in range(1, len(order)):
        low = int(np.searchsorted(sizes[:i], -(-percent * sizes[i] // 100)))
        near = np.arange(low, i) if own else low + np.flatnonzero(left[low:i] != left[i])
        most = bound(sizes[near], int(sizes[i]), table[near], table[i])
        a = sets[order[i]]
        for j in near[100 * most >= percent * (sizes[i] + sizes[near] - most)].tolist():
            b = sets[order[j]]
            common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
            if 100 * common >= percent * (len(a) + len(b) - common):
                links.append((int(ids[order[i]]), int(ids[order[j]])))
    return links


def every_link(members: DataFrame, percent: int) -> DataFrame:
    """All links (a, b) among the members (cluster, m, rep, band, n, payload) of each cluster, each once.

    Clusters are cut into blocks by band and hash; a tile is one block or two of the same
    or neighbouring bands, and every pair of sets that can link stands in exactly one.
    """
    blocks = materialize(members.groupBy("cluster", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    tagged = members.join(blocks, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    beside = blocks.select("cluster", F.col("band").alias("other"), F.col("blocks").alias("other_blocks"))
    paired = tagged.join(beside, "cluster").where(F.abs(F.col("other") - F.col("band")) <= 1)
    paired = paired.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    mine, theirs = F.struct("band", "block"), F.struct(F.col("other").alias("band"), F.col("at").alias("block"))
    tile = F.concat_ws("+", F.least(mine, theirs).cast("string"), F.greatest(mine, theirs).cast("string"))
    paired = paired.select(F.xxhash64("cluster", tile).alias("group"), (mine == theirs).alias("own"), (mine < theirs).alias("left"), "rep", "payload")
    paired = materialize(paired, "tiles")
    total = paired.agg(F.sum(F.octet_length("payload") + 48)).first()[0] or 0
    target = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        group, own, left, reps = (table.column(c).to_numpy() for c in ("group", "own", "left", "rep"))
        raw = table.column("payload").to_pylist()
        order = np.lexsort((reps, group))
        starts = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])
        found = []
        for at in np.split(order, starts[1:]):
            at = at[np.unique(reps[at], return_index=True)[1]]
            found += links_of_tile(bool(own[at[0]]), left[at], reps[at], [np.frombuffer(raw[i], np.uint64) for i in at], percent)
        return pa.table({"a": [x for x, _ in found], "b": [x for _, x in found]}, schema=target)

    call = F.pmod(F.xxhash64("group"), F.lit(int(total / CALL_BYTES) + 1))
    return materialize(paired.withColumn("call", call).groupBy("call").applyInArrow(run, LINKS), "links")


def jaccard_links(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``jaccard_classes`` with n_links: the number of other rows whose texts link with the row's.

    Here all candidate pairs of classes are compared, also those already connected, and a
    link with a class counts as many times as the class has rows.
    """
    sets = materialize(shingle_sets(docs, n, percent, id_col, text_col), "shingle-sets")
    classes = materialize(_classes(sets), "classes")
    links = every_link(_candidates(docs, sets, classes, n, percent, id_col, text_col), percent)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(classes.select(F.col("node").alias("b"), "m"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("m").alias("linked"))
    named = _name(sets, classes, links).join(linked, "node", "left")
    named = named.select("digest", "component_id", (F.col("m") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.col("m").alias("rows"))
    some = join_counted(sets.where("n > 0").select("doc_id", "n", "digest"), materialize(named, "components"), ["digest"])
    none = sets.where("n = 0").select("doc_id", "n", "digest", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
