"""Jaccard join of word-shingle sets: all links at a threshold, and the groups that they make.

Documents with the same set form a class, and classes are joined. Two sets that reach the threshold share a shingle among the first
few of each in one global order, so that classes meet under those shingles only. Under one shingle they stand by size, so that a set
meets those of its size band, and each has a bitmap of hashed shingles: a bit that only one of two sets has stands for a shingle that
the other lacks, which bounds their overlap from above. What passes the bound falls into groups of candidates; the whole sets go to
the tiles of their group once, where they are compared by size and bitmap again and settled by intersecting the sorted arrays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import lookup, remove, small_batches, slices, written, written_at
from evspark.llm.exact_dedup import filter_bits, possibly_repeated
from evspark.llm.textscan import TO_LOWER, groups, mix, windows, words_of

#: Bits of a signature: four for each shingle, as a power of two in these bounds.
LEAST_BITS, MOST_BITS = 512, 1 << 17
#: Shingles that are put last in the order because many documents have them, at most (1 MB). Any order gives the same links.
LAST = 1 << 17
#: Documents with a shingle, in a thousandth of those that a task sees together, for it to be put last; shingles that are counted together.
OFTEN, COUNTED = 4, 1 << 20
#: Classes under one shingle of which pairs are made, at most; blocks of twice as many make the tiles of a group.
TILE = 256
#: Shingles of a block of a tile, about; a set with more is a block of its own.
TILE_SHINGLES = 1 << 19
#: Pairs that a task holds at a time.
PAIRS = 1 << 17
#: Bits for each shingle of the filter that sorts out shingles of one class (up to 64 MB in all).
BITS_A_SHINGLE = 8
#: Texts whose keys are broadcast to fetch them; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Of each text in UTF-8 the sorted distinct 64-bit hashes of its shingles, A-Z lower-cased. Fewer words than `width` make one shingle; no word, none."""
    out: list[np.ndarray] = []
    for lo, hi in groups(texts):
        h, counts = words_of([t.translate(TO_LOWER) for t in texts[lo:hi]])
        hashes, _, owner = windows(h, counts, width)
        ends = np.searchsorted(owner, np.arange(len(counts)), side="right")
        word_end = np.cumsum(counts)
        at = 0
        for k, n in enumerate(counts.tolist()):
            if n >= width:
                out.append(np.unique(hashes[at : ends[k]]))
            elif n:
                acc = np.full(1, np.uint64(n), np.uint64)
                for x in h[word_end[k] - n : word_end[k]]:
                    acc = mix(acc * _ODD + x)
                out.append(acc)
            else:
                out.append(np.empty(0, np.uint64))
            at = ends[k]
    return out


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """What a set of n shares at least with any set that it links to."""
    return (percent * n + 99) // 100


def prefix(s: np.ndarray, last: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the global order (by hash, those in `last` at the end): linked sets share one of them."""
    k = len(s) - least_overlap(len(s), percent) + 1
    if len(last):
        late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
        return np.concatenate([s[~late], s[late]])[:k]
    return s[:k]


def width_of(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (4 * n - 1).bit_length()))


def bitmap(s: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, bool)
    bits[(s >> np.uint64(7)).astype(np.int64) % width] = True
    return np.packbits(bits)


def may_link(n: np.ndarray, bits: np.ndarray, m: np.ndarray | int, other: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n can link with one of size m, by their sizes and their signatures (rows of 64-bit words)."""
    n_only = np.bitwise_count(bits & ~other).sum(axis=1, dtype=np.int64)
    m_only = np.bitwise_count(other & ~bits).sum(axis=1, dtype=np.int64)
    most = np.minimum(n - n_only, m - m_only)
    return 100 * most >= percent * (n + m - most)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in part.column("text").to_pylist()]


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]), pa.int32()), pa.array(flat, kind))


def text_key(text: str = "text") -> list[Column]:
    """Two 64-bit hashes that name a text."""
    return [F.xxhash64(F.coalesce(text, F.lit(""))).alias("k1"), F.xxhash64(F.lit(1), F.coalesce(text, F.lit(""))).alias("k2")]


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles that many documents have, sorted; LAST at most. It is a hint for the order alone."""
    small_batches(docs.sparkSession)

    def count(own: dict[bytes, np.ndarray], seen: int) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate([*own.values(), np.empty(0, np.uint64)]), return_counts=True)
        keep = n >= max(OFTEN, seen // 1000)
        return _batch(shingle=pa.array(found[keep].view(np.int64)), n=pa.array(n[keep], pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[bytes, np.ndarray] = {}
        seen = size = 0
        for part in slices(batches):
            for s in shingle_sets(_texts(part), width):
                key = hashlib.md5(s.tobytes()).digest()  # a copy adds nothing: it falls into the class of the other
                if key not in own:
                    own[key], size = s, size + len(s)
            seen += part.num_rows
            if size > COUNTED:
                yield count(own, seen)
                own, seen, size = {}, 0, 0
        yield count(own, seen)

    found = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "shingle").limit(LAST).toPandas()
    return np.sort(rows["shingle"].to_numpy(np.int64).view(np.uint64))


def signatures(docs: DataFrame, width: int, percent: int, last: np.ndarray) -> DataFrame:
    """id, k1, k2 (key of the text), n (size of the set), digest (of the whole set), prefix, bits."""
    late = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(_texts(part), width)
            yield _batch(
                id=part.column("id"), k1=part.column("k1"), k2=part.column("k2"), n=pa.array([len(s) for s in sets], pa.int32()),
                digest=pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()), prefix=_lists([prefix(s, late.value, percent) for s in sets], pa.int64()),
                bits=pa.array([bitmap(s, width_of(len(s))).tobytes() for s in sets], pa.binary()),
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", *text_key()).mapInArrow(run, f"id {kind}, k1 long, k2 long, n int, digest binary, prefix array<long>, bits binary")


def _pairs_by_size(key: np.ndarray, n: np.ndarray, c: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs under each key of rows that stand by key and size: each row meets the one that is 1, 2, ... places on, all rows at once."""
    at, a, b, held, step = np.arange(len(key)), [], [], 0, 1

    def made() -> pa.RecordBatch:
        x, y = c[np.concatenate(a)], c[np.concatenate(b)]
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        return _batch(a=pa.array(both[:, 0]), b=pa.array(both[:, 1]))

    while len(at := at[at + step < len(key)]):
        # places on, the key ends or the sets get too large, and both stay so
        at = at[(key[at] == key[at + step]) & (100 * n[at] >= percent * n[at + step])]
        a.append(at)
        b.append(at + step)
        held, step = held + len(at), step + 1
        if held > PAIRS:
            yield made()
            a, b, held = [], [], 0
    if a:
        yield made()


def _bits(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """Signatures of equal length, one row each, folded to `width` bits: their parts laid over each other."""
    raw = np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), np.uint64)
    return np.bitwise_or.reduce(raw.reshape(len(rows), -1, width // 64), axis=1)


def _passing(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1000):
        na, nb = (part.column(k).to_numpy().astype(np.int64) for k in ("na", "nb"))
        wide = np.stack([np.array([8 * len(x.as_buffer()) for x in part.column(k)]) for k in ("xa", "xb")], axis=1)
        keep = np.zeros(part.num_rows, bool)
        for wa, wb in np.unique(wide, axis=0):
            rows, width = np.flatnonzero((wide == (wa, wb)).all(axis=1)), int(min(wa, wb))
            keep[rows] = may_link(na[rows], _bits(part.column("xa"), rows, width), nb[rows], _bits(part.column("xb"), rows, width), percent)
        yield part.select(["a", "b"]).filter(pa.array(keep))


def narrow_pairs(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that share a key of TILE classes at most and pass the bounds. `members`: key, c, n; `classes`: c, n, bits.

    The classes of a key come one after the other to a task, which pairs whole batches of keys at a time by size; each pair is then
    tested once by its signatures.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            whole = int(np.argmax(rows[0] == rows[0][-1])) if len(rows[0]) else 0
            held = [x[whole:] for x in rows]  # of the last key more may come; it has TILE classes at most
            if whole:
                yield from _pairs_by_size(*(x[:whole] for x in rows), percent)
        yield from _pairs_by_size(*held, percent)

    dealt = members.select("key", F.col("n").cast("long").alias("n"), "c").repartition("key").sortWithinPartitions("key", "n", "c")
    pairs = dealt.mapInArrow(meet, "a long, b long").distinct()
    for k in "ab":
        pairs = pairs.join(classes.select(F.col("c").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"x{k}")), k)
    return pairs.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(lambda batches: _passing(batches, percent), "a long, b long")


def band_of(percent: int) -> Column:
    """Bands of set sizes so wide that linked sets are in the same or in neighbouring ones."""
    return F.floor(F.log("n") / (math.log(100 / percent) + 1e-9)).cast("long")


def by_band(wide: DataFrame, percent: int, total: int) -> DataFrame:
    """key, c, n, size for shingles of many classes: a key has two neighbouring size bands of a shingle, and keys of one class are left out. `wide`: shingle, c, n."""
    low = wide.withColumn("band", band_of(percent)).withColumn("low", F.explode(F.array("band", F.col("band") - 1)))
    keyed = written(low.select(F.xxhash64("shingle", "low").alias("key"), "c", "n"), "banded")
    return lookup(keyed, keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "key", "size", total)


def tiles(members: DataFrame, percent: int, total: int) -> DataFrame:
    """c, places: the tiles that each class of a group goes to. `members`: root (of the group), c, n.

    A tile has two neighbouring bands of a group; one of many classes, or of large ones, is dealt out to blocks by hash, of which each
    pair is a tile, so that no task gets more than two blocks.
    """
    each = members.withColumn("band", band_of(percent)).withColumn("low", F.explode(F.array("band", F.col("band") - 1)))
    each = written(each.select("c", "band", "low", "n", F.concat_ws("/", F.col("root").cast("string"), F.col("low").cast("string")).alias("tile")), "bands")
    sizes = each.groupBy("tile").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).filter("size > 1")
    sized = lookup(each, sizes, "tile", "size", total)
    blocks = F.greatest(F.ceil(F.col("size") / (2 * TILE)), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    placed = sized.withColumn("blocks", F.least(blocks, F.col("size").cast("int"))).withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks").cast("long")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = F.struct("tile", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", (F.col("band") > F.col("low")).alias("upper"))
    return placed.groupBy("c").agg(F.collect_list(place).alias("places"))  # twice the blocks of its tiles


def _links_of(rows: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) of a tile, enough to connect what they connect."""
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("hashes")]
    n, c = np.array([len(s) for s in sets], np.int64), rows.column("c").to_numpy()
    order = np.lexsort((c, n))
    sets, n, c = [sets[i] for i in order], n[order], c[order]
    block, upper = rows.column("own").to_numpy()[order], rows.column("upper").to_numpy()[order]
    bits = np.stack([bitmap(s, width_of(int(n[-1]))) for s in sets]).view(np.uint64)
    across = rows.column("lo")[0] != rows.column("hi")[0]
    root, out = np.arange(len(n)), []
    top = np.searchsorted(n, 100 * n // percent, side="right")  # sets that are not too large for it
    for i in range(len(n) - 1):
        at = np.arange(i + 1, top[i])
        # two sets of the upper band meet in the next tile
        at = at[(root[at] != root[i]) & ((block[at] != block[i]) if across else True) & ~(upper[at] & upper[i])]
        if len(at):
            for j in at[may_link(n[at], bits[at], n[i], bits[i], percent)]:
                if root[j] != root[i] and linked(sets[i], sets[j], percent):
                    root[root == root[j]] = root[i]
                    out.append((min(c[i], c[j]), max(c[i], c[j])))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def tile_links(docs: DataFrame, placed: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) among the classes of each tile. `docs`: text; `placed`: c, places, k1, k2 (key of a text of the class), digest.

    The texts are read and cut again, one for each class, and a whole set goes to each tile of its class. A tile gives enough of its
    links to connect what they connect, and not all pairs.
    """
    texts, keys = docs.select("text", *text_key()), placed.select("k1", "k2")
    if keys.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(keys), ["k1", "k2"], "left_semi")
    once = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    kind = placed.schema["places"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            sets = shingle_sets(_texts(part), width)
            if any(hashlib.md5(s.tobytes()).digest() != w for s, w in zip(sets, part.column("digest").to_pylist(), strict=True)):
                raise ValueError("two texts share a key of 128 bits")
            yield _batch(c=part.column("c"), places=part.column("places"), hashes=pa.array([s.tobytes() for s in sets], pa.binary()))

    sets = once.join(placed, ["k1", "k2"]).select("text", "c", "digest", "places").mapInArrow(cut, f"c long, places {kind}, hashes binary")
    spread = sets.select("c", "hashes", F.explode("places").alias("p")).select("c", "hashes", "p.*")
    return spread.groupBy("tile", "lo", "hi").applyInArrow(lambda rows: _links_of(rows, percent), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node that it is connected with) for the nodes of `edges` (a, b).

    Large stars and small stars in turn: each node's larger neighbours, then its smaller ones, are hung on the least of its
    neighbours, until nothing changes. A node may have any number of neighbours: its least is found by partial aggregation, and
    looked up with hot nodes broadcast.
    """
    spark = edges.sparkSession
    now, folder = written_at(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = lookup(both, least, "u", "degree", 2 * seen[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        between, old = written_at(large.filter("u != v").distinct(), "large-stars")
        remove(spark, folder)
        least = between.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        small = lookup(between, least, "u", "degree", 2 * seen[0])
        hung = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now, folder = written_at(hung.distinct(), "small-stars")
        remove(spark, old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (the least id that links lead to, its own included).

    Two rows link when the intersection of their sets is at least `percent` hundredths of the union. A null or empty text, or one of
    white space, has an empty set and links with nothing. Equal sets always link, so that repeated rows share a component; of rows
    with a null id the component is the least other id, or null if there is none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sig = written(signatures(rows, width, percent, common_shingles(rows, width)), "signatures")
    full = sig.filter("n > 0")
    total = full.count()
    same = full.groupBy("digest").agg(
        F.min("id").alias("least"), F.min(F.struct("k1", "k2")).alias("key"), F.count(F.lit(1)).alias("copies"),
        F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"),
    )
    classes = written(same.select("*", "key.*").drop("key").withColumn("c", F.monotonically_increasing_id()), "classes")
    posted = classes.select(F.explode("prefix").alias("shingle"), "c", "n")
    # most shingles have one class: a filter sorts out those before classes are dealt out by shingle
    bits = filter_bits(classes.agg(F.sum(F.size("prefix"))).first()[0] or 0, BITS_A_SHINGLE)
    posted = written(possibly_repeated(posted, "shingle", bits, 1).filter("maybe").drop("maybe"), "posted")
    shared = written(posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared")
    members = written(lookup(posted, shared, "shingle", "size", total), "members")
    banded = written(by_band(members.filter(F.col("size") > TILE), percent, total), "banded-members")
    narrow = members.filter(F.col("size") <= TILE).select(F.col("shingle").alias("key"), "c", "n").unionByName(banded.filter(F.col("size") <= TILE).drop("size"))
    pairs = written(narrow_pairs(narrow, classes, percent), "pairs")
    # a key of many classes makes no pairs: its classes are one group, in which the tiles go on
    wide = banded.filter(F.col("size") > TILE)
    least = wide.groupBy("key").agg(F.min("c").alias("b"), F.first("size").alias("n"))
    stars = lookup(wide.select("key", F.col("c").alias("a")), least, "key", "n", total).select("a", "b")
    near = written(components(pairs.unionByName(stars)), "candidate-groups")
    sized = near.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("size"))
    grouped = lookup(near, sized, "root", "size", total).select("root", F.col("node").alias("c")).unionByName(sized.select("root", F.col("root").alias("c")))
    grouped = written(grouped.join(classes.select("c", "n"), "c"), "grouped")
    placed = written(tiles(grouped, percent, total).join(classes.select("c", "k1", "k2", "digest"), "c"), "tiles")
    roots = components(tile_links(rows, placed, width, percent))
    placed = classes.select("digest", "c", "least", "copies").join(roots, F.col("c") == F.col("node"), "left").withColumn("root", F.coalesce("root", "c")).drop("node", "c")
    placed = written(placed, "placed")
    in_group = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    by_class = lookup(placed, in_group, "root", "classes", total).select("digest", "copies", "component_id")
    alone = sig.filter("n = 0").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    found = lookup(full.select("id", F.col("n").cast("long").alias("n"), "digest"), by_class, "digest", "copies", total)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component, with all columns: that of the least id; one without an id only if all lack one, and of rows that repeat the id the one of the least text digest.

    Rows are numbered, written, and compared by their numbers, so that repeated and missing ids are rows of their own.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered-rows")
    groups = near_duplicates(rows, width, percent, "__row", text_col).select("__row", "component_id")
    groups = written(groups, "near-duplicates")
    linked = groups.filter(F.col("__row") != F.col("component_id"))  # a component has its least row besides these
    members = linked.unionByName(linked.select(F.col("component_id").alias("__row"), "component_id").distinct())
    place = F.struct(F.col(id_col).isNull().alias("lacks"), F.col(id_col).alias("id"), F.md5(text_col).alias("digest"), F.col("__row").alias("row"))
    ranked = written(rows.select("__row", place.alias("place")).join(members, "__row"), "members")
    kept = ranked.groupBy("component_id").agg(F.min("place").alias("best")).select(F.col("best.row").alias("__kept"))
    gone = written(ranked.select("__row").join(kept, F.col("__row") == F.col("__kept"), "left_anti"), "near-copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)
