"""N-gram Jaccard join by PartEnum signatures: exact, without all pairs of a group.

Texts become sets of hashed word shingles. Two sets of sizes a and b whose similarity reaches 0.8
differ in at most (a + b) / 9 elements, and neither is larger than 5 / 4 of the other. So, within a
band of sizes, the feature domain is partitioned, each part is split again, and subsets of the splits
are enumerated: a signature stands for what a set has in the chosen splits of one part.

* Level 1: parts in three splits, every choice of two. Where a part differs in at most one element,
  some choice is the same in both sets; of k // 2 + 1 parts, k bounding the difference, one is such.
* Level 2, for the sets of buckets that are large and still apart: parts in five splits, every choice
  of three, for parts that differ in at most two elements. Signatures stand for more elements.
* Then, for those of large buckets that are apart even so: each set's rarest elements, as many as it may lack of a linked
  set's and one more, by how many of these sets have them. Two linked sets have one of theirs in common, so
  sets that only share what is common, as lines that many texts have, don't meet any more.

Parts are taken in the order of their numbers, until enough of them have elements in more splits than may
differ; whichever of two sets stops first, the other has enumerated its parts as well. A set with too few
such parts signs all and again under another seed; two such sets both do, so they meet there.

A candidate pair first meets by sketches: an element flips one of two to four bits for each element of a
set, so two sketches differ in no more bits than the sets do in elements, and a pair whose sketches
differ in more than linked sets can is out. The others are checked on the sets themselves.

Links make components. A bucket's rows stream through one task in order of their sets, sixteen bytes each, and
leave only the pairs with its least set, which joins groups of near copies with work in proportion to their
rows. What remains apart in buckets of at most SMALL members is compared in full; larger buckets go on to the next level. Families that
its buckets hold together, but that aren't one component yet, are dealt into blocks, which tasks
compare two by two, returning links that span and no pairs. No link between different sets is lost.
That last step grows with the square of such a family; a family is one only if all levels put its sets together. Its blocks meet in rounds, so that
copies of about ROUND_ITEMS elements, or twice all that there are, are on disk at a time.

A node is a distinct set, however many copies there are: sets are told apart by 128 bits of a digest and
numbered once, in a table.

Null or empty text: an empty set, linked with nothing, its component its own doc_id. Repeated rows and
equal texts share a component. Fewer than five words: the whole sequence is the one shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexspan.llm.common import discard, partitions, release, small, staged

WORDS = 5
NUM, DEN = 80, 100  # linked if DEN * intersection >= NUM * union
LEVELS = ((3, 1), (5, 2))  # splits of a part, and how many of them a choice leaves out
SMALL = 32
BLOCK_ITEMS, BLOCK_SETS, COLUMNS, ROUND_ITEMS = 400_000, 2048, 2048, 50_000_000
TASK_ITEMS = 8_000_000  # elements whose signatures a task sorts: fewer rows than elements
MET_SETS = 100_000
HOT, FEW = 2_000, 100_000  # fewer than HOT nodes have more than a HOT-th of all edges; if that is more than FEW, theirs are joined by broadcast

#: Odd multipliers for mixing 64-bit numbers.
_LOW, _HALF = np.uint64((1 << 44) - 1), np.uint64(32)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + np.uint64((seed * 2 + 1) * int(_A) % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def shingles(text: str | None) -> np.ndarray:
    """The text's set, as sorted distinct numbers."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(h) - WORDS + 1, 1)
    out = np.full(n, np.uint64(min(len(h), WORDS)))
    for j in range(min(WORDS, len(h))):
        out *= _C
        out += h[j : j + n]
    out = mix(out)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def most_different(size: int, largest: int) -> int:
    """Elements in which a set of this size can differ from a linked one of at most ``largest``."""
    return (size + min(largest, size * DEN // NUM)) * (DEN - NUM) // (DEN + NUM)


def bands(size: int) -> list[tuple[int, int]]:
    """(band, its largest size): the set's own, and the next if a partner may be there."""
    band = size.bit_length()
    found = [(band, (1 << band) - 1)]
    if size * DEN // NUM >= 1 << band:
        found.append((band + 1, (2 << band) - 1))
    return found


#: For each level a row a split and a column a choice: 1 where the choice keeps the split.
_CHOICES = [np.array([[j not in gone for gone in combinations(range(splits), out)] for j in range(splits)], np.uint64) for splits, out in LEVELS]


@lru_cache(maxsize=64)
def _numbers(seed: int, n: int, level: int) -> tuple[np.uint64, np.ndarray, np.ndarray]:
    """For n parts under a seed: an odd multiplier that deals elements, a number for each split, and one for each part's choice."""
    cells, names = np.arange(n * LEVELS[level][0], dtype=np.uint64), np.arange(n * _CHOICES[level].shape[1], dtype=np.uint64)
    return mix(np.zeros(1, np.uint64), seed)[0] | np.uint64(1), mix(cells, seed + 2), mix(names, seed + 4).reshape(n, -1)


def signatures(s: np.ndarray, level: int = 0) -> np.ndarray:
    """The set's signatures: for each part in turn, a number for each choice of its splits that has elements."""
    (splits, out), choices, found = LEVELS[level], _CHOICES[level], []
    weights = ((s & _LOW) + np.uint64(1)).astype(np.float64)  # summed in the order of the elements, so equal splits have equal sums
    for band, largest in bands(len(s)):
        k = most_different(len(s), largest)
        if k == 0:
            continue  # only an equal set can be linked
        need, good, seed = k // (out + 1) + 1, 0, 128 * band + 64 * level
        n = 3 + (most_different(largest, largest) // (out + 1) + 1) * 21 // 20
        while good < need:
            turn, cells, names = _numbers(seed, n, level)
            fine = ((s * turn >> _HALF) * np.uint64(len(cells)) >> _HALF).view(np.int64)
            held = np.bincount(fine, weights, len(cells))  # what each split of each part holds
            some = held > 0
            grid = (mix(held.view(np.uint64) ^ cells, seed + 3) * some).reshape(n, splits)
            enough = np.cumsum(np.count_nonzero(some.reshape(n, splits), axis=1) > out)
            good = int(enough[-1])
            stop = int(np.searchsorted(enough, need)) + 1 if good >= need else n
            sums = grid[:stop] @ choices
            found.append((sums ^ names[:stop])[sums != 0])  # a choice without elements says nothing
            seed += 1 << 20
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _list(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def sketch(s: np.ndarray) -> bytes:
    """Which of 2 to 4 bits for each element have been flipped an odd number of times."""
    bits = 1 << max(len(s).bit_length() + 1, 3)
    return np.packbits(np.bincount((mix(s, 9) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def may_link(a: bytes, b: bytes, sizes: tuple[int, int]) -> bool:
    """Whether sizes and sketches leave it open that two sets are linked; the longer sketch is folded to the shorter."""
    if min(sizes) * DEN < max(sizes) * NUM:
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * (DEN + NUM) <= sum(sizes) * (DEN - NUM)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, k1, k2, n_shingles, digest (null for empty sets), and the text and sketch where this task meets the set for the first time."""
    release()
    met: set[bytes] = set()
    for b in small(batches):
        sizes, digests, texts, sketches = [], [], [], []
        for x in b.column("text").to_pylist():
            s = shingles(x)
            d = _digest(s) if len(s) else None
            sizes.append(len(s))
            digests.append(d)
            new = d is not None and d not in met
            texts.append(x if new else None)
            sketches.append(sketch(s) if new else None)
            if new:
                if len(met) >= MET_SETS:
                    met.clear()
                met.add(d)
        columns = [*(b.column(c) for c in ("doc_id", "k1", "k2")), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(texts, pa.string()), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "n_shingles", "digest", "text", "sketch"])


def _signer(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (sig, node) of texts (node, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [signatures(shingles(x), level) for x in b.column("text").to_pylist()]
            nodes = np.repeat(b.column("node").to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(nodes)], ["sig", "node"])

    return sign


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        yield pa.RecordBatch.from_arrays([b.column("node"), _list([shingles(x) for x in b.column("text").to_pylist()])], ["node", "items"])


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches, 20_000):
        rows = zip(*(b.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")), strict=True)
        yield b.select(["a", "b"]).filter(pa.array([may_link(x, y, (m, n)) for x, y, m, n in rows], pa.bool_()))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, node): those of buckets with two nodes or more, with the bucket's first node as hub; the hub itself has no row."""
    sig, hub, last = None, None, None
    for b in batches:
        s, n = b.column("sig").to_numpy(), b.column("node").to_numpy()
        if not len(s):
            continue
        fresh = np.r_[sig is None or s[0] != sig, s[1:] != s[:-1]]
        before = np.r_[n[0] if last is None else last, n[:-1]]
        repeat = ~fresh & (n == before)
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(s)), -1))
        hubs = np.where(at >= 0, n[np.maximum(at, 0)], hub if hub is not None else 0)
        sig, hub, last = s[-1], hubs[-1], n[-1]
        keep = ~fresh & ~repeat
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(hubs[keep]), pa.array(n[keep])], ["sig", "hub", "node"])


def _buckets(signed: DataFrame, elements: int) -> DataFrame:
    """(sig, hub, node): one row for each member of a bucket but its hub. Sets of so many elements are dealt into tasks that needn't spill."""
    tasks = -(-elements // TASK_ITEMS)
    dealt = signed.repartition("sig") if tasks <= partitions(signed.sparkSession) else signed.repartition(tasks, "sig")
    return dealt.sortWithinPartitions("sig", "node").mapInArrow(_shared, "sig long, hub long, node long")


def verified(pairs: DataFrame, texts: DataFrame, marks: DataFrame, made: list[str]) -> DataFrame:
    """Of distinct pairs (a, b) those that are linked: by ``marks`` (node, n_shingles, sketch) first, then by the sets of ``texts`` (node, text)."""
    side = lambda x: marks.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    left = staged(pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_open_pairs, "a long, b long"), "likely", made)
    sets = _items(texts, left.select(F.col("a").alias("node")).union(left.select("b")).distinct(), made)
    one, two = (sets.select(F.col("node").alias(n), F.col("items").alias(x)) for n, x in (("a", "x"), ("b", "y")))
    both = F.size(F.array_intersect("x", "y"))
    return left.join(two, "b").join(one, "a").filter(both * DEN >= (F.size("x") + F.size("y") - both) * NUM).select("a", "b")


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with ``m``, the least v of their u: summed before the shuffle, and for the few nodes with very many edges broadcast."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    many = max(total // HOT, FEW)
    if total <= many:  # no node can have more
        return edges.join(least.select("u", "m"), "u")
    hot = F.broadcast(least.filter(F.col("n") > many).select("u", "m"))
    cold = least.filter(F.col("n") <= many).select("u", "m")
    return edges.join(hot, "u").unionByName(edges.join(hot, "u", "left_anti").join(cold, "u"))


def _oriented(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()


def components(links: DataFrame, made: list[str] | None = None) -> DataFrame:
    """(node, comp): for each node that has a link, the least node of its component; by alternating large and small stars.

    The path of the table that the result reads is added to ``made``.
    """
    old: list[str] = []
    return _stars(staged(_oriented(links), "edges", old), old, made)


def _stars(edges: DataFrame, old: list[str], made: list[str] | None) -> DataFrame:
    """The components of edges (u, v), u > v, whose staged tables are ``old``: done when each node that has an edge to a lesser one has that alone."""
    spark = edges.sparkSession
    while True:
        total, open_ = _state(edges)
        if not open_:
            if made is not None:
                made += old
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        new: list[str] = []
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _with_least(both, 2 * total)
        large = staged(least.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large", new)
        low = _with_least(large, 2 * total)
        small_ = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        kept: list[str] = []
        edges = staged(small_, "edges", kept)
        discard(spark, old + new)
        old = kept


def _state(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are, and of how many nodes they aren't stars: those that are above one node and below another, or above two."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    said = each.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))).first()
    return said[0] or 0, said[1] or 0


def _merged(links: DataFrame, comps: DataFrame | None, made: list[str]) -> DataFrame:
    """Components of those that there are and of more links."""
    old: list[str] = []
    edges = staged(_oriented(links), "edges", old)
    if comps is None:
        return _stars(edges, old, made)
    if edges.isEmpty():
        discard(links.sparkSession, old)
        return comps
    return _stars(edges.union(comps.filter("node <> comp").select("node", "comp")), old, made)


def _comp(node: str, comps: DataFrame | None, df: DataFrame, name: str = "comp") -> DataFrame:
    if comps is None:
        return df.withColumn(name, F.col(node))
    of = comps.select(F.col("node").alias(node), F.col("comp").alias(name))
    return df.join(of, node, "left").withColumn(name, F.coalesce(name, node))


def _apart(pairs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of different components."""
    return _comp("b", comps, _comp("a", comps, pairs, "ca"), "cb").filter("ca <> cb").select("a", "b")


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (sig, hub, node) of buckets that still span two components, with ``comp`` and the bucket's ``n``."""
    of = W.partitionBy("sig")  # a bucket's rows stream and spill; they are three numbers each
    found = _comp("node", comps, members).withColumns({"lo": F.min("comp").over(of), "hi": F.max("comp").over(of), "n": F.count(F.lit(1)).over(of)})
    return found.filter("lo <> hi").drop("lo", "hi")


def _cross(members: DataFrame) -> DataFrame:
    """Pairs between components within small buckets."""
    a, b = (members.select("sig", F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    return a.join(b, "sig").filter("a < b AND ca <> cb").select("a", "b").distinct()


def _rare(texts: DataFrame, made: list[str]) -> DataFrame:
    """(sig, node): the elements of each set that come first by how many of these sets have them, one more than a linked set may lack.

    Elements of one set alone come before all others and have no row.
    """
    sets = _items(texts, texts.select("node"), made)
    each = sets.select("node", F.size("items").alias("n"), F.explode("items").alias("sig"))
    several = staged(each.groupBy("sig").agg(F.count(F.lit(1)).alias("had")).filter("had > 1"), "several", made)
    of = W.partitionBy("node")
    ranked = each.join(several, "sig").withColumns({"at": F.row_number().over(of.orderBy("had", "sig")), "shared": F.count(F.lit(1)).over(of)})
    return ranked.filter(F.col("n") - F.col("shared") + F.col("at") <= F.floor(F.col("n") * (DEN - NUM) / DEN) + 1).select("sig", "node")


def _blocks(ties: DataFrame, comps: DataFrame, texts: DataFrame, made: list[str], most: int = ROUND_ITEMS) -> DataFrame:
    """Links that join whatever is linked among the nodes that ties (a, b) hold together, directly or not.

    Such a family, unless it is one component already, is dealt into blocks of about BLOCK_ITEMS elements or BLOCK_SETS sets,
    and each two of its blocks meet in one task, which compares the one's sets with the other's by matrix products and returns a
    forest: at most a row for each node. A block is copied for each that it meets, in rounds of about ``most`` elements.
    """
    own = staged(_comp("node", comps, components(ties, made).withColumnRenamed("comp", "family")), "families", made)
    apart = own.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("family")
    open_ = staged(own.select("node", "family").join(apart, "family"), "families", made)
    rows = _items(texts, open_.select("node"), made).join(open_, "node")
    many = rows.groupBy("family").agg(F.greatest(F.ceil(F.sum(F.size("items")) / BLOCK_ITEMS), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks"))
    rows = rows.join(many, "family").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    total, copied = rows.agg(F.coalesce(F.sum(F.size("items")), F.lit(0)), F.coalesce(F.sum(F.size("items") * F.col("blocks").cast("long")), F.lit(0))).first()
    rounds = max(1, -(-copied // max(most, 2 * total)))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("one"), F.greatest(x, F.col("block")).alias("two")))
    found: DataFrame | None = None
    for i in range(rounds):
        now = F.filter(meets, lambda x: (x["one"] + x["two"]) % rounds == i)  # noqa: B023
        met = rows.select("family", "node", "items", "block", F.explode(now).alias("meet")).withColumn("first", F.col("block") == F.col("meet.one"))
        forest = staged(met.groupBy("family", "meet").applyInArrow(_compare, "a long, b long"), "forest", made)
        found = forest if found is None else found.unionByName(forest)
    return found


def _compare(group: pa.Table) -> pa.Table:
    """A forest of the links between the group's first block and its second, or within its only one."""
    nodes, first = group.column("node").to_numpy(), group.column("first").to_numpy()
    lists = group.column("items").combine_chunks()
    flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    flat, size = flat[ends[0] : ends[-1]], np.diff(ends)
    row = np.repeat(np.arange(len(nodes)), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    fresh = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1  # an element of one set alone is in no intersection
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    left = np.flatnonzero(first)
    right = np.flatnonzero(~first) if not first.all() else left
    at = np.zeros(len(nodes), np.int64)
    at[right] = np.arange(len(right))
    at[left] = np.arange(len(left))
    both = np.zeros((len(left), len(right)), np.int32)  # float32 is exact within a step only
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [start, start + COLUMNS])
        r, c = row[i:j], column[i:j] - start
        x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        mine = first[r]
        x[at[r[mine]], c[mine]] = 1
        if right is left:
            y = x
        else:
            y[at[r[~mine]], c[~mine]] = 1
        both += (x @ y.T).astype(np.int32)
    need = (size[left][:, None] + size[right][None, :]) * NUM
    near = both.astype(np.int64) * (DEN + NUM) >= need
    if right is left:
        np.fill_diagonal(near, False)
    return _forest(nodes, left, right, near)


def _forest(nodes: np.ndarray, left: np.ndarray, right: np.ndarray, near: np.ndarray) -> pa.Table:
    """Links that span whatever ``near`` (left by right) connects: searched breadth first, each side's open rows at a time."""
    a, b = [], []
    open_l, open_r = np.ones(len(left), bool), np.ones(len(right), bool)
    same = right is left
    if same:
        open_r = open_l
    for root in range(len(left)):
        if not open_l[root]:
            continue
        open_l[root] = False
        todo = [(True, root)]
        while todo:
            on_left, i = todo.pop()
            found = np.flatnonzero(near[i] & open_r) if on_left else np.flatnonzero(near[:, i] & open_l)
            (open_r if on_left else open_l)[found] = False
            mine, other = (left, right) if on_left else (right, left)
            a += [int(mine[i])] * len(found)
            b += other[found].tolist()
            todo += [(same or not on_left, int(x)) for x in found]
    return pa.table({"a": pa.array(nodes[a], pa.int64()), "b": pa.array(nodes[b], pa.int64())})


def join(df: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``df`` (doc_id, text; other columns are left out)."""
    found = _placed(*_linked(df))
    least = found.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return found.join(least, "comp", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def _keys() -> list[Column]:
    """A row's key, 128 bits: neither a null doc_id nor one that several texts share can mix texts up."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2")]


def representatives(df: DataFrame) -> DataFrame:
    """One row of ``df`` for each component: that with its least doc_id, a null one last; rows with empty sets all stay, repeated ones once."""
    found = _placed(*_linked(df))
    # of rows that share that id but not their text the one of the least key stays
    first = found.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "k1", "k2")).alias("first"))
    kept = first.select("first.k1", "first.k2").union(found.filter("comp IS NULL").select("k1", "k2")).distinct()
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *_keys()).join(kept, ["k1", "k2"], "left_semi")
    return rows.dropDuplicates(["k1", "k2"]).select("row.*")


def _placed(rows: DataFrame, nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, comp) of all rows; comp is null for empty sets."""
    each = _comp("node", comps, nodes).select("digest", "comp")
    some = rows.filter("digest IS NOT NULL").join(each, "digest")
    none = rows.filter("digest IS NULL").withColumn("comp", F.lit(None).cast("long"))
    return some.unionByName(none).drop("digest")


def _linked(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, k1, k2, n_shingles, digest) of all rows, (digest, node), and (node, comp) of the nodes that have links."""
    spark, made = df.sparkSession, []
    rows, texts = _distinct(df, made)
    comps, todo, marks = None, texts, None
    for level in range(len(LEVELS) + 1):
        hits, met = _hits(todo, level, made)
        marks = staged(texts.select("node", "n_shingles", "sketch").join(met, "node", "left_semi"), "marks", made) if marks is None else marks
        pairs = staged(hits.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs", made)
        comps = _merged(verified(_apart(pairs, comps), texts, marks, made), comps, made)
        # hubs have been compared; what is left of a bucket are the others
        left = staged(_open(hits, comps), "open", made)
        comps = _merged(verified(_cross(left.filter(F.col("n") <= SMALL)), texts, marks, made), comps, made)
        large = left.filter(F.col("n") > SMALL)
        if large.isEmpty():
            break
        todo = texts.join(staged(large.select("node").distinct(), "large", made), "node", "left_semi")
    else:
        ties = staged(large.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "ties", made)
        comps = _merged(_blocks(ties, comps, texts, made), comps, made)
    comps, ids = staged(comps, "components"), staged(texts.select("digest", "node"), "ids")
    discard(spark, made)
    return rows, ids, comps


def _distinct(df: DataFrame, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, n_shingles, digest) of all rows, and (node, digest, n_shingles, sketch, text): each distinct set once, numbered, with a text that has it."""
    schema = "doc_id long, k1 long, k2 long, n_shingles long, digest binary, text string, sketch binary"
    whole: list[str] = []
    each = staged(df.select("doc_id", "text", *_keys()).mapInArrow(_describe, schema), "described", whole)
    one = each.filter("text IS NOT NULL").groupBy("digest").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("text").alias("text"))
    nodes = staged(one.select(F.monotonically_increasing_id().alias("node"), "digest", "n_shingles", "sketch", "text"), "nodes", made)
    rows = staged(each.drop("text", "sketch"), "rows")
    discard(df.sparkSession, whole)
    return rows, nodes


def _hits(texts: DataFrame, level: int, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sig, hub, node) of signatures that several sets have, and their nodes; beyond the last level of rare elements."""
    signed = texts.select("node", "text").mapInArrow(_signer(level), "sig long, node long") if level < len(LEVELS) else _rare(texts, made)
    hits = staged(_buckets(signed, texts.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]), "buckets", made)
    return hits, staged(hits.select("node").union(hits.select("hub")).distinct(), "met", made)


def _items(texts: DataFrame, nodes: DataFrame, made: list[str]) -> DataFrame:
    """(node, items) of these nodes."""
    return staged(texts.select("node", "text").join(nodes, "node", "left_semi").mapInArrow(_sets, "node long, items array<long>"), "items", made)


def _pairs(hits: DataFrame) -> DataFrame:
    """All pairs (a, b) within buckets (sig, hub, node), each bucket dealt into parts of about SMALL members."""
    members = hits.select("sig", "node").union(hits.select("sig", F.col("hub").alias("node")).distinct())
    parts = hits.groupBy("sig").agg(F.ceil((F.count(F.lit(1)) + 1) / SMALL).cast("int").alias("parts"))
    dealt = members.join(parts, "sig").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    one = dealt.select("sig", "part", F.col("node").alias("a"))
    every = dealt.select("sig", F.col("node").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return one.join(every, ["sig", "part"]).filter("a < b").select("a", "b").distinct()


def links(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) of all rows of ``df``, and all verified pairs (a, b), a < b, of linked nodes; rows of equal sets have one node.

    Unlike ``join`` it compares all members of all buckets, so its work grows with the square of a family.
    """
    made: list[str] = []
    rows, texts = _distinct(df, made)
    hits, met = _hits(texts, 0, made)
    marks = staged(texts.select("node", "n_shingles", "sketch").join(met, "node", "left_semi"), "marks", made)
    size = hits.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    few = hits.join(size.filter(F.col("n") < SMALL), "sig", "left_semi")
    crowded = hits.join(size.filter(F.col("n") >= SMALL), "sig", "left_semi")
    many = staged(crowded.select("node").union(crowded.select("hub")).distinct(), "crowded", made)
    again, _ = _hits(texts.join(many, "node", "left_semi"), 1, made)
    found = staged(verified(_pairs(few).union(_pairs(again)).distinct(), texts, marks, made), "links")
    ids = staged(texts.select("digest", "node"), "ids")
    discard(df.sparkSession, made)
    nodes = rows.filter("digest IS NOT NULL").join(ids, "digest").unionByName(rows.filter("digest IS NULL").withColumn("node", F.lit(None).cast("long")))
    return nodes.select("doc_id", "n_shingles", "node"), found


def link_counts(df: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, n_links) for each row of ``df``: how many other rows it is linked with, those of equal sets among them."""
    each, pairs = links(df)
    copies = each.filter("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    both = pairs.union(pairs.select("b", "a")).toDF("node", "other")
    near = both.join(copies.toDF("other", "more"), "other").groupBy("node").agg(F.sum("more").alias("more"))
    counts = copies.join(near, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    return each.join(counts, "node", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))
