"""Exact set-similarity self-join of documents on word n-grams, with set relations.

A document's set is its different n-grams, as 64-bit hashes. Two documents link
when ``100 * |x & y| >= percent * |x | y|``. The answer is each document's class:
the documents it reaches by links.

1. Equal sets become one node (a hash of the set; nodes that a second hash shows to
   stand for different sets are told apart by that one), so copies cost nothing
   further on.
2. Linked sets differ in few elements, so of more parts of the hash space than that
   some part holds the same elements of both. The index has a list for each part's
   position, band of sizes and content: a set is in the lists of its band and the one
   below, and sets of other sizes are never met. A two-count Bloom filter of the keys
   tells which lists may have two members; only those are sent. A passage that many
   documents share makes no list, as the rest of the part differs.
3. Every node is compared with one pivot, the least node of all its lists, if their
   parity bitmaps (about one bit an element, which bound the difference of two sets
   from below) allow that they are alike, linked or nearly. Its relation to the pivot
   is kept: elements of the pivot that it lacks, and its own that the pivot lacks.
   Links found are joined to classes.
4. The members of a pivot are a star, and their answers follow from the pivot's: two
   sets with one pivot overlap in ``|x & y| = |p| - |Dx u Dy| + |Ax n Ay|``, so links
   between them need no set again. Members outside the pivot's class are matched
   against the star by an index on the relations, whose lists are ordered by position
   (how many elements of a member's relation are left from there on), and blocks that
   can't reach the overlap needed are skipped. Stars with many members are cut into
   blocks, one task for each pair of blocks that has work.
5. Lists that lie in one class are done. Of the others, which hold sets that are not
   alike the pivot they were compared with, bitmaps tell which members may link with a
   member of another class; those are related to the list's own pivot and matched as
   in 4.

Only relations, never all pairs of a group, are written; no list, class or
fingerprint table reaches the driver, and what is broadcast are bounded filters.
Whole sets are written and sent only of nodes in a pair that bitmaps leave open, not
of all in some list; tables and shuffles go as soon as the next step is written.

Defined cases: a null text counts as empty; an empty set links with nothing, and
the document's class is its own id; a text shorter than an n-gram is one element;
null ids never name a class while another id can; an empty table gives an empty
result; other columns are carried along by `keep_one`.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import discard, drop_shuffles, free_name, lean, stage
from .lm_scoring import Words

WIDTH = 5
PERCENT = 80
#: Slots of the key filter that a key fills.
KEY_PROBES = 2
#: Per cent by which a set that is related to its pivot may fall short of a link.
ALIKE = 10
#: Members of a block of a star, and bytes of their relations.
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20
BATCH = 256
#: Words that a task remembers at a time.
WORDS_HELD = 1 << 17
LAST = (1 << 63) - 1


def sets_of(texts: list, width: int, words: Words) -> list[np.ndarray]:
    """The sorted different elements of each text."""
    tokens, ends = [], [0]
    for t in texts:
        tokens += (t or "").encode("utf-8", "replace").lower().split()
        ends.append(len(tokens))
    ids = words.numbers(tokens)
    h = words.hashes[ids]
    with np.errstate(over="ignore"):
        rolled = bloom.mix(h + np.uint64(1))
        for k in range(1, width):
            rolled = bloom.mix(rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[k:]) if len(rolled) > 1 else rolled[:0]
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                whole = bloom.mix(h[a : a + 1] + np.uint64(1))
                for k in range(a + 1, b):
                    whole = bloom.mix(whole * np.uint64(0x9E3779B97F4A7C15) + h[k : k + 1])
                out.append(bloom.mix(whole + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


class Sets:
    """Sets of batches of texts, with bounded memory for words."""

    def __init__(self, width: int):
        self.width, self.words = width, Words()

    def __call__(self, texts: list):
        for i in range(0, len(texts), BATCH):
            if len(self.words.number) > WORDS_HELD:
                self.words = Words()
            yield from sets_of(texts[i : i + BATCH], self.width, self.words)


def node_of(s: np.ndarray, shared: frozenset = frozenset()) -> int:
    """shared: hashes that different sets have; those sets go by their second hash."""
    import xxhash

    node = xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)
    return check_of(s) if node in shared else node


def check_of(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes(), seed=1) - (1 << 63)


class Parts:
    """Bands of set sizes and the number of parts in each.

    A set of band k links with sets of band k and k + 1 or smaller ones, never with
    others. In band k linked sets, the smaller of them in it, differ in fewer than
    ``most[k]`` elements. ``spare[k]`` more parts make up for parts without elements:
    a set has keys for those only if it has more of them than that, and then so does
    whatever links with it by such parts alone.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.edges, self.most, self.spare = [1], [], []

    def upto(self, n: int) -> None:
        while self.edges[-1] <= n:
            first = self.edges[-1]
            following = max(first + 1, first * 100 // self.percent + 1)
            both = following - 1 + (following - 1) * 100 // self.percent
            most = both * (100 - self.percent) // (100 + self.percent) + 1
            self.most.append(most)
            self.spare.append(math.ceil(2 * most * math.exp(-first / (most + 1))) + 2 if most > 1 else 0)
            self.edges.append(following)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The keys of a set in its own band and the one below."""
        self.upto(len(s))
        own = bisect.bisect_right(self.edges, len(s)) - 1
        out = []
        with np.errstate(over="ignore"):
            where = bloom.mix(s ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)
            value = bloom.mix(s + np.uint64(0xE7037ED1A0B428DB))
            for band in (own, own - 1) if own else (own,):
                n = self.most[band] + self.spare[band]
                part = ((where * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
                held = np.zeros(n, np.uint64)
                np.add.at(held, part, value)
                full = np.zeros(n, bool)
                full[part] = True
                k = bloom.mix(held + bloom.mix(np.arange(n, dtype=np.uint64) + np.uint64(band << 32)))
                out.append(k if n - full.sum() > self.spare[band] else k[full])
        return np.concatenate(out)

    def count(self, n: int) -> int:
        """How many keys a set of a size has at most."""
        self.upto(n)
        own = bisect.bisect_right(self.edges, n) - 1
        return sum(self.most[k] + self.spare[k] for k in ((own, own - 1) if own else (own,)))


def _digest(width: int, percent: int):
    """Rows of documents: id, n, node, check, how many keys it has at most, and the hash of its text that came with it."""
    names = ["id", "n", "node", "check", "keys", "text_key"]

    def run(batches):
        sets, parts = Sets(width), Parts(percent)
        for b in batches:
            rows = [(doc, len(s), node_of(s), check_of(s), parts.count(len(s))) if len(s) else (doc, 0, None, None, 0) for doc, s in zip(b.column(0).to_pylist(), sets(b.column(1).to_pylist()), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), b.column(2)], names=names)

    return run


def _keys(width: int, percent: int, test=None, shared: frozenset = frozenset()):
    """The keys of each different set of a task; with a test, (node, keys, n, bitmap) with the keys that pass it, without nodes that have none."""

    def run(batches):
        sets, parts, seen = Sets(width), Parts(percent), set()
        for b in batches:
            nodes, found, fresh = [], [], []
            for s in sets(b.column(0).to_pylist()):
                if len(s) and (node := node_of(s, shared)) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    found.append(parts.keys(s).view(np.int64))
                    if test is not None:
                        fresh.append((len(s), bitmap_of(s)))
            if not nodes:
                continue
            size = np.array([len(k) for k in found], np.int64)
            keys = np.concatenate(found)
            if test is None:
                yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])
                continue
            ok = test(keys)
            counts = np.add.reduceat(ok.astype(np.int64), np.cumsum(size) - size)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(keys[ok]))
            n, bitmaps = zip(*fresh, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), lists, pa.array(n, pa.int64()), pa.array(bitmaps, pa.binary())], names=["node", "keys", "n", "bitmap"]).filter(pa.array(counts > 0))

    return run


def bitmap_of(s: np.ndarray) -> bytes:
    """For each of 2**k >= max(256, elements) slots, whether an odd number of elements falls in it."""
    bits = max(256, 1 << (len(s) - 1).bit_length())
    slot = (bloom.mix(s + np.uint64(0x8EBC6AF09C88C6E3)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all folded to the shortest one's length."""
    length = min(map(len, bitmaps))
    out = np.zeros((len(bitmaps), length // 8), np.uint64)
    for k, b in enumerate(bitmaps):
        w = np.frombuffer(b, "<u8")
        while len(w) > length // 8:
            w = w[: len(w) // 2] ^ w[len(w) // 2 :]
        out[k] = w
    return out


def may_link(differ, a, b, percent: int):
    """differ: a lower bound of the number of elements in one set alone."""
    both = a + b
    return (differ <= both - 2 * -(-percent * both // (100 + percent))) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))


def _near_pairs(percent: int):
    """Of (pivot, node, pn, n, pb, b), the pairs whose bitmaps don't rule a link out."""

    def run(batches):
        for batch in batches:
            pivot, node, pn, n, pb, b = (batch.column(i).to_pylist() for i in range(6))
            differ = np.array([int(np.bitwise_count(np.bitwise_xor(*folded([x, y]))).sum()) for x, y in zip(pb, b, strict=True)], np.int64)
            ok = may_link(differ, np.array(pn, np.int64), np.array(n, np.int64), percent)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["pivot", "node"]).filter(pa.array(ok))

    return run


def _near_members(percent: int):
    """Rows (pivot, i, j, block, node, n, comp, b) in order of (pivot, i, j): the members that may link with one of another class."""

    def kept(held):
        i, j = held[0]["i"], held[0]["j"]
        bits = folded([r["b"] for r in held])
        n, comp, block = (np.array([r[c] for r in held], np.int64) for c in ("n", "comp", "block"))
        mine, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
        keep = np.zeros(len(held), bool)
        for k in mine:
            at = other[(comp[other] != comp[k]) & (100 * np.minimum(n[other], n[k]) >= percent * np.maximum(n[other], n[k]))]
            if len(at):
                at = at[may_link(np.bitwise_count(bits[at] ^ bits[k]).sum(axis=1, dtype=np.int64), n[at], n[k], percent)]
                keep[at] = True
                keep[k] |= len(at) > 0
        found = [held[k]["node"] for k in np.flatnonzero(keep)]
        return pa.RecordBatch.from_arrays([pa.array([held[0]["pivot"]] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["pivot", "node"])

    def run(batches):
        key, held = None, []
        for b in batches:
            for r in b.to_pylist():
                k = (r["pivot"], r["i"], r["j"])
                if k != key and held:
                    yield kept(held)
                    held = []
                key = k
                held.append(r)
        if held:
            yield kept(held)

    return run


def _sets(width: int, test, shared: frozenset):
    """(node, data) of each different set of a task, of rows (text, key) whose key passes the test."""
    kinds = (pa.int64(), pa.binary())

    def run(batches):
        sets, seen = Sets(width), set()
        for b in batches:
            rows = []
            b = b.filter(pa.array(test(b.column(1).to_numpy(zero_copy_only=False))))
            for s in sets(b.column(0).to_pylist()):
                if len(s) and (node := node_of(s, shared)) not in seen:
                    seen.add(node)
                    rows.append((node, _short(s)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["node", "data"])

    return run


def _short(s: np.ndarray) -> bytes:
    """Elements by the 6 low bytes of their hashes, sorted."""
    low = np.sort(s & np.uint64((1 << 48) - 1))
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def links(overlap, a, b, percent: int):
    return overlap * (100 + percent) >= percent * (a + b)


RELATIONS = "pivot long, node long, n_pivot long, n long, lacks binary, adds binary, linked boolean"


def _relate(percent: int):
    """From (pivot, node, pivot_data, data): what the set lacks of the pivot (places in it) and what it adds."""
    names = [x.split()[0] for x in RELATIONS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]

    def run(batches):
        last, p = None, None
        for b in batches:
            rows = []
            for pivot, node, pd, d in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if pivot != last:
                    last, p = pivot, _long(pd)
                x = _long(d)
                at = np.searchsorted(p, x)
                hit = p[np.minimum(at, len(p) - 1)] == x
                there = np.zeros(len(p), bool)
                there[at[hit]] = True
                rows.append((pivot, node, len(p), len(x), np.flatnonzero(~there).astype("<i4").tobytes(), x[~hit].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), bool(links(int(hit.sum()), len(p), len(x), percent))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


class _Star:
    """Members of a pair of blocks of one star: relations as sorted numbers, negative for what is lacked."""

    def __init__(self, rows, n_pivot: int):
        self.node, self.n, self.comp = (np.array([r[k] for r in rows], np.int64) for k in ("node", "n", "comp"))
        self.lacks = np.array([len(r["lacks"]) // 4 for r in rows], np.int64)
        self.diff = [np.concatenate([-1 - np.frombuffer(r["lacks"], "<i4").astype(np.int64)[::-1], _long(r["adds"]).astype(np.int64)]) for r in rows]
        self.size = np.array([len(d) for d in self.diff], np.int64)
        self.shared = n_pivot - self.lacks


class _Lists:
    """Lists of the relations' elements; each is ordered by how many elements its member has from there on, most first."""

    def __init__(self, star: _Star):
        who = np.repeat(np.arange(len(star.diff)), star.size)
        element = np.concatenate(star.diff) if len(star.diff) else np.zeros(0, np.int64)
        rest = np.concatenate([np.arange(len(d), 0, -1) for d in star.diff]) if len(star.diff) else element
        by = np.lexsort((-rest, element))
        self.who, self.rest, element = who[by], rest[by], element[by]
        self.elements, self.first = np.unique(element, return_index=True)
        self.last = np.append(self.first[1:], len(element))

    def reaching(self, diff: np.ndarray, need: int) -> np.ndarray:
        """Members that may share `need` elements of diff: by its first elements, and in each list only the blocks with enough left."""
        found = []
        head = diff[: len(diff) - need + 1]
        at = np.searchsorted(self.elements, head)
        for k in at[(at < len(self.elements)) & (self.elements[np.minimum(at, len(self.elements) - 1)] == head)]:
            a, b = self.first[k], self.last[k]
            found.append(self.who[a : a + np.searchsorted(-self.rest[a:b], -need, side="right")])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def match_star(rows: list[dict], percent: int):
    """Links between members outside the pivot's class (role 0) and the star's (role 1), one for each two classes they join."""
    n_pivot = rows[0]["n_pivot"]
    probes, star = (_Star([r for r in rows if r["role"] == k], n_pivot) for k in (0, 1))
    if not len(probes.node) or not len(star.node):
        return
    lists = _Lists(star)
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    for i in range(len(probes.node)):
        least = -(-percent * (probes.n[i] + star.n) // (100 + percent))  # the overlap a link needs
        need = least - n_pivot + probes.lacks[i] + star.lacks
        fits = (100 * np.minimum(star.n, probes.n[i]) >= percent * np.maximum(star.n, probes.n[i])) & (star.comp != probes.comp[i])
        fits &= need <= np.minimum(probes.size[i], star.size)
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        lowest = int(need[at].min())
        if lowest > 0:
            at = np.intersect1d(at, lists.reaching(probes.diff[i], lowest), assume_unique=True)
        for k in at:
            a, b = find(int(probes.comp[i])), find(int(star.comp[k]))
            if a != b and len(np.intersect1d(probes.diff[i], star.diff[k], assume_unique=True)) >= need[k]:
                root[max(a, b)] = min(a, b)
                yield int(probes.comp[i]), int(star.comp[k])


def _match(percent: int):
    def run(batches):
        key, held = None, []

        def done():
            found = list(match_star(held, percent))
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for b in batches:
            for r in b.to_pylist():
                k = (r["pivot"], r["i"], r["j"])
                if k != key and held:
                    yield done()
                    held = []
                key = k
                held.append(r)
        if held:
            yield done()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of edges (a, b): comp is the least node that it reaches. Alternates large and small stars until nothing changes."""
    cur = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if cur.isEmpty():
        return cur.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    mark = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = stage(small.unionByName(own.withColumnRenamed("m", "v")).distinct(), "edges")
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == mark:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        mark = now


def _near(bitmaps: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (pivot, node) that bitmaps don't rule out."""
    x = bitmaps.select("node", "n", F.col("bitmap").alias("b"))
    p = bitmaps.select(F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("bitmap").alias("pb"))
    return pairs.join(x, "node").join(p, "pivot").select("pivot", "node", "pn", "n", "pb", "b").mapInArrow(lean(_near_pairs(percent)), "pivot long, node long")


def _near_in_stars(bitmaps: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Of (pivot, node, comp), the members that may link with a member of another class; each pair of blocks of a star is a unit of work."""
    stars = members.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    m = members.join(stars, "pivot").join(bitmaps.select("node", "n", F.col("bitmap").alias("b")), "node")
    m = m.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = m.select("pivot", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "node", "n", "comp", "b")
    return units.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j").mapInArrow(lean(_near_members(percent)), "pivot long, node long").distinct()


def _met(data: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (pivot, node) with both sets; a set that several tasks made counts once."""
    pivots = data.join(pairs.select("pivot").distinct(), F.col("node") == F.col("pivot"), "left_semi").dropDuplicates(["node"]).select(F.col("node").alias("p"), F.col("data").alias("pivot_data"))
    return data.dropDuplicates(["node"]).join(pairs, "node").join(pivots, F.col("pivot") == F.col("p")).select("pivot", "node", "pivot_data", "data")


def _data(texts: DataFrame, rows: DataFrame, pairs: DataFrame, width: int, shared: frozenset) -> DataFrame:
    """(node, data) of the nodes of pairs, perhaps of some others and of a node more than once: one text of each, told by its hash, becomes a set again."""
    nodes = pairs.select("node").unionByName(pairs.select(F.col("pivot").alias("node"))).distinct()
    one = rows.where("node is not null").groupBy("node").agg(F.min(F.xxhash64("text_key")).alias("text_key"))
    wanted = stage(one.join(nodes, "node", "left_semi").select("text_key"), "texts")
    listed = bloom.build(wanted, wanted.count(), repeated=False)
    data = stage(texts.mapInArrow(lean(_sets(width, listed.test(), shared)), "node long, data binary"), "sets")
    listed.drop()
    return data


def _named_by(first: DataFrame, second: DataFrame) -> DataFrame:
    """Classes first (node, comp), whose names second joins further."""
    over = second.select(F.col("node").alias("comp"), F.col("comp").alias("better"))
    merged = first.join(over, "comp", "left").select("node", F.coalesce("better", "comp").alias("comp"))
    return stage(merged.unionByName(second).groupBy("node").agg(F.min("comp").alias("comp")), "classes")


def text_name(text):
    """128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def classes(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(id, n, node, check, ...) of every row, and (node, comp) of every node in a class of two or more."""
    text_key = F.xxhash64(text_name(F.col(text_col)))
    rows = stage(df.select(F.col(id_col).cast("long"), F.col(text_col), text_name(F.col(text_col))).mapInArrow(lean(_digest(width, percent)), "id long, n long, node long, check long, keys long, text_key binary"), "digests")
    twice_named = rows.where("node is not null").groupBy("node").agg(F.min("check").alias("k0"), F.max("check").alias("k1")).where("k0 <> k1")
    shared_nodes = frozenset(r["node"] for r in twice_named.select("node").collect())  # n * n / 2**65 of n different sets: hardly ever any
    if shared_nodes:
        rows = rows.withColumn("node", F.when(F.col("node").isin(*shared_nodes), F.col("check")).otherwise(F.col("node")))
    spark, texts, told = df.sparkSession, df.select(text_col), df.select(text_col, text_key)
    total = rows.agg(F.sum("keys")).first()[0] or 0
    twice = bloom.build(texts, total, repeated=True, probes=KEY_PROBES, through=_keys(width, percent))
    drop_shuffles(spark)
    keyed = stage(texts.mapInArrow(lean(_keys(width, percent, twice.test(), shared_nodes)), "node long, keys array<long>, n long, bitmap binary"), "keys")
    twice.drop()
    entries = keyed.select("node", F.explode("keys").alias("key"))
    lists = entries.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("most")).where("pivot < most").select("key", "pivot")
    shared = stage(entries.join(lists, "key").select("key", "node", "pivot"), "lists")
    drop_shuffles(spark)
    listed = shared.select("node").distinct()
    bitmaps = stage(keyed.select("node", "n", "bitmap").join(listed, "node", "left_semi").dropDuplicates(["node"]), "bitmaps")
    pairs = shared.where("node <> pivot").groupBy("node").agg(F.min("pivot").alias("pivot"))
    near = stage(_near(bitmaps, pairs, max(1, percent - ALIKE)), "pairs")
    discard(keyed)
    data = _data(told, rows, near, width, shared_nodes)
    related = stage(_met(data, near).mapInArrow(lean(_relate(percent)), RELATIONS), "relations")
    discard(data)
    known = stage(components(related.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))), "classes")
    if not related.where("not linked").isEmpty():
        known = _named_by(known, components(_rest(related, known, percent)))
    # lists that hold more than one class
    classed = stage(shared.join(known, "node", "left").select("key", "pivot", "node", F.coalesce("comp", "node").alias("comp")), "classed")
    discard(shared, related)
    mixed = classed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
    members = classed.join(mixed, "key", "left_semi").select("pivot", "node", "comp").distinct()
    open_pairs = stage(_near_in_stars(bitmaps, members, percent).where("pivot <> node"), "open-pairs")
    discard(classed, bitmaps)
    if open_pairs.isEmpty():
        return rows, known
    data = _data(told, rows, open_pairs, width, shared_nodes)
    related = stage(_met(data, open_pairs).mapInArrow(lean(_relate(percent)), RELATIONS), "relations")
    discard(data)
    linked = related.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    known = _named_by(known, components(_of_classes(linked, known)))
    known = _named_by(known, components(_rest(related, known, percent)))
    discard(related)
    return rows, known


def _of_classes(links_: DataFrame, known: DataFrame) -> DataFrame:
    """Links between nodes as links between their classes."""
    out = links_
    for c in ("a", "b"):
        out = out.join(known.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp")), c, "left").withColumn(c, F.coalesce(f"{c}_comp", c)).drop(f"{c}_comp")
    return out


def _rest(related: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes that further links join, from members of stars whose class isn't their pivot's."""
    by_pivot = first.select(F.col("node").alias("pivot"), F.col("comp").alias("pivot_comp"))
    r = related.join(first, "node", "left").join(by_pivot, "pivot", "left").withColumn("comp", F.coalesce("comp", "node"))
    r = r.withColumn("out", F.col("comp") != F.coalesce("pivot_comp", "pivot")).dropDuplicates(["pivot", "node"])
    r = stage(r.select("pivot", "node", "n_pivot", "n", "lacks", "adds", "comp", "out"), "members")
    weight = F.octet_length("lacks") + F.octet_length("adds")
    blocks = lambda rows, size: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    outside = F.col("out").cast("long")
    stars = r.groupBy("pivot").agg(F.count("*").alias("rows"), F.sum(weight).alias("size"), F.sum(outside).alias("out_rows"), F.sum(outside * weight).alias("out_size"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    stars = stars.where("out_rows > 0 and c0 <> c1").select("pivot", blocks(F.col("rows"), F.col("size")).alias("star_blocks"), blocks(F.col("out_rows"), F.col("out_size")).alias("out_blocks"))
    m = r.join(stars, "pivot")
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cols = ["pivot", "node", "n_pivot", "n", "lacks", "adds", "comp"]
    probes = m.where("out").select(*cols, F.lit(0).alias("role"), own(F.col("out_blocks"), 1).alias("i"), each(F.col("star_blocks")).alias("j"))
    against = m.select(*cols, F.lit(1).alias("role"), each(F.col("out_blocks")).alias("i"), own(F.col("star_blocks"), 2).alias("j"))
    units = probes.unionByName(against).repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    return units.mapInArrow(lean(_match(percent)), "a long, b long")


def named(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows (id, n, node, text_key), and (node, comp, component_id, keep_node): a class's least id, and the node of the row that has it."""
    rows, found = classes(df, text_col, id_col, width, percent)
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    owned = nodes.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rank = F.coalesce("least", F.lit(LAST))
    named_ = owned.groupBy("comp").agg(F.min("least").alias("component_id"), F.min(F.struct(rank.alias("r"), F.col("node").alias("k"))).alias("keep"))
    return rows.select("id", "n", "node", "text_key"), owned.select("node", "comp").join(named_, "comp").select("node", "comp", "component_id", F.col("keep.k").alias("keep_node"))


def decide(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, by_node = named(df, text_col, id_col, width, percent)
    by_node = stage(by_node.select("node", "component_id"), "components")
    full = rows.where("node is not null").join(by_node, "node").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("node is null").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """df with one row of each class, the one with the least id (null last, then by set, then by text); rows with an empty set all stay. Rows are told by id and text, so no set is made again, and rows of which nothing goes don't shuffle."""
    rows, by_node = named(df, text_col, id_col, width, percent)
    keep = by_node.select("node", "keep_node", F.col("component_id").alias("keep_id"))
    told = rows.where("node is not null").groupBy("node", "id", "text_key").agg(F.count("*").alias("times"))
    first = told.groupBy(F.col("node").alias("_node"), F.col("id").alias("_id")).agg(F.min("text_key").alias("_first"))
    told = told.join(first, (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id"))).join(keep, "node")
    stays = (F.col("node") == F.col("keep_node")) & F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("_first"))
    told = stage(told.select("text_key", "id", "times", stays.alias("stays")).where("not stays or times > 1"), "near-decisions")
    goes, again = told.where("not stays"), told.where("stays")
    name, may = free_name(df, "name"), free_name(df, "may")
    id_ = F.col(id_col).cast("long")
    touched = bloom.build(told.select(F.xxhash64("text_key", "id").alias("k")), told.count(), repeated=False)
    marked = df.withColumn(name, text_name(F.col(text_col)))
    marked = marked.withColumn(may, touched.probe(F.xxhash64(F.col(name), id_)))
    straight = marked.where(~F.col(may)).drop(may, name)
    maybe = marked.where(F.col(may)).drop(may)
    same = lambda d, g: d[name].eqNullSafe(g["text_key"]) & d[id_col].cast("long").eqNullSafe(g["id"])
    out = maybe.join(goes, same(maybe, goes), "left_anti")
    if again.isEmpty():
        return straight.unionByName(out.drop(name))
    repeated = out.join(again, same(out, again), "left_semi").dropDuplicates([name, id_col])
    single = out.join(again, same(out, again), "left_anti")
    return straight.unionByName(single.drop(name)).unionByName(repeated.drop(name))
