"""Exact n-gram Jaccard self join of documents with signature trees.

A document is the set of its distinct word shingles (64-bit hashes). Two documents link when
``100 * |intersection| >= percent * |union|``; linked documents form components. The tree has three kinds of nodes:

1. Size ranges. Linked sets have nearly equal sizes, so the root's children hold ranges of sizes, a factor of
   ``SPREAD`` wide; a set near the border of the next range below also stands in that one.
2. Token regions. Linked sets of one range differ in at most d tokens. The range cuts the token space into d + 1
   + e regions, so linked sets agree on e regions or more altogether. A node of this level holds the sets with the same
   tokens in one region. Regions with fewer than two tokens say little: a set with fewer than e of those is only in
   nodes of its other regions, of which one is always among the e. Nodes with one set hold no pair and are pruned.
3. Below, trees of fixed fan-out, each node with the OR of its children's token bitmaps, their range of sizes and a
   bound on tokens that bits can hide. Two nodes are compared when the maximum overlap that their bitmaps allow reaches
   the overlap that their sizes require; traversal descends both sides, to pairs of sets. Node pairs that already lie in
   one component are pruned too, so mutual copies cost a spanning tree, not all their pairs.

Levels 1 and 2 are shuffle keys. The trees under them hold bitmaps alone; pairs that those can't part join their sets to
families. Each family then meets once with its tokens, in a tree of its own, whose pairs of sets are verified.
Documents with equal sets are one set throughout. A group larger than ``GROUP_ROWS`` is cut into blocks: block 0 against
each block first; what then stands outside of the group's largest component against every block, in as many tasks as
there are pairs of blocks, each of bounded memory. So every linked pair is found, whatever the size of a group.

Keys, nodes and pairs of blocks are worked off in passes, each a part of the hashed keys, so that a shuffle holds a part of
them at a time, and bitmaps and tokens meet their sets within a pass only. Tables go as soon as they have been used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, give_back, materialize, small_side

SPREAD = 1.5
FAN_OUT = 64
#: Tokens below which a region says little.
WEAK = 2
GROUP_ROWS = 8_192
#: A pass shuffles a PASSES-th part of all rows, or so many: of sets in nodes, and of sets with their tokens. Keys are two
#: numbers, of which a pass holds four times PASS_ROWS.
PASSES, PASS_ROWS, TOKEN_ROWS = 4, 500_000, 50_000
#: Bytes of bitmaps that a broadcast may hold.
BROADCAST_BYTES = 8 << 20
BATCH_CHARS = 1_500_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M2
    x = x ^ (x >> np.uint64(27))
    x = x * _M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; words are remembered as long as there are not too many."""

    def __init__(self, words: int, memory: int = 60_000):
        import xxhash

        self.hash, self.words, self.memory, self.known = xxhash.xxh64_intdigest, words, memory, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, dtype=np.uint64)
        known, missing = self.known, None
        try:
            h = [known[w] for w in words]
        except KeyError:
            if len(known) > self.memory:
                known.clear()
            missing = {w for w in words if w not in known}
            known.update((w, self.hash(w)) for w in missing)
            h = [known[w] for w in words]
        w = np.array(h, dtype=np.uint64)
        n = min(self.words, len(w))
        span = len(w) - n + 1
        out = np.full(span, n, dtype=np.uint64)
        for i in range(n):
            out = _mix(out * _M1 + w[i : i + span])
        return np.unique(out)


def size_levels(percent: int, top: int = 1 << 40) -> list[tuple[int, int, int, int]]:
    """(smallest size, largest size, regions, those at least that linked sets agree on) of each range.

    A set that links to another of at least its size differs from it in at most a part (1 - t) / t of its own size, for
    t = percent / 100. Where no difference is possible there are no regions: equal sets are one set already."""
    out, low = [], 1
    while low < top:
        high = max(low, int(low * SPREAD))
        d = high * (100 - percent) // percent
        out.append((low, high, d + 3 + d // 8 if d else 0, 3 + d // 8))
        low = high + 1
    return out


def region_keys(tokens: np.ndarray, level: int, regions: int, agree: int) -> np.ndarray:
    """A key for each region of the token space that says something: of level, region and the tokens in it."""
    at = ((tokens >> np.uint64(32)) * np.uint64(regions)) >> np.uint64(32)
    edges = np.searchsorted(at, np.arange(regions + 1, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(tokens ^ _M1), dtype=np.uint64)])
    own = sums[edges[1:]] - sums[edges[:-1]]
    keys = _mix(own * _M1 + _mix(np.arange(regions, dtype=np.uint64) * _M3 + np.uint64(level + 1))).view(np.int64)
    strong = np.diff(edges) >= WEAK
    return keys if regions - np.count_nonzero(strong) >= agree else keys[strong]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int(np.count_nonzero(large[at] == small)) if len(large) else 0
    return 100 * common >= percent * (both - common)


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    marks = np.zeros(bits, dtype=np.uint8)
    marks[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").view(np.uint64)


def bits_for(size: int) -> int:
    """Bits of the bitmap of a set: twice its size or more, a power of two."""
    return 1 << min(15, max(6, int(2 * size - 1).bit_length()))


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of one length, the least of theirs: halves of a bitmap ORed are the bitmap of half the length."""
    least = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, least), axis=0) if len(m) > least else m for m in maps])


class SignatureTree:
    """Nodes level by level, leaves first; nodes[level] has bits (OR), low, high, hidden for each node."""

    def __init__(self, leaf: np.ndarray, size: np.ndarray):
        self.nodes = [(leaf, size, size, size - np.bitwise_count(leaf).sum(axis=1, dtype=np.int64))]
        while len(self.nodes[-1][0]) > 1:
            bits, low, high, hidden = self.nodes[-1]
            at = np.arange(0, len(bits), FAN_OUT)
            self.nodes.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at)))

    def may_link(self, level: int, mine: np.ndarray, theirs: np.ndarray, percent: int) -> np.ndarray:
        """Matrix of the node pairs whose maximum overlap reaches what their sizes require."""
        bits, low, high, hidden = self.nodes[level]
        common = np.bitwise_count(bits[mine][:, None, :] & bits[theirs][None, :, :]).sum(axis=2, dtype=np.int64)
        most = np.minimum(common + np.minimum.outer(hidden[mine], hidden[theirs]), np.minimum.outer(high[mine], high[theirs]))
        return (100 + percent) * most >= percent * np.add.outer(low[mine], low[theirs])


def tree_components(sizes: np.ndarray, maps: list[np.ndarray], percent: int, known: list[int], sets: list[np.ndarray] | None) -> list[int]:
    """For each set the smallest index in its component. known: components already found, by an index in each. Without
    sets (tokens), pairs that the bitmaps can't part are joined."""
    if len(sizes) < 2:
        return list(range(len(sizes)))
    leaf = folded(maps)
    order = np.lexsort((leaf[:, 0], sizes))
    tree = SignatureTree(leaf[order], sizes[order])
    # Labels of components, in the tree's order.
    label = np.array(known)[order]

    def members(level: int, i: int) -> slice:
        return slice(i * FAN_OUT**level, (i + 1) * FAN_OUT**level)

    def visit(level: int, i: int, j: int) -> None:
        """Node i against node j of the same level, i <= j."""
        a, b = label[members(level, i)], label[members(level, j)]
        if (a == a[0]).all() and (b == a[0]).all():
            return
        below = len(tree.nodes[level - 1][0])
        mine, theirs = (np.arange(x * FAN_OUT, min(below, (x + 1) * FAN_OUT)) for x in (i, j))
        may = tree.may_link(level - 1, mine, theirs, percent)
        if i == j:
            may = np.triu(may, 1 if level == 1 else 0)
        if level > 1:
            for x, y in np.argwhere(may):
                visit(level - 1, int(mine[x]), int(theirs[y]))
            return
        apart = may & np.not_equal.outer(label[mine], label[theirs])
        while apart.any():
            x, y = divmod(int(apart.argmax()), len(theirs))
            u, v = mine[x], theirs[y]
            if sets is None or linked(sets[order[u]], sets[order[v]], percent):
                one, other = sorted((label[u], label[v]))
                label[label == other] = one
                apart &= np.not_equal.outer(label[mine], label[theirs])
            apart[x, y] = False

    visit(len(tree.nodes) - 1, 0, 0)
    first: dict[int, int] = {}
    of = np.empty(len(sizes), dtype=np.int64)
    of[order] = label
    return [first.setdefault(int(c), i) for i, c in enumerate(of)]


def shingle_sets(docs: DataFrame, key: str, text: str, words: int, levels: list[tuple[int, int, int, int]] | None, percent: int, keep: list[str]) -> DataFrame:
    """id, n (set size), h (hash of the set), bits (bitmap), keys: its region keys if levels are given, else its tokens.

    A set that a task meets again has no keys the second time."""
    carry = [F.col(c) for c in keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        uppers = np.array([x[1] for x in levels]) if levels else None
        met: set[int] = set()
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                sets, chars, at = [], 0, start
                while at < batch.num_rows and chars < BATCH_CHARS:
                    t = batch["t"][at].as_py()
                    chars += len(t or "")
                    sets.append(shingler(t))
                    at += 1
                hashes = [int(np.sum(_mix(s + _M1), dtype=np.uint64).view(np.int64)) for s in sets]
                out = {"n": pa.array([len(s) for s in sets], pa.int64()), "h": pa.array(hashes, pa.int64()), "bits": pa.array([bitmap(s, bits_for(len(s))).tobytes() for s in sets], pa.binary())}
                if levels:
                    held = []
                    for s, h in zip(sets, hashes, strict=True):
                        own = []
                        n = len(s)
                        if n and h not in met:
                            if len(met) > 100_000:
                                met.clear()
                            met.add(h)
                            level = int(np.searchsorted(uppers, n))
                            # In its own range and, if it may link to sets of the one below, in that.
                            for x in (level, level - 1):
                                if x >= 0 and levels[x][2] and (x == level or 100 * levels[x][1] >= percent * n):
                                    own.append(region_keys(s, x, *levels[x][2:]))
                        held.append(np.concatenate(own) if own else np.empty(0, dtype=np.int64))
                else:
                    held = [s.view(np.int64) for s in sets]
                ends = np.cumsum([0] + [len(x) for x in held]).astype(np.int32)
                out["keys"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held) if held else np.empty(0, dtype=np.int64)))
                yield pa.RecordBatch.from_pydict({c: batch[c].slice(start, at - start) for c in ["id", *keep]} | out)
                start = at
        del shingler, met
        give_back()

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(key).alias("id"), F.col(text).alias("t"), *carry).mapInArrow(work, f"id {docs.schema[key].dataType.simpleString()}" + (f", {kinds}" if kinds else "") + ", n long, h long, bits binary, keys array<long>")


def _labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in pairs (a, b), sorted, and for each the place of the smallest one that pairs connect it with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            return nodes, label
        label = new


def min_labels(pairs: DataFrame, name: str, made: Scratch, sized: bool = False) -> DataFrame:
    """Connected components of pairs (a, b): (node, label), the smallest node of each component; if sized also rows, the
    number of its nodes.

    Up to BROADCAST_ROWS pairs are labelled by one task, without a shuffle. Of more, hubs (b) and nodes pass their smallest
    label to each other; labels then jump to the label of their label. Rounds go on until nothing changes. Nothing leaves
    the executors but a count.
    """
    if pairs.count() <= BROADCAST_ROWS:

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [(x["a"].to_numpy(np.int64), x["b"].to_numpy(np.int64)) for x in batches]
            nodes, label = _labels(*(np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*held, strict=True) if held else ((), ()))))
            yield pd.DataFrame({"node": nodes, "label": nodes[label], "rows": np.bincount(label, minlength=len(nodes))[label]})
            del held, nodes, label
            give_back()

        found = made(pairs.select("a", "b").coalesce(1).mapInPandas(work, "node long, label long, rows long"), f"{name}-labels")
        return found if sized else found.drop("rows")
    edges = made(pairs.select(F.col("a").alias("node"), F.col("b").alias("hub")).union(pairs.select("b", "b")).distinct(), f"{name}-edges")
    labels = made(edges.groupBy("node").agg(F.min("node").alias("label")), f"{name}-labels")
    while True:
        hub = edges.join(labels, "node").groupBy("hub").agg(F.min("label").alias("least"))
        heard = edges.join(hub, "hub").groupBy("node").agg(F.min("least").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("label").alias("further"))
        new = made(labels.join(heard, "node").join(jump, "least", "left").select("node", "label", F.least("label", "least", "further").alias("new")), f"{name}-labels")
        changed = new.where("new < label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.join(labels.groupBy("label").agg(F.count("*").alias("rows")), "label") if sized else labels


def _tree_links(rows: DataFrame, percent: int, by: list[str]) -> DataFrame:
    """(a, b): for each set a of a group (rows: by, h, c, n, bits, and keys, its tokens, where pairs are to be verified) a
    set b that the group's signature tree connects it with. One group is in memory at a time, a bounded number of
    rows."""
    verify = "keys" in rows.columns
    cols = [*by, "h", "c", "n", "bits", *["keys"] * verify]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now, found = [], None, []

        def done() -> None:
            if len(held) > 1:
                first: dict[int, int] = {}
                known = [first.setdefault(x[1], i) for i, x in enumerate(held)]
                sets = [np.asarray(x[4], dtype=np.int64).view(np.uint64) for x in held] if verify else None
                at = tree_components(np.array([x[2] for x in held]), [np.frombuffer(x[3], dtype=np.uint64) for x in held], percent, known, sets)
                found.extend((x[0], held[i][0]) for x, i in zip(held, at, strict=True) if x[0] != held[i][0])

        for batch in batches:
            for row in zip(*(batch[x] for x in cols), strict=True):
                group = row[: len(by)]
                if now is not None and group != now:
                    done()
                    held = []
                now = group
                if not held or held[-1][0] != row[len(by)]:
                    held.append(row[len(by) :])
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
            found = []
        done()
        yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
        held, found = [], []
        give_back()

    return rows.repartition(*by).sortWithinPartitions(*by, "h").select(*cols).mapInPandas(work, "a long, b long")


def _part(by: list[str], p: int, passes: int) -> Column:
    return F.pmod(F.xxhash64(*by, F.lit(11)), F.lit(passes)) == p


def _tree_passes(part: Callable[[Column], DataFrame], percent: int, by: list[str], rows: int, most: int, made: Scratch, name: str, once: bool = False) -> DataFrame:
    """_tree_links of so many rows, about most of them at a time. part gives the rows, with all that trees need, of which
    the columns by meet a condition. once: no set is in two groups, so no link comes twice."""
    passes = max(1, -(-rows // most))
    found = (_tree_links(part(_part(by, p, passes)), percent, by) for p in range(passes))
    return reduce(DataFrame.unionByName, [made(x if once else x.distinct(), name) for x in found])


def _group_links(groups: DataFrame, load: DataFrame, percent: int, made: Scratch, name: str) -> DataFrame:
    """Links of groups (label, h) by what load (h, n, bits) holds of their sets."""
    sizes = groups.groupBy("label").agg(F.count("*").alias("rows"))
    total, largest = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    most, small, found = max(PASS_ROWS, -(-total // PASSES)), groups, []
    if largest > GROUP_ROWS:
        large = made(sizes.where(F.col("rows") > GROUP_ROWS), f"{name}-large")
        found = [_large_links(groups.join(small_side(large), "label"), load, percent, most, made)]
        small = groups.join(small_side(large), "label", "left_anti")
    small = small.withColumn("c", F.col("h"))
    sets, held = load.agg(F.count("*"), F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()
    load = small_side(load, sets) if held <= BROADCAST_BYTES else load
    return reduce(DataFrame.unionByName, found, _tree_passes(lambda x: small.where(x).join(load, "h"), percent, ["label"], total, most, made, name))


def jaccard_components(docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach from a document, itself included.

    Words are what ASCII white space leaves, ASCII letters in lower case. A text of fewer words than a shingle has is
    one shingle. Null, empty and blank texts have no shingles and no links, and are their own component. Rows of equal
    text share a component, repeated rows stay. A null key counts as the smallest: its component_id is null, as is
    that of documents linked with it. Other columns of docs are not looked at.
    """
    made = Scratch()
    out = materialize(_linked_rows(docs, text, key, words, percent, [], made), "linked-sets")
    made.clear()
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("component_id"))


def _linked_rows(docs: DataFrame, text: str, key: str, words: int, percent: int, carry: list[str], made: Scratch) -> DataFrame:
    """id, the columns carry, n (set size) and least of each row: the smallest (has, id, carry) of its component, null for
    rows without shingles. With the key, carry tells apart texts under one key. It reads tables of made."""
    early = Scratch()
    shingled = early(shingle_sets(docs, key, text, words, size_levels(percent), percent, carry), "shingle-sets")
    n_keys = shingled.agg(F.sum(F.size("keys"))).first()[0] or 0
    passes = min(PASSES, 1 + n_keys // (4 * PASS_ROWS))

    def keyed(p: int) -> DataFrame:
        return shingled.where("n > 0").select("h", F.explode("keys").alias("key")).where(_part(["key"], p, passes))

    # Nodes of level 2 that hold two sets or more, as fingerprints of what they hold; of those that hold the same, one.
    mark = F.xxhash64("h")

    def one_of_alike(nodes: DataFrame) -> DataFrame:
        return nodes.groupBy("lo", "hi", "xor", "sum").agg(F.min("key").alias("key"))

    def nodes_of(p: int) -> DataFrame:
        nodes = keyed(p).groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.bit_xor(mark).alias("xor"), F.sum(mark.bitwiseAND(0xFFFFFFFF)).alias("sum")).where("lo <> hi")
        return early(one_of_alike(nodes), "tree-nodes") if passes > 1 else nodes

    nodes = early(one_of_alike(reduce(DataFrame.unionByName, map(nodes_of, range(passes)))).select("key"), "tree-nodes")
    n_nodes = nodes.count()

    def edges_of(p: int) -> DataFrame:
        mine = nodes.where(_part(["key"], p, passes))
        return made(keyed(p).join(small_side(mine, n_nodes // passes), "key", "left_semi").distinct().select(F.col("h").alias("node"), F.col("key").alias("hub")), "node-edges")

    edges = reduce(DataFrame.unionByName, map(edges_of, range(passes)))
    members = shingled.groupBy("h").agg(F.min("n").alias("n"), F.min("bits").alias("bits"))
    in_nodes = edges.select(F.col("node").alias("h"))
    in_nodes = F.broadcast(in_nodes) if edges.count() <= BROADCAST_ROWS else in_nodes.distinct()
    members = made(members.join(in_nodes, "h", "left_semi"), "node-sets")
    sets = made(shingled.select("id", *carry, "n", "h"), "set-rows")
    early.clear()

    # One row for each distinct set.
    own = F.struct(F.col("id").isNotNull().alias("has"), F.col("id"), *carry)
    classes = sets.where("n > 0").groupBy("h", "n").agg(F.min(own).alias("first"), F.count("*").alias("copies"))
    near = _group_links(edges.select(F.col("hub").alias("label"), F.col("node").alias("h")), members, percent, made, "near-sets")
    families = min_labels(near, "family", made, sized=True)

    # The tokens of the sets in families, one document for each set.
    lone = classes.select(F.col("h").alias("node"), "first", "n").join(small_side(families), "node")
    lone = made(lone.select("node", "label", "rows", F.col("first.id").alias("id"), *[F.col(f"first.{c}").alias(f"of_{c}") for c in carry], F.col("n").alias("size")), "family-members")
    n_members, largest = lone.agg(F.count("*"), F.coalesce(F.max("rows"), F.lit(0))).first()
    texts = docs.select(F.col(key).alias("__k"), F.col(text).alias("t"), *carry)
    same = texts["__k"].eqNullSafe(lone["id"])
    for c in carry:
        same = same & texts[c].eqNullSafe(lone[f"of_{c}"])
    passes = 1 if n_members <= BROADCAST_ROWS else PASSES

    def picked_of(p: int) -> DataFrame:
        mine = small_side(lone.where(_part(["id"], p, passes)), n_members // passes)
        return made(texts.where(_part(["__k"], p, passes)).join(mine, same).select("t", "node", "label", "rows"), "family-texts")

    picked = reduce(DataFrame.unionByName, map(picked_of, range(passes)))

    def tokens(which: Column) -> DataFrame:
        found = shingle_sets(picked.where(which), "node", "t", words, None, percent, ["label", "rows"]).where("id = h")
        return found.select("label", "rows", "h", F.col("h").alias("c"), "n", "bits", "keys")

    most, small = max(TOKEN_ROWS, -(-n_members // PASSES)), F.col("rows") <= GROUP_ROWS
    links = _tree_passes(lambda x: tokens(x & small), percent, ["label"], n_members, most, made, "set-links", once=True)
    if largest > GROUP_ROWS:
        load = made(tokens(~small).select("h", "n", "bits", "keys").dropDuplicates(["h"]), "family-tokens")
        links = links.unionByName(_large_links(lone.where(~small).select("label", "rows", F.col("node").alias("h")), load, percent, most, made))
    joined = min_labels(links, "component", made).withColumnRenamed("node", "h")
    n_joined = joined.count()
    joined = small_side(joined, n_joined)

    least = classes.join(joined, "h").groupBy("label").agg(F.min("first").alias("least"))
    # Rows of sets that have neither links nor copies are their own component.
    shared = classes.join(joined, "h", "left").where("label is not null or copies > 1").join(small_side(least, n_joined), "label", "left")
    shared = made(shared.select("h", "n", F.coalesce("least", "first").alias("least")), "shared-sets")
    return sets.join(small_side(shared), ["h", "n"], "left").select("id", *carry, "n", F.when(F.col("n") > 0, F.coalesce("least", own)).alias("least"))


def _large_links(large: DataFrame, load: DataFrame, percent: int, most: int, made: Scratch) -> DataFrame:
    """Links of groups (label, rows, h) of more than GROUP_ROWS sets, in blocks of half as many, by what load holds of the
    sets; about most rows of pairs of blocks at a time."""
    half = GROUP_ROWS // 2
    parts = F.ceil(F.col("rows") / half).cast("int")
    dealt = large.withColumn("c", F.col("h")).withColumn("part", F.pmod(F.xxhash64("h", F.lit(7)), parts).cast("int"))
    star = dealt.withColumn("pair", F.when(F.col("part") == 0, F.sequence(F.lit(1), parts - 1)).otherwise(F.array("part"))).select("label", "h", "c", F.explode("pair").alias("pair"))
    first = _tree_passes(lambda x: star.where(x).join(load, "h"), percent, ["label", "pair"], star.count(), most, made, "large-links")
    found = min_labels(first, "large", made)
    known = dealt.drop("c").join(found.select(F.col("node").alias("h"), F.col("label").alias("c")), "h", "left").withColumn("c", F.coalesce("c", "h"))
    sizes = known.groupBy("label", "c").agg(F.count("*").alias("m"))
    main = sizes.groupBy("label").agg(F.max(F.struct("m", F.negative("c").alias("c"))).alias("x")).select("label", F.negative(F.col("x.c")).alias("main"))
    known = made(known.join(main, "label").withColumn("rest", F.col("c") != F.col("main")), "large-known")
    rest = known.where("rest").groupBy("label").agg(F.count("*").alias("left_over"))
    known = known.join(rest, "label")
    blocks = F.ceil(F.col("left_over") / half).cast("int")
    mine = known.where("rest").withColumn("x", F.pmod(F.xxhash64("h", F.lit(8)), blocks).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), parts - 1)))
    theirs = known.withColumn("y", F.col("part")).withColumn("x", F.explode(F.sequence(F.lit(0), blocks - 1)))
    grid = mine.select("label", "x", "y", "c", "h").union(theirs.select("label", "x", "y", "c", "h"))
    return first.unionByName(_tree_passes(lambda x: grid.where(x).join(load, "h"), percent, ["label", "x", "y"], grid.count(), most, made, "large-rest"))


def keep_one(docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of documents that link, directly or over others: that of the smallest key (null counts
    as the smallest), of different texts under that key the one of the smallest hash, of rows that share both the one
    whose columns have the smallest hash. Rows without shingles all stay."""
    mark = F.xxhash64(text)
    made = Scratch()
    found = _linked_rows(docs.withColumn("__th", mark), text, key, words, percent, ["__th"], made).where("n > 0")
    found = materialize(found.select(F.col("id").alias("__id"), "__th", F.col("id").eqNullSafe(F.col("least.id")) & (F.col("__th") == F.col("least.__th"))).toDF("__id", "__th", "stays"), "linked-rows")
    made.clear()
    gone = materialize(found.where("not stays").select("__id", "__th").distinct(), "near-copies")
    again = materialize(found.where("stays").groupBy("__id", "__th").count().where("count > 1").select("__id", "__th"), "repeated-rows")

    def side(rows: DataFrame, marks: DataFrame, how: str) -> DataFrame:
        return rows.join(small_side(marks), rows[key].eqNullSafe(marks["__id"]) & (mark == marks["__th"]), how)

    kept = side(docs, gone, "left_anti")
    if again.isEmpty():
        return kept
    one = side(docs, again, "left_semi").groupBy(key, mark.alias("__th")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row"))
    return side(kept, again, "left_anti").unionByName(one.select("__row.*"))
