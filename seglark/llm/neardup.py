"""Near-duplicates by an inverted join over MinHash signature coordinates.

A document is the set of its distinct word shingles.  Documents with equal
sets form a class and only one row per class goes on.  A class is posted under
its signature's (coordinate, value) pairs; two classes collide as often as
their signatures agree, and only pairs that collide ``matches`` times or more
are candidates.  Such pairs share at least one of the ``coordinates - matches
+ 1`` rarest pairs of each, so only that prefix is posted, and values that no
other class has are skipped altogether.

Collisions of a class of a list are counted by merging its posting lists in
that list: the short ones are merged, the ``matches - 1`` longest ones are
skipped and only asked for those classes that the short ones hold.  A spanning
forest of the candidate pairs is kept instead of all of them.

A list of more than ``list_block`` classes is not searched as it is.  All its
classes are compared with one of them, the pivot, and components of all links
of pivots tell which classes are connected already.  Where few classes of the
list are left, only they are compared with all of it, block by block.  Where
many are, each class is posted again under the next pairs of its prefix, in
lists of classes that share both pairs, then three, and so on: a pair that
collides ``matches`` times stays together at every depth, and at depth
``matches`` all classes of a list agree with the pivot.

The forests give groups that no candidate pair leaves; in a group the same
search runs over the full shingle sets with the exact similarity, and its
links give the result.  Groups over a fixed size are cut in blocks, each of
which is searched together with the group's first class; classes that the
first one doesn't link to (few, in groups of near copies) are then compared
with all blocks.

At the default 32 coordinates, 16 matches miss a pair of similarity 0.85 with
probability 6e-7, and 14 matches one of similarity 0.8 with 1e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_batches, tidy
from .common import cut
from .components import SALT, components, with_totals
from .lm import extend

COORDINATES = 32
#: Classes of a posting list that is searched as it is, and classes and characters of a block of a group.
LIST_BLOCK, GROUP_BLOCK, GROUP_CHARS = 1024, 1024, 8_000_000
MAX_WORDS = 300_000
#: Classes in a posting list from which on its count is kept apart.
HOT_LIST = 256


def matches_for(percent: int, coordinates: int = COORDINATES) -> int:
    """The match threshold: agreement on so few coordinates that a true pair misses it at most once in a million."""
    j, miss, p = percent / 100, 0.0, (1 - percent / 100) ** coordinates
    for i in range(coordinates):
        if miss + p > 1.5e-6:
            return max(1, i)
        miss += p
        p *= (coordinates - i) / (i + 1) * j / (1 - j) if j < 1 else 0
    return coordinates


class Shingler:
    """Sets of hashed word shingles; remembers the hashes of words."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """The sorted distinct 64-bit shingle hashes of each text.

        A text with fewer words than ``width`` has its whole word sequence as
        its only shingle; one without words has none.
        """
        words = [t.encode().lower().split() for t in texts]
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        known = self.known
        for w in set().union(*words) - known.keys():
            known[w] = xxhash.xxh3_64_intdigest(w)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        hashed = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
        # keys[i] covers the words i to i + width - 1 of the whole batch; those that reach into the next text are not used
        keys = hashed
        for k in range(1, self.width):
            keys = extend(keys[: len(keys) - 1] if k > 1 else hashed[:-1], hashed[k:]) if len(hashed) > k else keys[:0]
        out, at = [], 0
        for n in sizes.tolist():
            if n >= self.width:
                out.append(np.unique(keys[at : at + n - self.width + 1]))
            elif n:
                whole = hashed[at : at + 1]
                for k in range(1, n):
                    whole = extend(whole, hashed[at + k : at + k + 1])
                out.append(extend(whole, np.array([n], np.uint64)))  # apart from any shingle of full width
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
        return out


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """MinHash signatures of non-empty sets, one row of 32-bit values each."""
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    rng = np.random.default_rng(20240501)
    odd = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64)
    out = np.empty((len(sets), coordinates), np.int32)
    for k in range(coordinates):
        x = (flat ^ flip[k]) * odd[k]
        x ^= x >> np.uint64(29)
        x *= odd[coordinates - 1 - k]
        out[:, k] = (np.minimum.reduceat(x, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def features(docs: DataFrame, width: int, coordinates: int = COORDINATES) -> DataFrame:
    """``doc_id, n_shingles, digest, text_hash, n_chars, sig``; the last four are null for empty sets."""
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"), docs["text"].alias("text"))
    schema = "doc_id long, text_hash long, n_shingles long, digest binary, n_chars long, sig array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for begin, texts in text_batches(batch.column("text")):
                sets = shingler.sets(texts)
                full = [k for k, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                if full:
                    for k, row in zip(full, signatures([sets[k] for k in full], coordinates)):
                        sig[k] = row
                columns = [
                    *(batch.column(c).slice(begin, len(texts)) for c in ("doc_id", "text_hash")),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(t) if len(s) else None for t, s in zip(texts, sets)], pa.int64()),
                    pa.array(sig, pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "digest", "n_chars", "sig"])

    return own.mapInArrow(tidy(run), schema)


def spanning(n: int, agrees: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of n items; ``agrees(i, others)`` tells which of ``others`` link to i."""
    left, out = np.arange(n), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            linked = agrees(i, left)
            found = left[linked]
            left = left[~linked]
            queue.extend(found)
            out.extend((i, j) for j in found)
    return out


def grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys; the rows come sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        new = np.zeros(batch.num_rows, bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        last = int(starts[-1]) if len(starts) else 0
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in key):
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def bounds_of(table: pa.Table, key: list[str]) -> np.ndarray:
    new = np.ones(table.num_rows + 1, bool)
    same = np.ones(max(0, table.num_rows - 1), bool)
    for k in key:
        v = table.column(k).to_numpy()
        same &= v[1:] == v[:-1]
    new[1:-1] = ~same
    return np.flatnonzero(new)


LINKS = "a long, b long"


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(rows, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def with_count(rows: DataFrame, hot: int = HOT_LIST) -> DataFrame:
    """``rows (node, key)`` with ``df``, the number of rows of their key, without those that are alone in theirs.

    Most keys are alone, so their counts are filtered before the join.  Keys of
    more than ``hot`` rows are joined in ``SALT`` parts.
    """
    counts = cut(rows.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"), "dup-counts")
    heavy = cut(counts.filter(F.col("df") > hot).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), "dup-heavy")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int"))
    light = salted.join(heavy.select("key", "salt"), ["key", "salt"], "left_anti").drop("salt").join(counts.filter(F.col("df") <= hot), "key")
    return light.unionByName(salted.join(heavy, ["key", "salt"]).drop("salt"))


class Postings:
    """Posting lists of some signatures: for each coordinate, the rows by value."""

    def __init__(self, sig: np.ndarray, matches: int):
        n, self.coordinates = sig.shape
        self.sig, self.matches = sig, matches
        self.order = np.argsort(sig, axis=0, kind="stable")
        ordered = np.take_along_axis(sig, self.order, 0)
        new = np.ones((n + 1, self.coordinates), bool)
        new[1:-1] = ordered[1:] != ordered[:-1]
        place = np.arange(n + 1)[:, None]
        begin = np.maximum.accumulate(np.where(new, place, 0), 0)[:-1]
        stop = np.minimum.accumulate(np.where(new, place, n)[::-1], 0)[::-1][1:]
        # of each row and coordinate, where the list of its value begins and ends
        self.begin, self.stop = np.empty((n, self.coordinates), np.int64), np.empty((n, self.coordinates), np.int64)
        np.put_along_axis(self.begin, self.order, begin, 0)
        np.put_along_axis(self.stop, self.order, stop, 0)

    def agrees(self, i: int, left: np.ndarray) -> np.ndarray:
        """Which rows of ``left`` collide with row i ``matches`` times or more."""
        by_size = np.argsort(self.stop[i] - self.begin[i], kind="stable")
        short, long = by_size[: self.coordinates - self.matches + 1], by_size[self.coordinates - self.matches + 1 :]
        times = np.bincount(np.concatenate([self.order[self.begin[i, k] : self.stop[i, k], k] for k in short]), minlength=len(self.sig))
        found = left[times[left] > 0]
        total = times[found] + (self.sig[found][:, long] == self.sig[i, long]).sum(1)
        linked = np.zeros(len(self.sig), bool)
        linked[found[total >= self.matches]] = True
        return linked[left]


def search_lists(rows: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """Links that connect, list by list, the pairs of ``rows (list, cell, guest, node, sig)`` that collide ``matches`` times.

    In cells with a guest only the pairs that one belongs to are looked at.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("list", "cell", "guest", "node", "sig").repartition(n, "list", "cell").sortWithinPartitions("list", "cell", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["list", "cell"]):
            sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(table.num_rows, coordinates)
            node, guest = table.column("node").to_numpy(), table.column("guest").to_numpy()
            at = bounds_of(table, ["list", "cell"])
            sizes = np.diff(at)
            two = at[:-1][sizes == 2]
            two = two[(sig[two] == sig[two + 1]).sum(1) >= matches]
            out = list(zip(node[two].tolist(), node[two + 1].tolist()))
            for begin, size in zip(at[:-1][sizes > 2], sizes[sizes > 2]):
                lists, own = Postings(sig[begin : begin + size], matches), guest[begin : begin + size]
                agrees = (lambda i, left, lists=lists, own=own: lists.agrees(i, left) & (own[i] | own[left])) if own.any() else lists.agrees
                out += [(node[begin + i], node[begin + j]) for i, j in spanning(size, agrees)]
            yield _links(out)

    return rows.mapInArrow(tidy(run), LINKS)


def candidate_links(reps: DataFrame, coordinates: int, matches: int, list_block: int = LIST_BLOCK) -> DataFrame:
    """Links of ``reps (node, sig)``, all between classes that agree on ``matches`` coordinates, that connect all such pairs."""
    posted = reps.select("node", F.posexplode("sig").alias("k", "value"))
    posted = posted.select("node", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("value").cast("long") + (1 << 31)).alias("key"))
    # Of a class's pairs, rarest first, those up to place coordinates - matches + 1 are its prefix;
    # pairs that it shares with no class come first of all and are not posted.
    own = F.sort_array(F.collect_list(F.struct("df", "key")))  # at most one per coordinate
    nodes = with_count(posted).groupBy("node").agg(own.alias("own")).filter(F.size("own") >= matches)
    nodes = nodes.select("node", F.transform("own", lambda p: p["key"]).alias("keys"))
    nodes = cut(nodes.join(reps.select("node", "sig"), "node"), "dup-nodes")
    rows = nodes.select("node", F.posexplode(F.slice("keys", 1, F.size("keys") - (matches - 1))).alias("at", "list")).withColumn("label", F.col("node"))
    links = pivoted = None
    for depth in range(1, matches + 1):
        # of each list: its size, and whether it holds classes that aren't connected yet
        rows = cut(with_totals(rows.withColumn("one", F.lit(1)), "list", "node", m=("sum", "one"), low=("min", "label"), high=("max", "label")).filter("low < high").drop("one", "low", "high"), "dup-lists")
        small = rows.filter(F.col("m") <= list_block).select("list", F.lit(0).alias("cell"), F.lit(False).alias("guest"), "node")
        big = rows.filter(F.col("m") > list_block)
        done = big.isEmpty()
        if not done:
            pivoted, direct, rows = refine(big, nodes, pivoted, matches, depth, list_block)
            small = small.unionByName(direct)
        found = search_lists(small.join(nodes.select("node", "sig"), "node"), coordinates, matches)
        links = found if links is None else links.unionByName(found)
        if done:
            break
    return (links if pivoted is None else links.unionByName(pivoted)).distinct()


def refine(big: DataFrame, nodes: DataFrame, pivoted: DataFrame | None, matches: int, depth: int, list_block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of all pivots so far, rows to search as they are, and the lists of the next depth.

    ``label`` is the least class that links of pivots connect a class with:
    classes of one label need no comparison.  Where at most ``list_block``
    classes of a list have another label than the pivot, they are guests in all
    blocks of the list, which makes at most twice as many rows as the list has;
    else the list is refined.
    """
    # lists of one depth that share most of their classes take the same pivot, so that their links to it are the same
    pivots = big.groupBy("list").agg(F.min(F.struct(F.xxhash64(F.lit(depth), "node").alias("hash"), F.col("node").alias("pivot"))).alias("p")).select("list", "p.pivot")
    pivots = pivots.join(nodes.select(F.col("node").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = big.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int"))
    both = salted.join(pivots, ["list", "salt"]).join(nodes, "node")
    same = F.aggregate(F.zip_with("sig", "pivot_sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    both = cut(both.withColumn("linked", same >= matches).drop("sig", "pivot_sig", "salt", "label"), "dup-pivots")
    links = both.filter("linked and node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    pivoted = cut(links if pivoted is None else links.unionByName(pivoted), "dup-pivoted")
    both = both.join(cut(components(pivoted), "dup-labels"), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root", "linked")
    both = with_totals(both.withColumn("own", F.when(F.col("node") == F.col("pivot"), F.col("label"))), "list", "node", main=("max", "own"))
    both = both.withColumn("other", (F.col("label") != F.col("main")).cast("int"))
    both = cut(with_totals(both, "list", "node", others=("sum", "other")).filter("others > 0").drop("own", "main", "pivot"), "dup-open")
    few = both.filter(F.col("others") <= list_block).withColumn("blocks", F.ceil(F.col("m") / list_block).cast("int"))
    few = few.withColumn("home", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("guest", F.col("other") > 0)
    few = few.withColumn("cell", F.explode(F.when(F.col("guest"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("home")))).select("list", "cell", "guest", "node")
    rest = F.slice("keys", F.col("at") + 2, F.greatest(F.size("keys") - F.col("at") - 1 - (matches - depth - 1), F.lit(0)))
    following = both.filter(F.col("others") > list_block).select("node", "label", "list", "at", F.posexplode(rest).alias("more", "key"))
    return pivoted, few, following.select("node", (F.col("at") + 1 + F.col("more")).alias("at"), F.xxhash64("list", "key").alias("list"), "label")


def similarity(sets: list[np.ndarray], percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """For row i and others, which have 100 * intersection >= percent * union: by posting lists of the shingles."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return lambda i, left: np.full(len(left), 100 * both >= percent * (sizes.sum() - both))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(ids, kind="stable")
    holders, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(ids))])
    first = np.cumsum(sizes) - sizes

    def agrees(i: int, left: np.ndarray) -> np.ndarray:
        mine = ids[first[i] : first[i] + sizes[i]]
        counts = starts[mine + 1] - starts[mine]
        upto = np.cumsum(counts)
        where = np.repeat(starts[mine] - upto + counts, counts) + np.arange(upto[-1])
        both = np.bincount(holders[where], minlength=len(sets))[left]
        return 100 * both >= percent * (sizes[i] + sizes[left] - both)

    return agrees


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, coordinates: int = COORDINATES, matches: int | None = None, list_block: int = LIST_BLOCK, group_block: int = GROUP_BLOCK, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text)``.

    Rows are linked where 100 * intersection >= percent * union of their sets
    of distinct ``width``-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z
    lower-cased; fewer words: the whole sequence is one shingle).
    ``component_id`` is the least ``doc_id`` that links reach, ``kept`` whether
    it is the row's own.  Null texts and texts without words have no shingle
    and link with nothing.  Rows that repeat a ``doc_id`` stay with it if they
    are kept; rows with a null ``doc_id`` are kept only where nothing in their
    component has one.  An empty table gives an empty result; other columns
    are not read.
    """
    return _labelled(docs, width, percent, coordinates, matches, list_block, group_block, group_chars).select("doc_id", "n_shingles", "component_id", "kept")


def _labelled(docs: DataFrame, width: int, percent: int, coordinates: int = COORDINATES, matches: int | None = None, list_block: int = LIST_BLOCK, group_block: int = GROUP_BLOCK, group_chars: int = GROUP_CHARS) -> DataFrame:
    """:func:`near_duplicates` with ``text_hash`` and ``component``, which tells components apart that share an identifier."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    matches = matches or matches_for(percent, coordinates)
    table = cut(features(docs, width, coordinates), "dup-features")
    classes = table.filter(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("doc_id").alias("first_id"),
        F.min(F.struct("doc_id", "text_hash", "n_chars")).alias("rep"),
        F.first("sig").alias("sig"),  # equal for equal sets
    )
    reps = cut(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "first_id", "rep", "sig"), "dup-classes")
    groups = components(candidate_links(reps, coordinates, matches, list_block))
    groups = cut(groups, "dup-groups")

    members = groups.join(reps.select("node", "digest", "rep"), "node")
    members = members.withColumn("one", F.lit(1)).withColumn("size", F.col("rep.n_chars"))
    members = with_totals(members, "root", "node", m=("sum", "one"), chars=("sum", "size"))
    blocks = F.greatest(F.ceil(F.col("m") / group_block), F.least(F.col("m"), F.ceil(F.col("chars") / group_chars))).cast("int")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"), docs["text"].alias("text"))
    wanted = members.select("root", "node", "digest", blocks.alias("blocks"), F.col("rep.doc_id").alias("id"), F.col("rep.text_hash").alias("hash"))
    wanted = cut(wanted.withColumn("cell", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "dup-wanted")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def search(own: DataFrame, guests: DataFrame, only_guests: bool) -> DataFrame:
        asked = own.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
        same = texts["doc_id"].eqNullSafe(asked["id"]) & (texts["text_hash"] == asked["hash"])
        return _searched(texts.join(asked, same), width, percent, n, only_guests)

    # in every block of a group: its own classes, and as a guest the group's first class
    found = search(wanted.filter("blocks = 1 or node <> root"), wanted.filter("blocks > 1 and node = root").withColumn("cell", every), False)
    found = cut(found, "dup-first")
    links = found.filter("b is not null")
    # classes that the first one doesn't link to are guests in all other blocks
    left = cut(wanted.join(found.filter("b is null").select(F.col("a").alias("node")), "node", "left_semi"), "dup-left")
    if not left.isEmpty():
        guests = left.withColumn("home", F.col("cell")).withColumn("cell", every).filter("cell <> home").drop("home")
        links = links.unionByName(search(wanted.join(left.select("root").distinct(), "root", "left_semi"), guests, True))
    found = components(links)
    ids = reps.select("node", "digest", "first_id").join(found, "node", "left")
    least = ids.filter("root is not null").groupBy("root").agg(F.min("first_id").alias("least"))
    alone = F.col("root").isNull()
    ids = ids.join(least, "root", "left").select("digest", F.coalesce("root", "node").alias("component"), F.when(alone, F.col("first_id")).otherwise(F.col("least")).alias("label"))
    result = table.select("doc_id", "text_hash", "n_shingles", "digest").join(ids, "digest", "left")
    label = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("label"))
    return result.select("doc_id", "text_hash", "n_shingles", label.alias("component_id"), F.col("doc_id").eqNullSafe(label).alias("kept"), "component")


def _searched(rows: DataFrame, width: int, percent: int, n: int, only_guests: bool) -> DataFrame:
    """Links that connect the similar classes of each cell of ``rows (root, cell, guest, node, digest, text)``.

    With ``only_guests``, pairs of a guest and another class; else all pairs,
    and also, as links to null, the classes that aren't similar to the guest.
    """
    rows = rows.select("root", "cell", "guest", "node", "digest", "text").repartition(n, "root", "cell").sortWithinPartitions("root", "cell", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for table in grouped(batches, ["root", "cell"]):
            at = bounds_of(table, ["root", "cell"])
            out: list[tuple[int, int]] = []
            alone: list[int] = []
            for begin, end in zip(at[:-1].tolist(), at[1:].tolist()):
                part = table.slice(begin, end - begin)
                own = [s for _, texts in text_batches(part.column("text").combine_chunks()) for s in shingler.sets(texts)]
                nodes, digests, guests = (part.column(c).to_pylist() for c in ("node", "digest", "guest"))
                # one text per class, and only where it is the class's own
                seen = {node: (own[k], guests[k]) for k, (node, d) in enumerate(zip(nodes, digests)) if digest(own[k]) == d}
                if len(seen) < 2:
                    continue
                names, sets, guest = list(seen), [x for x, _ in seen.values()], np.array([g for _, g in seen.values()])
                if only_guests and not guest.any():
                    continue
                agrees = similarity(sets, percent)
                if only_guests:
                    out += [(names[i], names[j]) for i, j in spanning(len(names), lambda i, left: agrees(i, left) & (guest[i] | guest[left]))]
                else:
                    out += [(names[i], names[j]) for i, j in spanning(len(names), agrees)]
                    if guest.any():
                        others = np.flatnonzero(~guest)
                        alone += [names[j] for j in others[~agrees(int(guest.argmax()), others)]]
            ends = _links(out)
            yield ends
            if alone:
                yield pa.RecordBatch.from_arrays([pa.array(alone, pa.int64()), pa.nulls(len(alone), pa.int64())], names=["a", "b"])

    return rows.mapInArrow(tidy(run), LINKS)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """All columns of ``docs``, one row of each component: one of those that :func:`near_duplicates` keeps.

    Rows without a shingle stay, all of them.
    """
    found = cut(_labelled(docs, width, percent), "dup-result").filter("kept")
    blank = found.filter("component is null").select("doc_id", "text_hash")
    picked = found.filter("component is not null").groupBy("component").agg(F.min(F.struct("text_hash", "doc_id")).alias("p"), F.count("*").alias("times"))
    repeated = picked.filter("times > 1").limit(1).count() > 0
    ids = picked.select("p.doc_id", "p.text_hash").unionByName(blank).select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    same = docs["doc_id"].cast("long").eqNullSafe(ids["kept_id"]) & (F.xxhash64(docs["text"]) == ids["kept_hash"])
    own = docs.join(ids, same, "left_semi")
    if not repeated:
        return own
    # equal rows of one identifier: one stays, except of those without a shingle
    text = F.coalesce(docs["text"], F.lit(""))
    mark = "_blank" + "_" * max(map(len, docs.columns))  # no column has this name
    key = F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text)).otherwise(F.monotonically_increasing_id())
    return own.withColumn(mark, key).dropDuplicates(["doc_id", mark]).drop(mark)
