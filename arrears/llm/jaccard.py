"""N-gram Jaccard self-join on prefix trees.

Texts become sets of hashed n-word shingles. The join runs in four steps:

1. **Sets** (`_sketch`). One pass gives each text its set size, a 64-bit
   fingerprint (`cid`) of the whole set, and the set's lowest hashes. Equal sets are
   one class from here on.
2. **Candidates.** Two sets that link share at least ``k`` of their
   ``size - need + k`` lowest hashes (prefix principle; ``need`` is the least
   overlap a link leaves room for, ``k`` about a twentieth of the size). Classes
   with too few hashes that another class has go. Whole sets of the rest are
   cut into parts by ranges of hashes, more parts than two linked sets have
   hashes that differ, so some parts must be equal; an equal part is several
   hashes that agree and none beside them, which common phrases alone seldom
   give. The prefix principle is used again on the parts' fingerprints: only
   the rarest of them count, as many as must hold a common one. Classes with a
   common one are chained into coarse groups. No pairs are made: every
   fingerprint ties its classes to the least of them.
3. **Prefix trees** (`trie_links`). Whole sets of the surviving classes are
   dealt to blocks of bounded size inside their group, by set size. In a
   block the sets, ordered by block-wide frequency, are stored in a trie of
   merged runs; they walk it many at once, adding the overlap of shared runs for
   all sets below, leaving subtrees whose remaining length or set sizes cannot
   reach the threshold, and subtrees that already are their own component.
   Groups of several blocks go on with neighbouring blocks, then with what is
   still apart from the group's largest component against every block.
4. **Components** of the links found, joined back to all rows.

The result is exact up to collisions of 64-bit hashes. Where only components
are asked (``jaccard_components``, ``one_per_group``), links between classes
that are connected already are not looked for: they change no component.
``jaccard_join`` and ``jaccard_pairs`` find every link (`trie_pairs`): a block
with itself, and with every other block of its group that has compatible sizes.
A row's number of links counts rows: its class's other rows and those of every
class linked with its own. It is added up in the tasks, so that only the pairs'
own function writes pairs; copies are one class in both.

Defined results: a text without words (or null) has an empty set, size 0, and
is linked with nothing; with fewer words than a shingle the whole sequence is
the one shingle; equal sets link; repeated rows are rows of one class; a
component is named by its least id (null ids only: null).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.llm.components import components
from arrears.llm.store import Scratch, free_name
from arrears.llm.text import SPACED, buffers, mix, shingle_sets, slices, words

SLACK = 20               # one extra common prefix hash is asked for per so many shingles
SPARE = 6                # one more part, and one more that must agree, for so many hashes that may differ
WALK_CELLS = 8_000_000   # ranks x sets that walk a trie at once: 24 MB
BLOCK_TOKENS = 2_000_000  # shingles of one block: 16 MB, and what one trie holds

SKETCH = "doc_id bigint, key bigint, n bigint, cid bigint, pre array<bigint>"
SETS = "cid bigint, n bigint, tokens binary, own array<bigint>, own_least bigint, below array<bigint>, below_least bigint"


def need(n: int, num: int, den: int) -> int:
    """Least overlap of a set of size n with any set it links to."""
    return -(-num * n // den)


def _class_of(s: np.ndarray) -> int:
    head = np.array([len(s)], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(head + mix(s).sum(dtype=np.uint64)).view(np.int64)[0])


def _sketch(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(*words(*buffers(part.column("text")), SPACED), k)
                low = [s[:len(s) - need(len(s), num, den) + 1 + len(s) // SLACK] for s in sets]
                ends = np.cumsum([0] + [len(x) for x in low])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(low).view(np.int64)))],
                    names=["doc_id", "key", "n", "cid", "pre"])
    return run


def _ranges(most: int, num: int, den: int) -> list[int]:
    """First sizes of size ranges, up to one beyond ``most``: a set links with
    none that is more than one range larger."""
    first = [1, 2]
    while first[-1] <= most:
        first.append(max(first[-1] + 1, (first[-1] - 1) * den // num + 1))
    return first


def _parts(s: np.ndarray, low: int, high: int, num: int, den: int) -> tuple[np.ndarray, int]:
    """Fingerprints of the parts of a set, and how many of them it has in common
    with any set it links to, if the smaller one's size is in low..high - 1.
    Linked sets differ in ``far`` hashes at most, so in no more parts; parts
    are ranges of hashes, the same for all sets under the same low and high."""
    far = (high - 1) * (den - num) // num
    count = far + 1 + far // SPARE
    step = (1 << 64) // count + 1
    edges = np.searchsorted(s, np.array([i * step for i in range(1, count)], dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s), dtype=np.uint64)])
    ends = np.concatenate([[0], edges, [len(s)]])
    place = mix(np.arange(count, dtype=np.uint64) + np.uint64(low << 32))
    return mix(sums[ends[1:]] - sums[ends[:-1]] + place), count - far


def _whole_sets(k: int, num: int, den: int):
    """Whole sets with the fingerprints of their parts: under their own size
    range, where they meet sets of this range and of the next, and under the
    one below, where they meet smaller sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [s for s in shingle_sets(*words(*buffers(part.column("text")), SPACED), k) if len(s)]
                first = _ranges(max(map(len, sets), default=1), num, den)
                at = [bisect.bisect_right(first, len(s)) - 1 for s in sets]
                own = [_parts(s, first[i], first[i + 1], num, den) for s, i in zip(sets, at)]
                below = [_parts(s, first[i - 1], first[i], num, den) if i else (np.zeros(0, np.uint64), 1) for s, i in zip(sets, at)]
                columns = [pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                           pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())]
                for marks in (own, below):
                    columns += [pa.array([x.view(np.int64) for x, _ in marks], pa.list_(pa.int64())), pa.array([y for _, y in marks], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["cid", "n", "tokens", "own", "own_least", "below", "below_least"])
    return run


class _Node:
    __slots__ = ("run", "last", "kids", "own", "lo", "hi", "below", "least", "most", "same")


class _Forest:
    def __init__(self, labels):
        self.parent = list(range(len(labels)))
        first: dict = {}
        for i, x in enumerate(labels):
            if x is not None:
                self.join(first.setdefault(x, i), i)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a: int, b: int) -> None:
        self.parent[self.find(b)] = self.find(a)


def _ranked(sets: list[np.ndarray], sizes: list[int], num: int, den: int) -> list[np.ndarray | None]:
    """Each set as sorted ranks of the hashes that at least two sets have,
    commonest first; None for a set that can link with none of the others: it
    has too few hashes that any set still in question has."""
    flat = np.concatenate(sets)
    values, where = np.unique(flat, return_inverse=True)
    where = where.astype(np.int32)
    del flat
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), lengths)
    least = np.array([need(n, num, den) for n in sizes])
    alive = np.ones(len(sets), dtype=bool)
    while True:
        count = np.bincount(where[alive[owner]], minlength=len(values))
        have = np.bincount(owner, weights=(count > 1)[where], minlength=len(sets))
        now = alive & (have >= least)
        if now.sum() == alive.sum():
            break
        alive = now
    order = np.lexsort((values, -count))
    rank = np.empty(len(values), dtype=np.int32)
    rank[order] = np.arange(len(values))
    kept = int((count > 1).sum())
    ranks, ends, out = rank[where], np.cumsum(lengths), []
    for hi, n, ok in zip(ends.tolist(), lengths.tolist(), alive.tolist()):
        r = np.sort(ranks[hi - n:hi]) if ok else None
        out.append(r[:np.searchsorted(r, kept)] if ok else None)
    return out


def _build(seqs: list[np.ndarray], sizes: list[int]) -> _Node:
    """A trie of merged runs over sequences in lexicographic order."""
    root = None
    todo = [(0, len(seqs), 0, None)]
    while todo:
        lo, hi, depth, parent = todo.pop()
        a, b = seqs[lo], seqs[hi - 1]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:m] != b[depth:m])
        end = depth + int(differ[0]) if len(differ) else m
        node = _Node()
        node.run, node.lo, node.hi, node.kids, node.same = a[depth:end], lo, hi, [], False
        node.last = int(a[end - 1]) if end else -1
        node.below = max(len(s) for s in seqs[lo:hi]) - end
        node.least, node.most = min(sizes[lo:hi]), max(sizes[lo:hi])
        i = lo
        while i < hi and len(seqs[i]) == end:
            i += 1
        node.own = range(lo, i)
        while i < hi:
            x = seqs[i][end]
            j, top = i, hi
            while j < top:                        # last sequence that goes on with x
                mid = (j + top) // 2
                if seqs[mid][end] <= x:
                    j = mid + 1
                else:
                    top = mid
            todo.append((i, j, end, node))
            i = j
        if parent is None:
            root = node
        else:
            parent.kids.append(node)
    return root


class _Walk:
    """Some sets on their way through a trie together. ``cum[r]`` says how many
    hashes of rank below r each of them has, ``has[r]`` whether it has rank r."""

    def __init__(self, seqs: list[np.ndarray], sizes: list[int], width: int, num: int, den: int):
        self.lens = np.array([len(x) for x in seqs])
        self.size = np.array(sizes)
        self.small, self.large = -(-num * self.size // den), den * self.size // num
        self.has = np.zeros((width, len(seqs)), dtype=np.uint8)
        self.has[np.concatenate(seqs), np.repeat(np.arange(len(seqs)), self.lens)] = 1
        self.cum = np.zeros((width + 1, len(seqs)), dtype=np.uint16 if self.lens.max() < 1 << 16 else np.int32)
        np.cumsum(self.has, axis=0, dtype=self.cum.dtype, out=self.cum[1:])

    def overlap(self, run: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many hashes of a node's run each of the rows has."""
        if not len(run):
            return np.zeros(len(rows), dtype=np.int64)
        if run[-1] - run[0] == len(run) - 1:                    # neighbouring ranks
            return self.cum[run[-1] + 1, rows].astype(np.int64) - self.cum[run[0], rows]
        few = 4 * len(rows) < self.has.shape[1]
        found = (self.has[run[:, None], rows] if few else self.has[run]).sum(axis=0, dtype=np.int64)
        return found if few else found[rows]


def _walks(ranks: list, sizes: list[int], num: int, den: int, sides: list | None, same=None, settle=None) -> Iterator[tuple[int, list[int]]]:
    """(i, others) for sets in ranks that link under Jaccard >= num/den; many
    sets walk the trie at once, each pair is met once. With ``sides`` (0 or 1
    for each set) the sets of side 1 walk a trie of those of side 0. ``same`` takes a node and the walkers and says which need
    not go on, ``settle`` a node whose subtree is done."""
    order = sorted((i for i in range(len(ranks)) if ranks[i] is not None), key=lambda i: ranks[i].astype(">u4").tobytes())
    stored = order if sides is None else [i for i in order if sides[i] == 0]
    walkers = order if sides is None else [i for i in order if sides[i] == 1]
    if not stored or not walkers:
        return
    size = [sizes[i] for i in stored]
    root = _build([ranks[i] for i in stored], size)
    width = max(int(ranks[i][-1]) for i in order) + 1
    step = max(1, WALK_CELLS // width)
    place = {x: p for p, x in enumerate(stored)}
    for lo in range(0, len(walkers), step):
        me = np.array(walkers[lo:lo + step])
        upto = lo + len(me) if sides is None else len(stored)    # a pair is met by its later set
        w = _Walk([ranks[i] for i in me.tolist()], [sizes[i] for i in me.tolist()], width, num, den)
        at = np.array([place.get(i, len(stored)) for i in me.tolist()])
        todo = [(root, np.arange(len(me)), np.zeros(len(me), dtype=np.int64), False)]
        while todo:
            node, rows, overlap, done = todo.pop()
            if done:
                settle(node, stored)
                continue
            if node.lo >= upto:
                continue
            go = (w.small[rows] <= node.most) & (w.large[rows] >= node.least)
            if same is not None and node.same:
                go &= ~same(stored[node.lo], me[rows])
            rows, overlap = rows[go], overlap[go]
            if not len(rows):
                continue
            overlap = overlap + w.overlap(node.run, rows)
            rest = np.minimum(node.below, w.lens[rows] - w.cum[node.last + 1, rows])
            go = (overlap + rest) * (num + den) >= num * (w.size[rows] + np.maximum(node.least, w.small[rows]))
            rows, overlap = rows[go], overlap[go]
            if not len(rows):
                continue
            for i in node.own:
                met = rows[(at[rows] > i if sides is None else True) & (w.small[rows] <= size[i]) & (size[i] <= w.large[rows])
                           & (overlap * (num + den) >= num * (w.size[rows] + size[i]))]
                if len(met):
                    yield stored[i], me[met].tolist()
            if settle is not None and not node.same:
                todo.append((node, rows, overlap, True))
            todo += [(k, rows, overlap, False) for k in node.kids]


def trie_links(sizes: list[int], sets: list[np.ndarray], num: int, den: int, labels: list | None = None, sides: list | None = None) -> list[tuple[int, int]]:
    """Links, each to the first set of its component, that join the sets into
    their components under Jaccard >= num/den. Sets with an equal label (not
    None) are connected beforehand and get no links for it. With ``sides`` (0
    or 1 for each set) only pairs of both sides are looked for."""
    forest = _Forest(labels or [None] * len(sets))
    before = [forest.find(i) for i in range(len(sets))]
    heads = np.array(before)                      # of each set, its component as it is now

    def same(i: int, others: np.ndarray) -> np.ndarray:
        return heads[others] == heads[i]

    def settle(node: _Node, stored: list[int]) -> None:
        """Mark a subtree that is one component now."""
        if all(k.same for k in node.kids):
            node.same = len({int(heads[stored[k.lo]]) for k in node.kids} | {int(heads[stored[i]]) for i in node.own}) == 1

    for i, others in _walks(_ranked(sets, sizes, num, den), sizes, num, den, sides, same, settle):
        for x in others:
            if heads[x] != heads[i]:
                forest.join(i, x)
                heads[heads == heads[x]] = heads[i]
    head: dict[int, int] = {}
    for i in range(len(sets)):
        head.setdefault(forest.find(i), i)
    return [(head[forest.find(i)], i) for i in range(len(sets)) if before[i] == i and head[forest.find(i)] != i]


def trie_pairs(sizes: list[int], sets: list[np.ndarray], num: int, den: int, sides: list | None = None) -> Iterator[tuple[int, list[int]]]:
    """(i, others): the sets that ``i`` links with under Jaccard >= num/den, each
    pair once. With ``sides`` (0 or 1 for each set) only pairs of both sides."""
    return _walks(_ranked(sets, sizes, num, den), sizes, num, den, sides)


def _pairs_task(num: int, den: int, pairs: bool):
    """One unit, as in ``_trie_task``, for every link. Rows are the pairs, or one
    for each linked class ``b``: the head ``a`` of its component here and ``w``,
    the rows of the classes it links with here."""
    def run(table: pa.Table) -> pa.Table:
        a, b, w = [], [], []
        by_group: dict = {}
        for g, cid, n, tokens, c, side in zip(*(table.column(x).to_pylist() for x in ("grp", "cid", "n", "tokens", "c", "side"))):
            by_group.setdefault(g, {})[cid] = (n, tokens, c, side)
        for rows in by_group.values():
            ids = sorted(rows)
            sides = [rows[i][3] for i in ids]
            forest, sums = _Forest([None] * len(ids)), [0] * len(ids)
            for me, others in trie_pairs([rows[i][0] for i in ids], [np.frombuffer(rows[i][1], "<u8") for i in ids], num, den,
                                         None if sides[0] is None else sides):
                if pairs:
                    a += [ids[me]] * len(others)
                    b += [ids[x] for x in others]
                    continue
                for x in others:
                    forest.join(me, x)
                    sums[me] += rows[ids[x]][2]
                    sums[x] += rows[ids[me]][2]
            linked = [i for i, x in enumerate(sums) if x]
            a += [ids[forest.find(i)] for i in linked]
            b += [ids[i] for i in linked]
            w += [sums[i] for i in linked]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "w": pa.array(w or [None] * len(a), pa.int64())})
    return run


def _trie_task(num: int, den: int):
    """One unit: blocks of one or more groups; the rows of each group are joined."""
    def run(table: pa.Table) -> pa.Table:
        a, b = [], []
        by_group: dict = {}
        for g, cid, n, tokens, label, side in zip(*(table.column(c).to_pylist() for c in ("grp", "cid", "n", "tokens", "label", "side"))):
            by_group.setdefault(g, {})[cid] = (n, tokens, label, side)
        for rows in by_group.values():
            if len(rows) < 2:
                continue
            ids = sorted(rows)
            sides = [rows[i][3] for i in ids]
            found = trie_links([rows[i][0] for i in ids], [np.frombuffer(rows[i][1], "<u8") for i in ids], num, den, [rows[i][2] for i in ids],
                               None if sides[0] is None else sides)
            a += [ids[x] for x, _ in found]
            b += [ids[y] for _, y in found]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _alive(s: Scratch, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(cid, n): classes with enough of their lowest hashes in other classes too."""
    rows = classes.select("cid", "n", F.explode("pre").alias("h"))
    shared = s.write(rows.groupBy("h").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo <> hi").select("h"), "shared")
    kmin = F.expr(f"1 + (({num} * n + {den - 1}) div {den}) div {SLACK}")
    alive = rows.join(shared.hint("merge"), "h", "left_semi").groupBy("cid").agg(F.first("n").alias("n"), F.count("*").alias("have"))
    alive = s.write(alive.where(F.col("have") >= kmin).select("cid", "n"), "alive")
    s.drop("shared")
    return alive


def _candidates(s: Scratch, sets: DataFrame) -> DataFrame:
    """(cid, n, grp): classes that can link at all, by coarse group: the prefix
    filter once more, on the fingerprints of their parts."""
    rows = sets.select("cid", F.inline(F.array(F.struct(F.lit(0).alias("range"), F.col("own").alias("parts"), F.col("own_least").alias("least")),
                                               F.struct(F.lit(1).alias("range"), F.col("below").alias("parts"), F.col("below_least").alias("least")))))
    rows = rows.select("cid", "range", "least", F.explode("parts").alias("h"))
    shared = s.write(rows.groupBy("h").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count("*").alias("df"))
                     .where("lo <> hi").select("h", "df"), "agreeing")
    kept = s.write(rows.join(shared.hint("merge"), "h").select("cid", "range", "least", "h", "df"), "kept")
    own = Window.partitionBy("cid", "range")
    front = kept.withColumns({"have": F.count("*").over(own), "at": F.row_number().over(own.orderBy("df", "h"))})
    front = s.write(front.where("at <= have - least + 1").select("cid", "h"), "front")
    anchor = s.write(front.groupBy("h").agg(F.min("cid").alias("anchor"), F.max("cid").alias("far")).where("anchor <> far").select("h", "anchor"), "anchor")
    edges = s.write(front.join(anchor.hint("merge"), "h").where("cid <> anchor").select(F.col("cid").alias("a"), F.col("anchor").alias("b")).distinct(), "coarse")
    groups = components(s.spark, edges, "jaccard-coarse")
    out = s.write(sets.select("cid", "n").join(groups, F.col("cid") == groups["node"]).select("cid", "n", F.col("root").alias("grp")), "candidates")
    s.drop("agreeing", "kept", "front", "anchor", "coarse")
    return out


def _blocks(s: Scratch, cand: DataFrame, block_tokens: int) -> DataFrame:
    """(cid, grp, blk, last): blocks of about ``block_tokens`` shingles in a
    group, by set size; ``last`` is the group's highest block. Offsets come
    from one row per (group, set size), so no group is gathered."""
    per_size = cand.groupBy("grp", "n").agg(F.count("*").alias("c"))
    w = Window.partitionBy("grp").orderBy("n")
    per_size = per_size.withColumn("before", F.sum(F.col("n") * F.col("c")).over(w) - F.col("n") * F.col("c"))
    per_size = per_size.withColumn("total", F.sum(F.col("n") * F.col("c")).over(Window.partitionBy("grp")))
    spread = F.col("n") * F.pmod(F.xxhash64("cid"), F.col("c"))
    return s.write(cand.join(per_size, ["grp", "n"]).select(
        "cid", "grp", "n", F.floor((F.col("before") + spread) / block_tokens).cast("long").alias("blk"),
        F.floor((F.col("total") - 1) / block_tokens).cast("long").alias("last"), "total"), "blocks")


def _run(s: Scratch, units: DataFrame, num: int, den: int, name: str) -> DataFrame:
    return s.write(units.groupBy("unit").applyInArrow(_trie_task(num, den), "a bigint, b bigint"), name)


def _labelled(s: Scratch, rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    root = components(s.spark, found, f"jaccard-{name}").select(F.col("node").alias("cid"), F.col("root").alias("label"))
    return rows.join(root, "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def _beside(s: Scratch, large: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """Every block with the next one of its group."""
    rows = large.withColumn("to", F.explode(F.array("blk", F.col("blk") - 1))).where("to >= 0 and to < last")
    rows = rows.select(F.concat_ws("/", F.col("grp").cast("string"), F.col("to").cast("string")).alias("unit"), "grp", "cid", "n", "tokens",
                       (F.col("blk") - F.col("to")).cast("int").alias("side"))
    return _run(s, _labelled(s, rows, found, "l1"), num, den, "beside")


def _rest(s: Scratch, large: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """What is apart from its group's largest component, against every block of compatible sizes."""
    rows = s.write(_labelled(s, large.select("cid", "n", "tokens", "grp", "blk"), found, "l2"), "labelled", large_rows=True)
    count = rows.groupBy("grp", "label").agg(F.count("*").alias("c"))
    main = count.groupBy("grp").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    apart = rows.join(main, "grp").where("label <> main").drop("main")
    span = rows.groupBy("grp", "blk").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    mine = apart.groupBy("grp", "blk").agg(F.min("n").alias("a"), F.max("n").alias("z")).withColumnRenamed("blk", "from")
    pairs = s.write(mine.join(span, "grp").where(f"blk <> from and {den} * most >= {num} * a and {num} * least <= {den} * z")
                    .select("grp", "from", "blk"), "pairs")
    unit = F.concat_ws("/", F.col("grp").cast("string"), F.col("from").cast("string"), F.col("blk").cast("string")).alias("unit")
    cols = ["grp", "cid", "n", "tokens", "label"]
    left = apart.withColumnRenamed("blk", "from").join(pairs, ["grp", "from"]).select(unit, *cols, F.lit(0).alias("side"))
    right = rows.join(pairs, ["grp", "blk"]).select(unit, *cols, F.lit(1).alias("side"))
    return _run(s, left.union(right), num, den, "apart")


def _every(s: Scratch, sets: DataFrame, unit: Column, num: int, den: int, pairs: bool) -> DataFrame:
    """Every block with itself, and with every other block of its group that has compatible sizes."""
    def run(units: DataFrame, name: str) -> DataFrame:
        return s.write(units.groupBy("unit").applyInArrow(_pairs_task(num, den, pairs), "a bigint, b bigint, w bigint"), name)
    cols = ["grp", "cid", "n", "tokens", "c"]
    found = run(sets.select(unit.alias("unit"), *cols, F.lit(None).cast("int").alias("side")), "inside")
    large = sets.where("last > 0")
    span = s.write(large.groupBy("grp", "blk").agg(F.min("n").alias("least"), F.max("n").alias("most")), "span")
    if not span.limit(1).count():
        return found
    mine = span.select("grp", F.col("blk").alias("from"), F.col("least").alias("a"), F.col("most").alias("z"))
    met = s.write(mine.join(span, "grp").where(f"from < blk and {den} * most >= {num} * a and {num} * least <= {den} * z").select("grp", "from", "blk"), "met")
    both = F.concat_ws("/", F.col("grp").cast("string"), F.col("from").cast("string"), F.col("blk").cast("string")).alias("unit")
    left = large.withColumnRenamed("blk", "from").join(met, ["grp", "from"]).select(both, *cols, F.lit(0).alias("side"))
    right = large.join(met, ["grp", "blk"]).select(both, *cols, F.lit(1).alias("side"))
    return found.union(run(left.union(right), "across"))


def jaccard_links(s: Scratch, docs: DataFrame, k: int, num: int, den: int, block_tokens: int = BLOCK_TOKENS,
                  every: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows has (doc_id, key, n, cid) per row of ``docs``, key
    the hash of id and text; links (a, b) between classes join the classes
    into their components. With ``every`` all links are found: "pairs" gives
    each once, "counts" gives (a, b, w) as in ``_pairs_task``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"),
                        F.col("text").cast("string").alias("text"))
    sketch = s.write(texts.mapInArrow(_sketch(k, num, den), SKETCH), "sketch")
    rows = s.write(sketch.drop("pre"), "rows")
    classes = s.write(sketch.where("cid is not null").groupBy("cid").agg(
        F.first("n").alias("n"), F.first("pre").alias("pre"), F.min("key").alias("key")), "classes")
    s.drop("sketch")
    alive = _alive(s, classes.select("cid", "n", "pre"), num, den)
    chosen = s.write(classes.select("cid", "key").join(alive.select("cid"), "cid", "left_semi").select(F.col("key").alias("pick")).distinct(), "chosen")
    s.drop("classes")
    picked = texts.join(chosen.hint("merge"), texts["key"] == chosen["pick"], "left_semi").select("text")
    whole = s.write(picked.mapInArrow(_whole_sets(k, num, den), SETS), "whole", large_rows=True)
    blocks = _blocks(s, _candidates(s, whole), block_tokens)
    if every:
        blocks = s.write(blocks.join(rows.groupBy("cid").agg(F.count("*").alias("c")), "cid"), "sized")
    sets = s.write(whole.select("cid", "n", "tokens").join(blocks.drop("n").hint("merge"), "cid"), "sets", large_rows=True)
    s.drop("whole")
    # groups of one block share units, several groups to a unit
    tokens = blocks.where("last = 0").agg(F.sum("n")).first()[0] or 0
    packs = max(1, -(-int(tokens) // block_tokens))
    unit = F.when(F.col("last") == 0, F.concat(F.lit("p"), F.pmod(F.xxhash64("grp"), F.lit(packs)).cast("string"))).otherwise(
        F.concat_ws("/", F.col("grp").cast("string"), F.col("blk").cast("string")))
    if every:
        found = _every(s, sets, unit, num, den, every == "pairs")
        s.drop("sets")
        return rows, found
    none = F.lit(None)
    found = _run(s, sets.select(unit.alias("unit"), "grp", "cid", "n", "tokens", none.cast("long").alias("label"), none.cast("int").alias("side")),
                 num, den, "inside")
    large = sets.where("last > 0")
    if large.limit(1).count():
        found = found.union(_beside(s, large, found, num, den))
        found = found.union(_rest(s, large, found, num, den))
        s.drop("labelled")
    s.drop("sets")
    return rows, found


def _components(s: Scratch, docs: DataFrame, k: int, num: int, den: int, block_tokens: int) -> DataFrame:
    """(doc_id, key, n, cid, root, least) per row; cid, root and least are null without words."""
    rows, found = jaccard_links(s, docs, k, num, den, block_tokens)
    return _named(s, rows, found)


def _named(s: Scratch, rows: DataFrame, found: DataFrame) -> DataFrame:
    root = components(s.spark, found, "jaccard-links").withColumnRenamed("node", "cid")
    least = rows.where("cid is not null").groupBy("cid").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.min("doc_id").alias("least"))
    named = least.join(root, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    heads = named.groupBy("root").agg(F.min("least").alias("least"), F.min("first").alias("first"))
    names = s.write(named.select("cid", "root").join(heads, "root"), "names")
    return rows.join(names, "cid", "left")


def jaccard_components(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100,
                       block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` under a Jaccard
    similarity of at least num/den of k-word shingle sets."""
    named = _components(Scratch(spark, "jaccard"), docs, k, num, den, block_tokens)
    return named.select("doc_id", F.col("n").alias("n_shingles"),
                        F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def jaccard_join(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100,
                 block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``jaccard_components`` with ``n_links``: the other rows each row links with."""
    s = Scratch(spark, "jaccard-join")
    rows, found = jaccard_links(s, docs, k, num, den, block_tokens, "counts")
    named = _named(s, rows, found)
    other = found.groupBy("b").agg(F.sum("w").alias("w"))
    count = rows.where("cid is not null").groupBy("cid").agg(F.count("*").alias("c"))
    count = s.write(count.join(other, F.col("cid") == F.col("b"), "left").select(
        F.col("cid").alias("of"), (F.col("c") - 1 + F.coalesce("w", F.lit(0))).alias("n_links")), "counts")
    return named.join(count, F.col("cid") == F.col("of"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def jaccard_pairs(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100,
                  block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(rows, links): (doc_id, n_shingles, cid) per row of ``docs``, and every
    link (a, b) between two classes, once. Rows of one class are equal sets
    and link without a pair."""
    rows, found = jaccard_links(Scratch(spark, "jaccard-pairs"), docs, k, num, den, block_tokens, "pairs")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "cid"), found.select("a", "b")


def one_per_group(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns: of each component one row, the one
    with the least id (nulls first; of equal ids the least hash of id and
    text). Rows without words all stay, since they are linked with nothing."""
    s = Scratch(spark, "jaccard-keep")
    rows = _components(s, docs, k, num, den, BLOCK_TOKENS).where("cid is not null")
    keys = rows.groupBy("key").agg(F.count("*").alias("c"), F.max(F.col("key") == F.col("first.key")).alias("stays"))
    name = free_name(docs, "_key")
    go = s.write(keys.where("not stays or c > 1").select(F.col("key").alias(name)), "go")
    again = s.write(keys.where("stays and c > 1").select(F.col("key").alias(name)), "again")
    key = F.xxhash64("doc_id", "text")
    alone = docs.join(go, key == go[name], "left_anti")
    twice = docs.join(again, key == again[name]).dropDuplicates([name]).drop(name)
    return alone.union(twice)
