"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document's set holds the hashes of its distinct five-word shingles (A-Z lower-cased); a text of one to four words has
one shingle, the whole sequence. Two sets of sizes x and y reach a similarity of 0.75 only if they share at least
T = ceil(0.75 max(x, y)) shingles, so a set's partners occur in at least one of its x - T + 1 rarest inverted lists. The
order that tells rare from frequent shingles is one for all documents: shingles that are frequent in some stretch of the
input come last, then the hash decides. Any common order gives the same links.

1. Equal sets are one class from the start, so copies never meet. Only postings of the rare lists are shuffled. A list's
   first class is its pivot.
2. A list of up to SHORT classes gives its pairs of fitting size, each of which must pass a bitmap test (a bit for each
   residue of the shingle hashes tells whether an odd number of them has it, so the sets differ in at least as many
   shingles as their bitmaps in bits). A longer list gives one row a member.
3. Classes meet in units, one for each pivot: what a pivot's long lists hold, and the pairs left of its short ones. Near
   copies share their lists and so their pivot, and a class goes to few units; a unit costs a row a member, not a row a pair.
4. A unit's task builds the inverted index of its members and searches it with DivideSkip: a query's lists are divided by
   length into L long ones and the short ones, these are merged with a heap into occurrence counts, members that occur
   T - L times or more are probed by bisection in the long lists, and those that reach the overlap are linked. Members
   already in the query's component aren't looked for. The task gives a forest, at most one edge a member.
5. A unit too heavy for a task is dealt into parts. Parts are searched apart first, each with the unit's first member
   beside them; then only members outside the unit's main component meet the other parts. A group of near copies of any
   size thus costs a few rows a member.

Classes are named by a 64-bit signature that is compared with a second one over the whole input; should two different sets
share the first, all are named anew with another salt. A shingle is known by 52 bits of its hash: two different ones of a
given pair of sets of a thousand are mistaken for each other with odds of about 2**-32.

Defined cases: null, empty and blank texts have no shingles, and are their own component. Rows that repeat a doc_id are
documents of their own with that id. A null doc_id sorts after all others, and stays null if nothing smaller is linked.
Columns other than doc_id and text are passed through by keep_one, whatever their names. An empty table gives none.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm._spark import blooms, bloom_words, broadcast_if_small, cut, cut_small, in_bloom, shielded, small_batches, text_key
from folioscope.llm._words import NO_ID, buffers, find_words, gram_hashes, gram_starts, ids, mix, sequence_hashes, slices, word_hashes
from folioscope.llm.components import components

U = np.uint64
SHINGLE = 5
#: Least similarity in hundredths.
LEAST = 75
#: Of a shingle's hash; with the row's number, the key by which sets are sorted.
BITS = 52
#: Classes of a list that a task holds to pair them; longer lists pass through it.
SHORT = 64
#: Shingles (and MEMBER for each class) of a unit, or of each side of a pair of parts, that a task holds.
LOAD, MEMBER = 1 << 21, 128
#: DivideSkip's weight of a probe against a merged posting.
MU = 0.01
#: Shingles of consecutive documents counted at once, and the documents among them that make a shingle frequent.
HELD, OFTEN = 1 << 22, 4
#: Frequent shingles that are sent to all tasks to be put last in the common order; a bound on the broadcast (8 MB). The
#: order decides cost, not results.
FREQUENT = 1 << 20

def shingle_sets(text: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, sorted by both, and the bounds of the rows; SLICE_ROWS rows at most."""
    w = find_words(*buffers(text))
    h = word_hashes(w, lower=True)
    full = gram_starts(w, k)
    few = np.flatnonzero((w.counts > 0) & (w.counts < k))
    g = np.concatenate([gram_hashes(h, k)[full] if len(full) else np.zeros(0, np.uint64), sequence_hashes(h, w.first[few], w.first[few + 1]) if len(few) else np.zeros(0, np.uint64)])
    key = np.concatenate([w.row[full], few]).astype(np.uint64) << U(BITS) | g >> U(64 - BITS)
    key.sort()
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    row = (key >> U(BITS)).astype(np.int64)
    return row, key & U((1 << BITS) - 1), np.searchsorted(row, np.arange(len(text) + 1))


def bitmaps(row: np.ndarray, g: np.ndarray, first: np.ndarray) -> pa.Array:
    """Of each set, which residues an odd number of its hashes has. The number of residues is a power of two, at least
    twice the set's size, so that a larger bitmap folds to a smaller one."""
    n = np.diff(first)
    size = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    start = np.append(0, np.cumsum(size))
    at = start[row] + (g & (size[row] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=start[-1]) & 1).astype(bool), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((start // 8).astype(np.int32).tobytes()), pa.py_buffer(bits.tobytes())])


def least_difference(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Bits in which the bitmaps differ, the larger folded to the smaller."""
    (da, oa), (db, ob) = _bytes(a), _bytes(b)
    la, lb = np.diff(oa), np.diff(ob)
    out = np.zeros(len(la), np.int64)
    for x, y in {*zip(la.tolist(), lb.tolist(), strict=True)}:
        at = np.flatnonzero((la == x) & (lb == y))
        p, q = (d[o[at][:, None] + np.arange(z)] for d, o, z in ((da, oa[:-1], x), (db, ob[:-1], y)))
        z = min(x, y)
        p, q = (np.bitwise_xor.reduce(v.reshape(len(at), -1, z), axis=1) for v in (p, q))
        out[at] = np.bitwise_count(p ^ q).sum(1)
    return out


def _bytes(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    bufs = x.buffers()
    off = np.frombuffer(bufs[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
    return np.frombuffer(bufs[2], np.uint8), off


def signatures(g: np.ndarray, first: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, the same for equal sets only."""
    out = []
    with np.errstate(over="ignore"):
        for base in (U(0x243F6A8885A308D3), U(0x13198A2E03707344)):
            by = mix(np.array([base + U(salt)]))[0]
            sums = np.zeros(len(g) + 1, np.uint64)
            np.cumsum(mix(g ^ by), out=sums[1:])
            out.append(mix(sums[first[1:]] - sums[first[:-1]] + by))
    return out[0], out[1]


def described(docs: DataFrame, k: int = SHINGLE, salt: int = 0) -> DataFrame:
    """For each document: doc_id, ka and kb (of its text), n (set size), s (signature), t (a second one), bits. For each shingle frequent in a
    stretch of documents: hot, n (documents of the stretch that have it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def often() -> pa.RecordBatch:
            g = np.sort(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
            head = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
            n = np.diff(np.append(head, len(g)))
            seen.clear()
            return _rows(hot=g[head][n >= OFTEN], n=n[n >= OFTEN])

        seen: list[np.ndarray] = []
        for part in slices(batches):
            row, g, first = shingle_sets(part.column(1), k)
            s, t = signatures(g, first, salt)
            yield _rows(bitmaps(row, g, first), doc_id=ids(part), ka=part.column(2).to_numpy(), kb=part.column(3).to_numpy(), n=np.diff(first), s=s, t=t)
            seen.append(g)
            if sum(map(len, seen)) > HELD:
                yield often()
        yield often()

    return small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text", *text_key("text")).mapInArrow(run, "doc_id long, ka long, kb long, n long, s long, t long, hot long, bits binary")


def _rows(bits: pa.Array | None = None, **cols: np.ndarray) -> pa.RecordBatch:
    size = len(cols["n"])
    names = ["doc_id", "ka", "kb", "n", "s", "t", "hot"]
    made = [pa.array(cols[c].view(np.int64)) if c in cols else pa.nulls(size, pa.int64()) for c in names]
    return pa.RecordBatch.from_arrays([*made, pa.nulls(size, pa.binary()) if bits is None else bits], [*names, "bits"])


def short_lists(docs: DataFrame, frequent: np.ndarray, k: int = SHINGLE, least: int = LEAST, salt: int = 0) -> DataFrame:
    """(h, s, n): postings of each set in its x - T + 1 rarest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            row, g, first = shingle_sets(part.column(0), k)
            s, _ = signatures(g, first, salt)
            n = np.diff(first)
            if len(frequent) and len(g):
                last = frequent[np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)] == g
                key = row.astype(np.uint64) << U(BITS + 1) | last.astype(np.uint64) << U(BITS) | g
                key.sort()
                g = key & U((1 << BITS) - 1)
            take = n - needed(n, least) + 1
            keep = np.arange(len(g)) - first[row] < take[row]
            row = row[keep]
            yield pa.RecordBatch.from_arrays([pa.array(g[keep].view(np.int64)), pa.array(s[row].view(np.int64)), pa.array(n[row].astype(np.int32))], ["h", "s", "n"])

    return docs.select("text").mapInArrow(run, "h long, s long, n int")


def needed(n, least: int):
    """T: shingles that a set of n shares with any set that it links to."""
    return (least * n + 99) // 100


def _pairs(x: np.ndarray, least: int) -> pa.RecordBatch:
    """All fitting pairs of whole short lists (rows: list, class, size), each once, with the least pivot of their lists."""
    h, s, n = x
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(head, len(h)))
    at = np.arange(len(h)) - np.repeat(head, size)
    pivot = np.repeat(s[head], size)
    found = [np.zeros((0, 3), np.int64)]
    for d in range(1, int(size.max())):
        j = np.flatnonzero(at >= d)
        j = j[(100 * n[j - d] >= least * n[j]) & (100 * n[j] >= least * n[j - d])]
        found.append(np.stack([s[j - d], s[j], pivot[j]], 1))  # lists are sorted by class
    p = np.concatenate(found)
    p = p[np.lexsort((p[:, 2], p[:, 1], p[:, 0]))]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:, :2] != p[:-1, :2]).any(1)
    return _out(a=p[new, 0], b=p[new, 1], u=p[new, 2])


def _out(**cols: np.ndarray) -> pa.RecordBatch:
    size = len(cols["a"])
    return pa.RecordBatch.from_arrays([pa.array(cols[c]) if c in cols else pa.nulls(size, pa.int64()) for c in "abun"], list("abun"))


def merged(postings: DataFrame, least: int = LEAST, short: int = SHORT) -> DataFrame:
    """(a, b, u, n): the lists read in order, u the first class of the list. With b: a pair to look at, a < b. Without:
    class a, of size n, is in a long list. No more than short members of a list are held."""

    def whole(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        head = np.flatnonzero(np.append(True, x[0, 1:] != x[0, :-1]))
        size = np.diff(np.append(head, x.shape[1]))
        each = np.repeat(size, size)
        some = x[:, (each > 1) & (each <= short)]
        if some.shape[1]:
            yield _pairs(some, least)
        many = each > short
        if many.any():
            yield _out(a=x[1, many], u=np.repeat(x[1, head], size)[many], n=x[2, many])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)  # the last list so far, if it is still short
        before, going, pivot = None, None, None  # the last posting; the long list that passes through, and its pivot
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in range(3)])
            new = np.append(before != (x[0, 0], x[1, 0]), (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1]))
            before = (x[0, -1], x[1, -1])
            x = np.concatenate([held, x[:, new]], 1)
            held = x[:, :0]
            if going is not None:
                to = int(np.searchsorted(x[0], going, "right"))
                yield _out(a=x[1, :to], u=np.full(to, pivot), n=x[2, :to])
                x = x[:, to:]
            if x.shape[1]:
                to = int(np.searchsorted(x[0], x[0, -1]))
                if to:
                    yield from whole(x[:, :to])
                x, going = x[:, to:], None
                if x.shape[1] > short:
                    going, pivot = x[0, 0], x[1, 0]
                    yield from whole(x)
                else:
                    held = x
        if held.shape[1]:
            yield from whole(held)

    return postings.repartition("h").sortWithinPartitions("h", "s").mapInArrow(run, "a long, b long, u long, n long")


def alike(pairs: DataFrame, sketches: DataFrame, least: int = LEAST) -> DataFrame:
    """(u, s, n): members of units by the pairs (a, b, u) that the bitmaps don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = least_difference(batch.column(5), batch.column(6))
            a, b, u, na, nb = (batch.column(i).to_numpy() for i in range(5))
            n = na + nb
            # both = (n - apart) / 2 at most, either = n - both
            keep = 100 * (n - apart) >= least * (n + apart)
            s, size, u = np.append(a[keep], b[keep]), np.append(na[keep], nb[keep]), np.append(u[keep], u[keep])
            by = np.lexsort((s, u))
            new = np.ones(len(by), bool)
            new[1:] = (s[by][1:] != s[by][:-1]) | (u[by][1:] != u[by][:-1])
            by = by[new]
            yield pa.RecordBatch.from_arrays([pa.array(u[by]), pa.array(s[by]), pa.array(size[by])], ["u", "s", "n"])

    x, y = (sketches.select(F.col("s").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "u", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "u long, s long, n long")


def named_texts(docs: DataFrame, classes: DataFrame, k: int = SHINGLE, salt: int = 0) -> DataFrame:
    """(s, text): a text of each class, found by a bit filter of bounded size (a few others pass it by chance)."""
    bits = blooms(classes, "s", bloom_words(docs.count()), used=F.lit(True))["used"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            _, g, first = shingle_sets(part.column(0), k)
            s, _ = signatures(g, first, salt)
            keep = in_bloom(bits, s) & (np.diff(first) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(s[keep].view(np.int64)), part.column(0).filter(pa.array(keep))], ["s", "text"])

    return docs.select("text").mapInArrow(run, "s long, text string").dropDuplicates(["s"])


class Index:
    """The inverted lists of some sets (hashes g, bounds first): of each shingle the sets that have it, in order."""

    def __init__(self, g: np.ndarray, first: np.ndarray, least: int = LEAST) -> None:
        self.first, self.least, self.n = first, least, np.diff(first)
        by = np.argsort(g, kind="stable")
        new = np.append(True, g[by][1:] != g[by][:-1])
        self.members = np.repeat(np.arange(len(self.n)), self.n)[by]
        self.head = np.append(np.flatnonzero(new), len(g))
        self.list_of = np.empty(len(g), np.int64)  # of each posting in the order of g
        self.list_of[by] = np.cumsum(new) - 1
        self.length = np.diff(self.head)

    def of(self, x: int) -> np.ndarray:
        return self.members[self.head[x] : self.head[x + 1]]

    def partners(self, q: int, wanted: np.ndarray) -> np.ndarray:
        """The wanted members that link to q, by DivideSkip."""
        size = int(self.n[q])
        least = needed(size, self.least)
        lists = self.list_of[self.first[q] : self.first[q + 1]]
        lists = lists[self.length[lists] > 1]
        if len(lists) < least:
            return lists[:0]
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        longest = int(self.length[lists[-1]])
        n_long = min(least - 1, int(least / (MU * math.log2(longest) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        merge = merged_runs([self.of(x) for x in short.tolist()])
        head = np.flatnonzero(np.append(True, merge[1:] != merge[:-1]))
        count = np.diff(np.append(head, len(merge)))
        found = merge[head]
        keep = (count >= least - n_long) & wanted[found]
        found, count = found[keep], count[keep]
        # overlap o of sizes x, y: 100 o >= least (x + y - o)
        goal = (self.least * (size + self.n[found]) + 99 + self.least) // (100 + self.least)
        for left, x in zip(range(n_long, 0, -1), long.tolist(), strict=True):
            keep = count + left >= goal
            found, count, goal = found[keep], count[keep], goal[keep]
            if not len(found):
                break
            inside = self.of(x)
            at = np.minimum(np.searchsorted(inside, found), len(inside) - 1)
            count = count + (inside[at] == found)
        return found[count >= goal]


def merged_runs(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of all: a heap gives the two shortest, which are merged (a stable sort of two runs is a merge)."""
    heap = [(len(r), i, r) for i, r in enumerate(runs)]
    heapq.heapify(heap)
    number = len(runs)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, i, b = heap[0]
        both = np.concatenate([a, b])
        both.sort(kind="stable")
        heapq.heapreplace(heap, (len(both), number, both))
        number += 1
    return heap[0][2]


def forest(g: np.ndarray, first: np.ndarray, root: np.ndarray, asking: np.ndarray | None = None, least: int = LEAST) -> list[tuple[int, int]]:
    """Links between sets that connect all that are linked, one a merger of components; root tells the components known.
    With asking, only those sets are queries; else all, but first a few leaders are compared with all others, so that the
    members of the largest component need not ask."""
    n, edges = np.diff(first), []
    root = np.unique(root, return_inverse=True)[1]

    def join(a: int, others: np.ndarray) -> None:
        for b in others.tolist():
            if root[a] != root[b]:
                edges.append((a, b))
                root[root == root[b]] = root[a]

    if asking is None:
        owner, lead = np.repeat(np.arange(len(n)), n), 0
        while True:
            mine = g[first[lead] : first[lead + 1]]
            hit = mine[np.minimum(np.searchsorted(mine, g), len(mine) - 1)] == g
            both = np.bincount(owner[hit], minlength=len(n))
            linked = np.flatnonzero((100 * both >= least * (n + n[lead] - both)) & (root != root[lead]))
            # of several in one component the first
            linked = linked[np.sort(np.unique(root[linked], return_index=True)[1])]
            edges += [(lead, int(b)) for b in linked]
            root[np.isin(root, root[linked])] = root[lead]
            if len(linked) < 16:
                break
            lead = int(linked[both[linked].argmin()])
        asking = np.flatnonzero(root != np.bincount(root).argmax())
        if len(n) == 2:
            return edges
    if len(asking):
        index = Index(g, first, least)
        for q in asking.tolist():
            join(q, index.partners(q, root != root[q]))
    return edges


def searched(units: DataFrame, texts: DataFrame, every: bool, k: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """(a, b): links within parts of units, searched for by every member or by those that ask. units: u, part, s, root,
    asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(key: np.ndarray, g: list[np.ndarray]) -> pa.RecordBatch:
            cuts = np.append(np.flatnonzero(np.append(True, (key[1:, :2] != key[:-1, :2]).any(1))), len(key))
            flat, first = np.concatenate(g), np.append(0, np.cumsum([len(x) for x in g]))
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                mine, s = first[a : b + 1], key[a:b, 2]
                asks = None if every else np.flatnonzero(key[a:b, 4])
                out += [(s[x], s[y]) for x, y in forest(flat[mine[0] : mine[-1]], mine - mine[0], key[a:b, 3], asks, least)]
            e = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(e.min(1)), pa.array(e.max(1))], ["a", "b"])

        keys, sets, weight = np.zeros((0, 5), np.int64), [], 0
        for part in slices(batches):
            key = np.stack([np.asarray(part.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("u", "part", "s", "root", "asks")], 1)
            _, g, first = shingle_sets(part.column(part.schema.get_field_index("text")), k)
            keys, weight = np.concatenate([keys, key]), weight + len(g)
            sets += [g[x:y] for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            if weight >= LOAD // 4:
                whole = int(np.flatnonzero((keys[:, :2] == keys[-1, :2]).all(1))[0])
                if whole:
                    yield judged(keys[:whole], sets[:whole])
                    keys, sets = keys[whole:], sets[whole:]
                    weight = sum(map(len, sets))
        if len(keys):
            yield judged(keys, sets)

    moved = units.join(texts, "s").select("u", "part", "s", "root", F.col("asks").cast("int").alias("asks"), "text")
    return moved.repartition("u", "part").sortWithinPartitions("u", "part", "s").mapInArrow(run, "a long, b long")


def first_parts(units: DataFrame, load: int) -> tuple[DataFrame, DataFrame]:
    """units with their part, and the heavy units (u, parts, lead). A light unit is one part; a heavy one is dealt into
    parts, each with the unit's first member beside its own."""
    weight = units.groupBy("u").agg(F.ceil(F.sum(F.col("n") + MEMBER) / load).cast("int").alias("parts"), F.min("s").alias("lead"))
    heavy = cut_small(weight.filter("parts > 1"))
    own = F.struct(F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("s"), F.col("parts"))).cast("int").alias("part"), "s", "n")
    dealt = units.join(broadcast_if_small(heavy), "u", "left").select("u", own.alias("x"), "parts", "lead")
    beside = dealt.filter(F.col("x.s") == F.col("lead")).select("u", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.col("x.s").alias("s"), F.col("x.n").alias("n")))).alias("x"))
    every = dealt.filter(F.col("lead").isNull() | (F.col("x.s") != F.col("lead"))).select("u", "x.*").unionByName(beside.select("u", "x.*"))
    return every.withColumn("root", F.col("s")).withColumn("asks", F.lit(False)), heavy


def across_parts(units: DataFrame, heavy: DataFrame, roots: DataFrame, load: int) -> DataFrame:
    """units for the second search: of each heavy unit the members outside its most frequent component ask all parts. A key
    is a block of these and a part; both sides weigh load at most."""
    placed = units.join(broadcast_if_small(heavy), "u").join(roots.select(F.col("node").alias("s"), "root"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    main = placed.groupBy("u", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("u").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    placed = cut(placed.join(broadcast_if_small(cut(main)), "u"))
    blocks = cut(placed.filter("root != main").groupBy("u").agg(F.ceil(F.sum(F.col("n") + MEMBER) / load).cast("int").alias("blocks")))
    placed = placed.join(broadcast_if_small(blocks), "u")
    deal = lambda by, of, salt: F.pmod(F.xxhash64(F.lit(salt), by), of).cast("int")
    number = lambda block, part: (block.cast("long") * F.col("parts") + part).alias("part")
    ask = placed.filter("root != main").select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "s", "root", "blocks", "parts").select("u", number(deal("s", F.col("blocks"), 1), F.col("p")), "s", "root", F.lit(True).alias("asks"))
    told = placed.select("u", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "s", "root", "parts").select("u", number(F.col("b"), deal("s", F.col("parts"), 2)), "s", "root", F.lit(False).alias("asks"))
    return ask.unionByName(told).groupBy("u", "part", "s", "root").agg(F.max("asks").alias("asks"))


def linked(docs: DataFrame, k: int = SHINGLE, least: int = LEAST, short: int = SHORT, load: int = LOAD) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, ka, kb, n, s) of the documents, and for each class with a link (node, root)."""
    salt = 0
    while True:
        rows = cut(described(docs, k, salt))
        shared = rows.filter("hot IS NULL").groupBy("s").agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a != b")
        if shared.isEmpty():
            break
        salt += 1
    counts = rows.filter("hot IS NOT NULL").groupBy("hot").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hot").limit(FREQUENT).toArrow()
    frequent = np.sort(counts["hot"].to_numpy().view(np.uint64)) if counts.num_rows else np.zeros(0, np.uint64)
    sketches = rows.filter("hot IS NULL AND n > 0").groupBy("s").agg(F.min("n").alias("n"), F.first("bits").alias("bits"))
    lists = cut(merged(short_lists(docs, frequent, k, least, salt), least, short))
    pairs = lists.filter("b IS NOT NULL").groupBy("a", "b").agg(F.min("u").alias("u"))
    units = cut_small(alike(pairs, sketches, least).unionByName(lists.filter("b IS NULL").select("u", F.col("a").alias("s"), "n")).distinct())
    texts = named_texts(docs, units, k, salt)
    placed, heavy = first_parts(units, load)
    links = cut_small(searched(placed, texts, True, k, least))
    roots = cut_small(components(links))
    if not heavy.isEmpty():
        links = links.unionByName(cut_small(searched(across_parts(units, heavy, roots, load), texts, False, k, least)))
        roots = cut_small(components(links))
    return rows.filter("hot IS NULL").select("doc_id", "ka", "kb", "n", "s"), roots


def similar_components(docs: DataFrame, k: int = SHINGLE, least: int = LEAST, short: int = SHORT, load: int = LOAD) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs, and ka and kb, which with doc_id name it."""
    rows, roots = linked(docs, k, least, short, load)
    classes = rows.filter("n > 0").groupBy("s").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots, classes["s"] == roots["node"], "left").withColumn("root", F.coalesce("root", "s")).drop("node")
    ids_ = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(ids_, "root").select("s", "component_id")
    real = lambda c: F.nullif(c, F.lit(NO_ID))
    return rows.join(named, "s", "left").select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"), "ka", "kb")


@shielded
def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one of least doc_id; all columns stay. Texts without shingles are
    components of their own. Of rows that repeat the least doc_id, or of a component without any id, all stay. Rows go by
    their own text: one without id, or that shares its id with another, doesn't take that along."""
    gone = similar_components(docs).filter("component_id < doc_id OR doc_id IS NULL AND component_id IS NOT NULL")
    gone = gone.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__gone"), F.col("ka").alias("__ka"), F.col("kb").alias("__kb")).distinct()
    ka, kb = text_key("text")
    return docs.join(gone, (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == gone["__gone"]) & (ka == gone["__ka"]) & (kb == gone["__kb"]), "left_anti")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ka", "kb")


#: Links by an index of all shingles of distinct sets; then the least id spreads over the links.
OP8_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM d),
c AS MATERIALIZED (SELECT min(doc_id) AS id, s FROM g WHERE len(s) > 0 GROUP BY s),
p AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS x FROM c),
o AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM p a JOIN p b USING (x) WHERE a.id < b.id GROUP BY a.id, b.id),
l AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * i >= 75 * (na + nb - i) UNION ALL SELECT b, a FROM o WHERE 100 * i >= 75 * (na + nb - i)),
r AS (SELECT id AS node, id AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, coalesce(m.root, g.doc_id) AS component_id
FROM g LEFT JOIN c ON c.s = g.s LEFT JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) m ON m.node = c.id
"""
