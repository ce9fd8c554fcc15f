"""N-gram Jaccard join: size-aware, with a light and a heavy side.

A document's set holds the hashes of its K-word shingles. Equal sets become one class. For two classes of
sizes a <= b and similarity >= T the overlap is at least c(b) = ceil(T * b), so

* light classes (a size up to the boundary) emit every subset of the fixed size c(m), for each size m that a linked
  larger class can have; two linked light classes share a subset;
* heavy classes, and the light ones whose size a heavy class can link to, scan inverted lists. Lists of single shingles hold
  chance pairs, whose number grows with the square of the input, so an entry is a segment: sizes are cut into ranges, each range
  (with the one above it) into segments by the hash of an element, and a set enters its D + 1 largest segments, where D is the most elements
  in which two linked sets of the range can differ. A differing element spoils one segment, so linked sets share an entered one. A
  set with no more than D segments enters all of them and, for its like, its first n - c(n) + 1 elements in one global order.

The boundary is the one of least cost: rows that subsets make below it, and list entries above it, summed over all classes.
Within a list, parity bitmaps of the sets give upper bounds of overlaps; the pairs
that the bounds allow are returned as a spanning forest, never as all pairs. Forests of all lists make groups, and
in a group links are verified exactly on the sorted sets, again as a forest. Lists and groups are dealt into
blocks bounded by rows and by elements; each pair of blocks is one piece of work, the pairs of a group go to tasks in turn, and no cap drops
anything: long lists only make more block pairs.

Defined results: null texts and texts without words have n_shingles 0 and link with nothing; repeated rows share a class;
a null doc_id takes part, but cannot name a component unless it stands alone; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docnav.llm.common import Scratch, connected_components, lean, load, mix, shingle_hashes

#: Sizes that may be light, rows in a block of a group and of a list, and elements in a block of a group.
MOST_LIGHT, BLOCK, LIST, ELEMENTS = 32, 256, 1024, 1 << 18
#: Bits in the maps of small and of large sets.
NARROW, WIDE = 1024, 8192
#: Classes that a task remembers, rows in a batch that it returns, and entries up to which equal lists are looked at once.
_MOST_ENTERED, _FLUSH, _SHORT_LIST = 1 << 16, 1 << 16, 64
#: Bits in the filter of wanted ids: for each id, at least, at most (8 MB in each task).
_ID_BITS, _LEAST_BITS, _MOST_BITS, _PROBES = 12, 16, 26, 4
#: Sizes up to which the grid of ranges goes, and standard deviations by which a set's segments exceed D.
_LARGEST, _SURE = 1 << 40, 3.0


def least_overlap(n: int, t: tuple[int, int]) -> int:
    """ceil(T * n), in integers."""
    return -(-t[0] * n // t[1])


def largest_partner(n: int, t: tuple[int, int]) -> int:
    return n * t[1] // t[0]


def subset_sizes(n: int, t: tuple[int, int], boundary: int) -> list[tuple[int, int]]:
    """(m, c(m)) for each size m >= n of a light class that can link to a different one of size n."""
    return [(m, c) for m in range(n, min(boundary, largest_partner(n, t)) + 1) if 0 < (c := least_overlap(m, t)) <= n and (m > n or c < n)]


@cache
def grid(t: tuple[int, int]) -> list[int]:
    """First sizes of the ranges. A range reaches over at least one step of T, so partners are in the same or in neighbouring ranges; of the
    widths in steps the one with the fewest entries for an average set is taken."""
    step = math.log(t[1] / t[0])

    def entries(k: int) -> float:
        return (math.exp(k * step) - 1) / (k * step) + (1 - t[0] / t[1]) / (k * step)

    ratio = (t[1] / t[0]) ** min(range(1, 7), key=entries)
    out = [1]
    while out[-1] < _LARGEST:
        out.append(max(out[-1] + 1, math.floor(out[-1] * ratio)))
    return out


def _occupied(n: int, s: int) -> tuple[float, float]:
    """Mean and standard deviation of the number of segments that n elements fall into."""
    empty, two = (1 - 1 / s) ** n, (1 - 2 / s) ** n
    return s * (1 - empty), math.sqrt(max(0.0, s * (s - 1) * two + s * empty - (s * empty) ** 2))


@cache
def meeting(i: int, t: tuple[int, int]) -> tuple[int, int]:
    """(D, segments) of the sets that meet in range i: the smaller of two linked sets is of this range."""
    a = grid(t)[i + 1] - 1
    d = (a + largest_partner(a, t)) * (t[1] - t[0]) // (t[1] + t[0])
    s = d + 1
    while s < 8 * d + 16:
        mean, sd = _occupied(grid(t)[i], s)
        if mean - _SURE * sd > d:
            break
        s += max(1, s // 16)
    return d, s


def meetings(n: int, t: tuple[int, int]) -> list[int]:
    """Ranges in which a set of n elements meets sets that it can link to without being equal."""
    i = bisect_right(grid(t), n) - 1
    return [j for j in (i - 1, i) if j >= 0 and meeting(j, t)[0] and (j == i or least_overlap(n, t) < grid(t)[i])]


def list_keys(s: np.ndarray, t: tuple[int, int]) -> list[np.ndarray]:
    """Keys of the lists that a sorted set enters."""
    out, mixed = [], mix(s + np.uint64(1))
    for i in meetings(len(s), t):
        d, parts = meeting(i, t)
        tag = np.uint64(xxhash.xxh3_64_intdigest(f"{t} {i}"))
        # the set is sorted, so the elements of a segment stand together
        segment = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        key = mix(np.add.reduceat(mixed, first) + tag)
        size = np.diff(np.r_[first, len(s)])
        out.append(key[np.lexsort((key, -size))[: d + 1]])
        if len(first) <= d:
            out.append(mix(s[: len(s) - least_overlap(len(s), t) + 1] ^ tag))
    return out


def list_entries(n: int, t: tuple[int, int]) -> float:
    """Lists that a set of n elements enters, about."""
    total = 0.0
    for i in meetings(n, t):
        d, s = meeting(i, t)
        mean, sd = _occupied(n, s)
        few = 0.5 * math.erfc((mean - d - 0.5) / (sd * math.sqrt(2))) if sd else float(mean <= d)
        total += d + 1 + few * (n - least_overlap(n, t) + 1)
    return total


def _boundary(sizes: dict[int, int], t: tuple[int, int]) -> int:
    """The light sizes end where subsets get dearer than list entries; of equal ones the largest is taken."""

    def cost(x: int) -> float:
        light = sum(c * sum(math.comb(n, s) for _, s in subset_sizes(n, t, x)) for n, c in sizes.items() if n <= x)
        return light + sum(c * list_entries(n, t) for n, c in sizes.items() if n > x or largest_partner(n, t) > x)

    return min(range(MOST_LIGHT, -1, -1), key=cost)


def _class_of(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def _short(cls: bytes) -> int:
    """Half of a class's digest. Lists hold these; classes that share one would only be compared once more."""
    return int.from_bytes(cls[:8], "big", signed=True)


def _parity(h: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of elements fall on i. The bits in which two sets' maps differ are at most as
    many as the elements in which the sets do."""
    width = NARROW if len(h) <= 2 * NARROW else WIDE
    odd = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _survey(k: int):
    """(doc_id, n, cls, bits) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, bits = [], [], []
            for x in batch.column("text"):
                s = np.unique(shingle_hashes(x.as_py(), k))
                n.append(len(s))
                cls.append(_class_of(s) if len(s) else None)
                bits.append(_parity(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n", "cls", "bits"])

    return run


def _keys(k: int, t: tuple[int, int], boundary: int):
    """Subset keys of light classes, list entries of heavy ones and of those light ones they can link to. A task enters a
    class once, so copies are taken together before they are dealt out (the memory for that is bounded; a class entered
    again costs rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered: set[bytes] = set()
        key: list[np.ndarray] = []
        cid: list[np.ndarray] = []

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(cid))], ["key", "cid"])
            key.clear()
            cid.clear()
            return out

        held = 0
        for batch in batches:
            for x in batch.column("text"):
                s = np.unique(shingle_hashes(x.as_py(), k))
                n, cls = len(s), _class_of(s)
                if not n or cls in entered:
                    continue
                if len(entered) >= _MOST_ENTERED:
                    entered.clear()
                entered.add(cls)
                own = []
                if n <= boundary:
                    own = [np.array([xxhash.xxh3_64_intdigest(s[list(pick)].tobytes(), seed=m) for pick in combinations(range(n), c)], np.uint64) for m, c in subset_sizes(n, t, boundary)]
                if n > boundary or largest_partner(n, t) > boundary:
                    own += list_keys(s, t)
                key += own
                cid += [np.full(len(a), _short(cls), np.int64) for a in own]
                held += sum(map(len, own))
                if held >= _FLUSH:
                    yield full()
                    held = 0
        if key:
            yield full()

    return run


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(j) * step) % np.uint64(1 << bits) for j in range(_PROBES)]).astype(np.int64)


def _mark(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[_slots(batch.column("rid").to_numpy(), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["bits"])

    return run


def _filter(wanted: DataFrame) -> np.ndarray:
    """A filter of bounded size that lets the wanted ids pass, and others the more often the more ids it holds."""
    ids = wanted.select(F.coalesce("rid", F.lit(0)).alias("rid"))
    bits = min(_MOST_BITS, max(_LEAST_BITS, (_ID_BITS * ids.count()).bit_length()))
    seen = np.zeros(1 << bits >> 3, np.uint8)
    for r in ids.coalesce(16).mapInArrow(_mark(bits), "bits binary").toLocalIterator():
        seen |= np.frombuffer(r[0], np.uint8)
    return seen


def _sets(k: int, seen: np.ndarray):
    """(cls, elements, bits) of the documents whose id may be wanted: a filter of bounded size in front of the exact join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = (len(seen) << 3).bit_length() - 1
        sent: set[bytes] = set()
        for batch in batches:
            ids = batch.column("doc_id")
            at = _slots(pc.fill_null(ids, 0).to_numpy(), bits)
            keep = ((seen[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0) | ids.is_null().to_numpy(zero_copy_only=False)
            cls, elements, maps = [], [], []
            for x in batch.column("text").filter(pa.array(keep)):
                s = np.unique(shingle_hashes(x.as_py(), k))
                if (own := _class_of(s)) in sent:
                    continue
                if len(sent) >= _MOST_ENTERED:
                    sent.clear()
                sent.add(own)
                cls.append(own)
                elements.append(s.tobytes())
                maps.append(_parity(s))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(elements, pa.binary()), pa.array(maps, pa.binary())], ["cls", "elements", "bits"])

    return run


def _fold(bits: bytes) -> np.ndarray:
    """A map in its narrow form: parities add up when positions are taken together."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, NARROW // 64), axis=0)


def forest(names: list, size: np.ndarray, bits: list[bytes], sides: np.ndarray, t: tuple[int, int], sets: list[np.ndarray] | None = None) -> list[tuple]:
    """Pairs that span the same components as all linked pairs across the sides (or within the one side).

    Without sets a pair counts as linked if the maps allow it; with sets, if it is.
    """
    order = np.argsort(size, kind="stable")
    names, size, bits, sides = [names[i] for i in order], size[order], [bits[i] for i in order], sides[order]
    sets = [sets[i] for i in order] if sets is not None else None
    n, across = len(names), len(set(sides.tolist())) > 1
    maps = np.stack([_fold(b) for b in bits])
    big = np.array([len(b) * 8 == WIDE for b in bits])
    wide = {i: np.frombuffer(bits[i], np.uint64) for i in np.flatnonzero(big)}
    part = np.arange(n)
    found = []
    for i in range(1, n):
        lo = int(np.searchsorted(size[:i], least_overlap(int(size[i]), t)))
        if lo == i:
            continue
        total = size[lo:i] + size[i]
        need = -(-t[0] * total // (t[0] + t[1]))
        ok = part[lo:i] != part[i]
        if across:
            ok &= sides[lo:i] != sides[i]
        if ok.any():
            ok &= (total - np.bitwise_count(maps[lo:i] ^ maps[i]).sum(1, dtype=np.int64)) // 2 >= need
        while ok.any():
            j = int(ok.argmax())
            ok[j] = False
            if big[i] and big[lo + j] and (total[j] - int(np.bitwise_count(wide[i] ^ wide[lo + j]).sum(dtype=np.int64))) // 2 < need[j]:
                continue
            if sets is not None:
                a, b = sets[lo + j], sets[i]
                if (b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum() < need[j]:
                    continue
            found.append((names[i], names[lo + j]))
            part[part == part[lo + j]] = part[i]
            ok &= part[lo:i] != part[i]
    return found


def _forests(t: tuple[int, int], columns: tuple[str, ...], exact: bool):
    """Groups arrive one after the other, sorted by ``columns``; a group holds two blocks at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, found = None, {}, []

        def close() -> None:
            if len(held) > 1:
                sides, size, bits, sets = zip(*held.values(), strict=True)
                found.extend(forest(list(held), np.array(size, np.int64), list(bits), np.array(sides), t, list(sets) if exact else None))

        def links() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            sets = batch.column("elements") if exact else [None] * batch.num_rows
            for key, cls, own, n, bits, s in zip(keys, *(batch.column(c).to_pylist() for c in ("cls", "own", "n", "bits")), sets, strict=True):
                if key != at:
                    close()
                    at, held = key, {}
                held[cls] = (own, n, bits, np.frombuffer(s.as_py(), np.uint64) if exact else None)
            if len(found) > 10_000:
                yield links()
                found = []
        close()
        yield links()

    return run


def _deal(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Rows of a key dealt by a hash into blocks, and each block sent to each pair of blocks that it is part of. The pairs of a key go to
    partitions in turn, so one large key fills them evenly."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("blocks", F.greatest(F.lit(1), blocks.cast("int"))).withColumn("own", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")
    turn = F.pmod(F.xxhash64(key), F.lit(parts)) + F.col("j").cast("long") * (F.col("j") + 1) / 2 + F.col("i")
    return rows.repartitionById(parts, F.pmod(turn.cast("long"), F.lit(parts)).cast("int")).sortWithinPartitions(key, "i", "j")


def jaccard_components(docs: DataFrame, k: int = 3, t: tuple[int, int] = (90, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs(doc_id, text)``; documents link at a similarity of t[0] / t[1]."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.keep(texts.mapInArrow(lean(_survey(k)), "doc_id long, n long, cls binary, bits binary"))
    classes = scratch.keep(rows.where("n > 0").groupBy("cls").agg(F.min(F.struct("n", "bits")).alias("first"), F.min("doc_id").alias("rid")).select("cls", "first.n", "first.bits", "rid"))
    sizes = {r["n"]: r["count"] for r in classes.where(F.col("n") <= MOST_LIGHT * t[1] // t[0] + 1).groupBy("n").count().collect()}
    boundary = _boundary(sizes, t)

    # dealt by key once; the entries of a key stay together for the count, the collection and the copies
    keys = texts.mapInArrow(lean(_keys(k, t, boundary)), "key long, cid long").repartition("key").groupBy("key", "cid").agg(F.lit(1).alias("one")).drop("one")
    shared = keys.withColumn("entries", F.count("*").over(Window.partitionBy("key"))).where("entries > 1")
    # near copies share many short lists with the same entries: each such list is looked at once
    short = shared.where(F.col("entries") <= _SHORT_LIST).groupBy("key").agg(F.sort_array(F.collect_list("cid")).alias("cids")).select("cids").distinct()
    short = short.select(F.xxhash64("cids").alias("key"), F.explode("cids").alias("cid"), F.size("cids").cast("long").alias("entries"))
    lists = scratch.keep(short.union(shared.where(F.col("entries") > _SHORT_LIST).select("key", "cid", "entries")))
    brief = classes.drop("rid").withColumn("cid", F.expr("cast(conv(substring(hex(cls), 1, 16), 16, -10) as long)"))
    near = _deal(lists.join(brief, "cid").drop("cid"), "key", F.ceil(F.col("entries") / LIST)).drop("entries")
    near = scratch.keep(near.mapInArrow(lean(_forests(t, ("key", "i", "j"), exact=False)), "a binary, b binary").distinct())

    groups = connected_components(near, scratch).withColumnRenamed("root", "comp").withColumnRenamed("node", "cls")
    wanted = scratch.keep(groups.join(classes.select("cls", "n", "rid"), "cls"))
    blocks = wanted.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / ELEMENTS)).alias("blocks_of"))
    sets = texts.mapInArrow(lean(_sets(k, _filter(wanted))), "cls binary, elements binary, bits binary")
    found = wanted.join(blocks, "comp").drop("rid").join(sets, "cls")
    links = scratch.keep(_deal(found, "comp", F.col("blocks_of")).drop("blocks_of").mapInArrow(lean(_forests(t, ("comp", "i", "j"), exact=True)), "a binary, b binary"))

    comps = connected_components(links, scratch)
    rooted = classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rid", F.coalesce("root", "cls").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rid").alias("component_id"))
    named = rooted.join(least, "root").select("cls", "component_id")
    linked = rows.where("n > 0").join(named, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))
