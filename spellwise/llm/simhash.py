"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint becomes the bit counts of its 32 two-bit segments.  The Manhattan distance of two such vectors
is at most the Hamming distance, so fingerprints that differ in 3 bits lie within 3 of each other in the embedding,
hence within 1 in one of its halves (16 segments each), and those that differ in 5 bits within 1 in one of three parts.
The grid range join deals each fingerprint to the cell of each part, and those with an even count also to the cells one
step away; what meets in a cell passes the Manhattan bound and is then verified by its bits.

Documents of like wording, of a 5-word Jaccard similarity of 0.8 or more, are found exactly.  In any one order of all shingles, two such
sets share one of the first fifth of each (prefix filter), so documents meet at the shingles of their prefixes.  Frequent shingles
stand last in the order.  What meets and can still reach the similarity by sizes and places is verified by the sets of shingles of both:
neighbours in chains through each shingle first, then, where many meet, members of each component with one of the largest, and
last all that meets across the components of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

#: Bits in which linked fingerprints may differ.
MAX_BITS = 3
#: Links of rows with two check words: how many of their 128 bits may differ besides.
SHINGLE_BITS = 28
#: Of the candidates of a large cell that are at most so many bits apart, links that connect as much as all of them stay.
TIERS = (4, 8, 12, 16, 20, 24, SHINGLE_BITS)
#: Jaccard similarity of linked documents, as a fraction.
SIMILAR = (4, 5)
#: A document's links are verified in up to so many tasks.
HUB_PARTS = 16
#: Classes of documents that a task remembers to have sent the shingles of.
REMEMBERED = 1 << 17
SHINGLE_WORDS = 5
#: Shingles that two or more of a share of the sets hold (an eighth, or about so many sets) stand last in the order of shingles, at most so many of them.
ORDER_SHARE, ORDER_SETS, ORDER_LAST = 1 / 8, 1 << 14, 1 << 20
#: Orders of all documents that chains through a shared shingle follow.
CHAINS = 3
#: Components are bridged at shingles that so many prefixes share; fewer have few pairs.
CROWD = 8
#: Bins of a sketch of a set of shingles, a power of two.
BINS = 128
#: Bits of a bitmap of nodes, a power of two: of a page, and at most.
PAGE_BITS, MOST_BITS = 15, 27
#: Fingerprints of a cell that a task holds at once; larger cells are dealt to several groups, each seeing all the rest.
CELL_HOMES = 2048
_LANES = np.uint64(0x5555555555555555)
_SMALL = 32


def shingle_hashes(text: bytes, size: int, seed: int) -> list[int]:
    """XXH64 of each run of `size` words of a text in lower case, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    joined = b" ".join(words)
    at = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
    return [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(at[:-size].tolist(), (at[size:] - 1).tolist(), strict=True)]


def _fingerprinter(size: int, seed: int):
    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.slices(batch):
                whole = data.tobytes()
                hashes, counts = [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = shingle_hashes(whole[a:b], size, seed)
                    counts.append(len(own))
                    hashes += own
                counts = np.array(counts)
                out = np.zeros(len(counts), np.uint64)
                full = np.flatnonzero(counts)
                if len(full):
                    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ones = np.add.reduceat(bits, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.int32)
                    out[full] = np.packbits(2 * ones > counts[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return fingerprint


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp of each row; a text without words has 0."""
    common.small_batches(docs.sparkSession)
    two = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return two.mapInArrow(_fingerprinter(words, seed), "doc_id long, fp long")


def _distinct(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once a row."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.append(True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])) if len(hashes) else np.zeros(0, bool)
    return hashes[first], rows[first]


def wording(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of the set of runs of SHINGLE_WORDS words in lower case of each row (0 without any), and the distinct runs with their rows."""
    n = len(offsets) - 1
    low = common.LOWER[data]
    starts, ends, counts = common.word_bounds(low, offsets, common.WHITE)
    words, rows = common.span_hashes(low, starts, ends), common.row_of(counts)
    last = np.maximum(len(words) - SHINGLE_WORDS + 1, 0)
    runs = np.zeros(last, np.uint64)
    for k in range(SHINGLE_WORDS if last else 0):
        runs = common.mix(runs * np.uint64(0x9E3779B97F4A7C15) + words[k : k + last])
    inside = rows[:last] == rows[SHINGLE_WORDS - 1 :] if last else np.zeros(0, bool)
    runs, run_rows = runs[inside], rows[:last][inside]
    few = np.flatnonzero((np.diff(counts) > 0) & (np.diff(counts) < SHINGLE_WORDS))  # the whole sequence is the one run
    if len(few):
        whole = np.zeros(n, np.uint64)
        np.add.at(whole, rows, common.mix(words + (np.arange(len(words)) - counts[rows]).astype(np.uint64)))
        runs, run_rows = np.concatenate([runs, whole[few]]), np.concatenate([run_rows, few])
    runs, run_rows = _distinct(runs, run_rows)
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, run_rows, common.mix(runs))
    return sums, runs, run_rows


def _wording(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of a row's runs, and the high halves of their hashes; copies met again in a task send none."""
    sent: set[int] = set()
    for batch in batches:
        for part, data, offsets in common.slices(batch):
            nodes, runs, rows = wording(data, offsets)
            again = np.zeros(part.num_rows, bool)
            for k, node in enumerate(nodes.tolist()):
                again[k] = node in sent
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.add(node)
            top = (runs >> np.uint64(32)).astype(np.uint32)  # half the bytes; runs ascend within a row
            keep = ~again[rows]
            keep[1:] &= (top[1:] != top[:-1]) | (rows[1:] != rows[:-1])
            cuts = np.searchsorted(rows[keep], np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(top[keep].view(np.int32)), mask=pa.array(again))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(nodes.view(np.int64)), lists], names=["doc_id", "node", "runs"])


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The embedding: bits of each two-bit segment, packed into 32 lanes."""
    return (fp & _LANES) + ((fp >> np.uint64(1)) & _LANES)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of two embeddings: what differs, less the segments in which two bits only change places."""
    up, down = a & ~b, b & ~a
    swapped = ((up & (down >> np.uint64(1))) | (down & (up >> np.uint64(1)))) & _LANES
    return np.bitwise_count(a ^ b).astype(np.int16) - 2 * np.bitwise_count(swapped).astype(np.int16)


def near(a: np.ndarray, b: np.ndarray, most: int = MAX_BITS, most_checked: int = SHINGLE_BITS) -> np.ndarray:
    """The Manhattan bound, then the exact test where it passes.  Rows of a and b are one fingerprint (n, 1), or one and its two check words (n, 3)."""
    passed = manhattan(a[:, 0], b[:, 0]) <= most
    at = np.flatnonzero(passed)
    far = np.bitwise_count(a[at, 0] ^ b[at, 0]) > most
    if a.shape[1] > 1:
        differ = np.bitwise_count(a[at, 1:] ^ b[at, 1:])
        far |= differ.sum(1) > most_checked
    passed[at[far]] = False
    return passed


def _parts(most: int) -> list[tuple[int, int]]:
    """The lanes of each part of the embedding: so many that two vectors within `most` lie within 1 in one of them."""
    count = (most + 2) // 2
    cuts = [32 * i // count for i in range(count + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _dealer(most: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each fingerprint's home cell in every part, and, if its count there is even, the cells one step away."""
        for batch in batches:
            counts = segment_counts(batch.column("fp").to_numpy().view(np.uint64))
            rest = batch.schema.names
            for number, (lo, hi) in enumerate(_parts(most)):
                lanes = [((counts >> np.uint64(2 * i)) & np.uint64(3)).astype(np.int64) for i in range(lo, hi)]
                cell = sum(lane << 2 * i for i, lane in enumerate(lanes)) | number << 40
                dealt = [(cell, 0, np.arange(len(cell)))]
                even = np.flatnonzero(sum(lanes) % 2 == 0)
                for i, lane in enumerate(lanes):
                    for step, fits in ((1, lane[even] < 2), (-1, lane[even] > 0)):
                        dealt.append((cell[even[fits]] + (step << 2 * i), 1, even[fits]))
                for cells, probe, who in dealt:
                    columns = [pa.array(cells), pa.array(np.full(len(who), probe, np.int8)), *(batch.column(c).take(pa.array(who)) for c in rest)]
                    yield pa.RecordBatch.from_arrays(columns, names=["cell", "probe", *rest])

    return deal


class _Cell:
    """A cell met in parts: homes first, then probes; gives links that keep what is connected connected, at each tier."""

    def __init__(self, most: int, width: int) -> None:
        self.most, self.tiers = most, TIERS if width > 1 else (0,)
        self.homes = np.zeros((0, width), np.uint64)
        self.nodes = np.zeros(0, np.int64)
        self.label = np.zeros((len(self.tiers), 0), np.int64)

    def _union(self, label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins homes a and b pairwise; marks the pairs that joined something."""
        useful = np.zeros(len(a), bool)
        for k in np.flatnonzero(label[a] != label[b]):
            x, y = label[a[k]], label[b[k]]
            if x != y:
                label[label == max(x, y)] = min(x, y)
                useful[k] = True
        return useful

    def feed(self, fps: np.ndarray, nodes: np.ndarray, are_homes: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo in range(0, len(fps), 256):
            part, own = fps[lo : lo + 256], nodes[lo : lo + 256]
            base = len(self.homes)
            if are_homes:
                self.homes, self.nodes = np.concatenate([self.homes, part]), np.append(self.nodes, own)
                fresh = np.broadcast_to(np.arange(base, len(self.homes)), (len(self.tiers), len(part)))
                self.label = np.concatenate([self.label, fresh], axis=1)
            if not len(self.homes):
                continue
            i, j = np.nonzero(manhattan(part[:, None, 0], self.homes[None, :, 0]) <= self.most)
            close = near(part[i], self.homes[j], self.most)
            if are_homes:
                close &= j < base + i  # each pair once
            i, j = i[close], j[close]
            if not len(i):
                continue
            apart = np.bitwise_count(part[i, 1:] ^ self.homes[j, 1:]).sum(1)
            order = np.argsort(apart, kind="stable")
            chosen = []
            for tier, limit in enumerate(self.tiers):
                label, some = self.label[tier], order[apart[order] <= limit]
                if are_homes:
                    chosen.append(some[self._union(label, base + i[some], j[some])])
                else:  # the nearest of each component; those that a probe meets are one
                    met = some[np.unique(i[some] * len(self.homes) + label[j[some]], return_index=True)[1]]
                    same = np.flatnonzero(np.diff(i[met]) == 0)
                    self._union(label, j[met[same]], j[met[same + 1]])
                    chosen.append(met)
            picked = np.unique(np.concatenate(chosen))
            yield own[i[picked]], self.nodes[j[picked]]


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=_EDGE)


def _linker(most: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell, part and probe.  Small cells are compared all at once, by distance in the order."""
        key, cell = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cells, parts, probe, nodes = (batch.column(c).to_numpy() for c in ("cell", "part", "probe", "node"))
            fps = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "c1", "c2") if c in batch.schema.names], 1)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(parts) != 0)) + 1
            heads, tails = np.append(0, cuts), np.append(cuts, n)
            whole = np.ones(len(heads), bool)
            whole[-1] = False
            whole[0] &= key != (cells[0], parts[0])
            whole &= tails - heads <= _SMALL
            for g in np.flatnonzero(~whole):
                a, b = heads[g], tails[g]
                if key != (this := (cells[a], parts[a])):
                    key, cell = this, _Cell(most, fps.shape[1])
                middle = a + int(np.searchsorted(probe[a:b], 1))
                for u, v in [*cell.feed(fps[a:middle], nodes[a:middle], True), *cell.feed(fps[middle:b], nodes[middle:b], False)]:
                    yield _edges(u, v)
            group = np.repeat(np.where(whole, np.arange(len(heads)), -1), tails - heads)
            for d in range(1, _SMALL):
                i = np.flatnonzero((group[:-d] == group[d:]) & (group[d:] >= 0) & (probe[:-d] == 0)) if d < n else []
                if not len(i):
                    break
                i = i[near(fps[i], fps[i + d], most)]
                if len(i):
                    yield _edges(nodes[i], nodes[i + d])

    return link


def links(fps: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """Edges u, v between rows within `most` bits, whose components are those of all such pairs.

    A row is a node of its own: fp, or node and fp, or also c1 and c2, of which at most SHINGLE_BITS bits may differ besides; the
    edges of at most TIERS differing bits then have the components of all pairs of that kind, too.
    Rows that repeat a node link to themselves only if they stand in one cell, which the components ignore; a table without
    rows has no edges; a null fp is not allowed.
    """
    spark = fps.sparkSession
    own_columns = [c for c in ("fp", "c1", "c2") if c in fps.columns]
    fps = fps.select(F.col("node" if "node" in fps.columns else "fp").alias("node"), *own_columns)
    cells = fps.mapInArrow(_dealer(most), "cell long, probe byte, node long" + "".join(f", {c} long" for c in own_columns))
    homes = cells.where("probe = 0").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL_HOMES)
    parts = common.written(homes.select("cell", F.ceil(F.col("n") / (CELL_HOMES // 2)).cast("int").alias("parts")))
    dealt = cells.join(parts, "cell", "left") if parts.limit(1).count() else cells.withColumn("parts", F.lit(None).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # in a split cell a home is held in its own part and passes by the parts after it; a probe passes by all parts
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    places = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("part"), F.col("probe").alias("probe"))))
    places = places.when(F.col("probe") == 1, F.transform(every, lambda p: F.struct(p.alias("part"), F.lit(1).cast("byte").alias("probe"))))
    places = places.otherwise(F.transform(F.filter(every, lambda p: p >= own), lambda p: F.struct(p.alias("part"), F.when(p == own, 0).otherwise(1).cast("byte").alias("probe"))))
    spread = dealt.select("cell", F.explode(places).alias("place"), "node", *own_columns).select("cell", "place.part", "place.probe", "node", *own_columns)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = spread.repartition(count, "cell", "part").sortWithinPartitions("cell", "part", "probe", "fp", "node")
    return met.mapInArrow(_linker(most), "u long, v long")


def _named(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component_id, the least document id of its component, for classes of node and least that edges link."""
    with common.narrow_batches(classes.sparkSession):
        found = components(edges)
    members = common.written(found.join(classes, "node").select("node", "component", "least"))
    leasts = members.groupBy("component").agg(F.min("least").alias("component_id"))
    named = common.written(members.join(leasts, "component").select("node", "component_id"))
    return classes.join(named, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach.

    Equal fingerprints are one node, so copies are never paired.  A null or empty text has fingerprint zero and is
    linked like any other; fewer words than a shingle are one shingle; each repeated row has its own result row; a
    null id does not name a component (it is null if no other id is there); an empty table gives no rows; other
    columns are not read.
    """
    common.small_batches(docs.sparkSession)
    marked = common.written(fingerprints(docs, words, seed, id_col, text_col))
    classes = common.written(marked.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least")).withColumn("fp", F.col("node")))
    names = _named(classes, links(classes.select("node", "fp"))).withColumnRenamed("node", "fp")
    return marked.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """A bit for each node, at its remainder by the number of bits, of which there are 16 a node or more, up to MOST_BITS."""
    size = 1 << min(MOST_BITS, max(PAGE_BITS, (16 * nodes.count()).bit_length()))
    at = F.pmod("node", F.lit(size))
    pages = nodes.groupBy(F.shiftright(at, PAGE_BITS).alias("page")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << PAGE_BITS) - 1))).alias("bits"))
    out = np.zeros((size >> PAGE_BITS, 1 << PAGE_BITS - 3), np.uint8)
    for row in pages.collect():
        out[row.page] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def _picker(bitmap: np.ndarray):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows whose node has its bit set."""
        for batch in batches:
            at = batch.column("node").to_numpy() % (8 * len(bitmap))
            yield batch.filter(pa.array(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))

    return pick


def _similar(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs u, v of nodes whose sets of runs have the Jaccard similarity SIMILAR or more; rows have node and runs (null for copies).

    v may be in many pairs: its set meets them in up to HUB_PARTS tasks.  Sets that no pair asks for are left out where they are read.
    """
    asked = pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).distinct()
    own = rows.where("runs IS NOT NULL").select("node", "runs")
    sets = common.written(own.mapInArrow(_picker(_bitmap(asked)), own.schema).groupBy("node").agg(F.first("runs").alias("runs")), row_bytes=1 << 16)
    part = F.pmod(F.xxhash64("u"), F.lit(HUB_PARTS)).cast("int")
    one = pairs.withColumn("part", part).join(sets.select(F.col("node").alias("u"), F.col("runs").alias("a")), "u")
    hubs = pairs.select("v", part.alias("part")).distinct().join(sets.select(F.col("node").alias("v"), F.col("runs").alias("b")), "v")
    both = F.size(F.array_intersect("a", "b"))
    return one.join(hubs, ["v", "part"]).where(SIMILAR[1] * both >= SIMILAR[0] * (F.size("a") + F.size("b") - both)).select("u", "v")


def _prefixes(last: np.ndarray, place: np.ndarray):
    """Each set's first runs in the order of hashes, but for the runs of `last` (ascending), which stand behind by their `place`.

    Of two sets that reach SIMILAR neither has all their common runs among those left out here.
    """

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("runs")
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            runs = lists.flatten().to_numpy().view(np.uint32).astype(np.uint64)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            if len(last) and len(runs):
                at = np.minimum(np.searchsorted(last, runs), len(last) - 1)
                behind = np.where(last[at] == runs, place[at], 0).astype(np.uint64)
            else:
                behind = np.zeros(len(runs), np.uint64)
            order = np.lexsort((behind << np.uint64(32) | runs, rows))
            position = np.arange(len(runs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = sizes - -(-SIMILAR[0] * sizes // SIMILAR[1]) + 1
            first = position < kept[rows]
            who = rows[first]
            columns = [pa.array(runs[order][first].astype(np.uint32).view(np.int32)), batch.column("node").take(pa.array(who)), pa.array(sizes[who].astype(np.int32)), pa.array(position[first].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["run", "node", "n", "at"])

    return prefix


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many runs of each set fall into each of BINS bins, one byte each; 255 stands for that many or more."""
    for batch in batches:
        lists = batch.column("runs")
        runs = lists.flatten().to_numpy().view(np.uint32).astype(np.int64)
        rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        counts = np.bincount(rows * BINS + runs % BINS, minlength=len(lists) * BINS)
        flat = np.minimum(counts, 255).astype(np.uint8).tobytes()
        sketches = pa.array([flat[k : k + BINS] for k in range(0, len(flat), BINS)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("node"), sketches], names=["node", "sketch"])


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops pairs whose bins alone leave too few common runs for SIMILAR; bins of 255 decide nothing."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("a", "b"))
        most, sizes = np.minimum(a, b).sum(1, dtype=np.int64), a.sum(1, dtype=np.int64) + b.sum(1, dtype=np.int64)
        stays = ((SIMILAR[0] + SIMILAR[1]) * most >= SIMILAR[0] * sizes) | (np.maximum(a, b) == 255).any(1)
        yield batch.select(["u", "v"]).filter(pa.array(stays))


def _screened(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs u, v that the sketches (node, sketch) do not rule out: sets are sent for those only."""
    one = pairs.join(sketches.select(F.col("node").alias("u"), F.col("sketch").alias("a")), "u")
    return one.join(sketches.select(F.col("node").alias("v"), F.col("sketch").alias("b")), "v").select("u", "v", "a", "b").mapInArrow(_screen, "u long, v long")


def _met(sets: DataFrame) -> DataFrame:
    """run, node, n and at of each prefix's runs that other sets hold in theirs, with the node before it in the chain of the run (before_, null for the first)
    and the number of prefixes that hold the run (crowd).

    sets have node and runs; a node may repeat.  The chains of a run follow one of CHAINS orders of all nodes.
    """
    share = min(1.0, max(ORDER_SHARE, ORDER_SETS / max(1, sets.count())))
    some = sets.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30)))
    counts = some.select(F.explode("runs").alias("run")).groupBy("run").agg(F.count("*").alias("n")).where("n > 1")
    frequent = counts.orderBy(F.desc("n"), "run").limit(ORDER_LAST).toArrow()  # the order follows from them, not what is found
    found, n = (frequent.column(c).to_numpy() for c in ("run", "n"))
    ahead = np.lexsort((found, -n))
    found = found.view(np.uint32).astype(np.uint64)[ahead]
    place = np.arange(len(found), 0, -1).astype(np.uint64)  # the most frequent one is the very last
    order = np.argsort(found)
    prefixes = sets.mapInArrow(_prefixes(found[order], place[order]), "run int, node long, n int, at int")
    chain = Window.partitionBy("run").orderBy(F.xxhash64("node", F.pmod("run", F.lit(CHAINS))), "node")
    crowd = F.count("*").over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("int")
    met = prefixes.withColumns({f"before_{c}": F.lag(c).over(chain) for c in ("node", "n", "at")} | {"next": F.lead("node").over(chain), "crowd": crowd})
    return common.written(met.where("coalesce(before_node <> node, next IS NOT NULL)").drop("next"))


def _possible(n, at, m, place) -> Column:
    """Whether sets of n and m runs can reach SIMILAR if their first common run has those places: an intersection of s / (1 + s) of both sizes is asked."""
    sizes = SIMILAR[1] * F.least(n, m) >= SIMILAR[0] * F.greatest(n, m)
    return sizes & ((SIMILAR[0] + SIMILAR[1]) * F.least(n - at, m - place) >= SIMILAR[0] * (n + m))


def _chained(met: DataFrame) -> DataFrame:
    """Pairs u, v of neighbours in chains."""
    before = F.struct(*[F.col(f"before_{c}").alias(c) for c in ("n", "at", "node")])
    return _pairs(met.where("before_node IS NOT NULL").select(F.struct("n", "at", "node").alias("one"), before.alias("before")), "one", "before")


def _apart(met: DataFrame, parts: DataFrame, each: bool = False) -> DataFrame:
    """run, node, n, at and part of the runs whose nodes stand in different components of parts (node, component).

    Of the runs of one and the same nodes only the first in the order of runs is here, unless `each` asks for all: it is the first in each of their sets, and they meet there.
    """
    named = met.join(parts, "node", "left").select("run", "node", "n", "at", F.coalesce("component", "node").alias("part"))
    bits = (1 << 40) - 1  # sums of both ends of the nodes' hashes stand for the nodes
    same = [F.count("*").alias("rows"), F.sum(F.shiftrightunsigned("node", 24)).alias("high"), F.sum(F.col("node").bitwiseAND(F.lit(bits))).alias("low")]
    runs = named.groupBy("run").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.sum("at").alias("places"), *same).where("least < most")
    first = runs if each else runs.groupBy("rows", "high", "low").agg(F.min_by("run", "places").alias("run"))
    return common.written(named.join(first.select("run"), "run"))


def _pairs(rows: DataFrame, one: str, other: str) -> DataFrame:
    """Distinct pairs u, v of two columns of n, at and node that can reach SIMILAR."""
    a, b = F.col(one), F.col(other)
    sizes = [F.struct(x["n"].alias("n"), x["node"].alias("node")) for x in (a, b)]
    return rows.where(_possible(a["n"], a["at"], b["n"], b["at"])).select(F.least(*sizes)["node"].alias("u"), F.greatest(*sizes)["node"].alias("v")).distinct()


def _bridges(rest: DataFrame) -> DataFrame:
    """Pairs u, v of a member of each component that meets at a run with one of the run's largest component, and with one of the next in a chain.

    There are at most two pairs a component and run.  Members are those that stand at the most runs: what is edited least is like the most others.
    """
    weighed = rest.withColumn("weight", F.count("*").over(Window.partitionBy("node")))
    members = weighed.groupBy("run", "part").agg(F.count("*").alias("size"), F.max(F.struct("weight", "n", "at", "node")).alias("one"))
    run = Window.partitionBy("run")
    chosen = members.select("one", F.first("one").over(run.orderBy(F.desc("size"), "part")).alias("hub"), F.lag("one").over(run.orderBy(F.xxhash64("part", "run"))).alias("before"))
    met = chosen.where("hub.node <> one.node").select("one", F.col("hub").alias("other")).unionAll(chosen.where("before IS NOT NULL").select("one", F.col("before").alias("other")))
    return _pairs(met, "one", "other")


def _across(rest: DataFrame) -> DataFrame:
    """Pairs u, v that share a run of both prefixes and can reach SIMILAR, but stand in different components."""
    a = rest.select("run", F.col("node").alias("u"), F.col("n").alias("nu"), F.col("at").alias("au"), F.col("part").alias("pu"))
    b = rest.select("run", F.col("node").alias("v"), F.col("n").alias("nv"), F.col("at").alias("av"), F.col("part").alias("pv"))
    once = (F.col("nu") < F.col("nv")) | (F.col("nu") == F.col("nv")) & (F.col("u") < F.col("v"))
    possible = _possible(F.col("nu"), F.col("au"), F.col("nv"), F.col("av"))
    return a.join(b, "run").where(once & possible & (F.col("pu") != F.col("pv"))).select("u", "v").distinct()


def _linked(sets: DataFrame) -> DataFrame:
    """Edges u, v whose components are those of all pairs of sets (node and runs; a node may repeat) with a Jaccard similarity of SIMILAR or more.

    Neighbours in the chains of shared runs are verified first, then bridges between their components where many sets meet.  They join nearly all of a family of
    like texts, whose other pairs would change nothing; each candidate across the components so far is then verified, too, so no link between two of them is lost.
    """
    spark = sets.sparkSession
    met = _met(sets)
    sketches = common.written(sets.mapInArrow(_sketch, "node long, sketch binary").groupBy("node").agg(F.first("sketch").alias("sketch")))

    def verified(pairs: DataFrame) -> DataFrame:
        with common.passing(spark):
            return common.written(_similar(common.written(_screened(pairs, sketches)), sets), stays=True)

    def joined(edges: DataFrame) -> DataFrame:
        with common.passing(spark), common.narrow_batches(spark):
            return common.written(components(edges), stays=True)

    def named(parts: DataFrame) -> DataFrame:
        return parts.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))

    parts = joined(verified(_chained(met)))
    bridges = verified(_bridges(_apart(met.where(F.col("crowd") >= CROWD), parts, each=True)))
    parts = joined(named(parts).unionAll(bridges))
    return named(parts).unionAll(verified(_across(_apart(met, parts))))


def like_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node and component_id, the smallest doc_id that links between documents of like wording reach.

    Two documents link if and only if the sets of their 5-word shingles, told by 32-bit hashes, have a Jaccard similarity of 0.8 or more: each such
    pair is verified, or stands in a component of verified ones already.  A component holds chains of links.  Documents of equal sets of shingles are one node, so copies are never
    paired.  Texts without words, null ones too, are copies of each other; texts under SHINGLE_WORDS words are one shingle; each
    repeated row has its own result row, those of one id and text in one component; a null id does not name a component (it is null if
    no other id is there); an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    two = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    marked = common.written(two.mapInArrow(_wording, "doc_id long, node long, runs array<int>"), row_bytes=1 << 16)
    classes = common.written(marked.groupBy("node").agg(F.min("doc_id").alias("least")))
    similar = common.written(_linked(marked.where("runs IS NOT NULL").select("node", "runs")))
    return marked.select("doc_id", "node").join(_named(classes, similar), "node").select("doc_id", "node", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents of like wording that links join to one with a smaller id; all columns stay.

    What goes has a Jaccard similarity of 0.8 or more to another document of its component, and chains of such links lead to the one that stays.
    Rows that repeat an id are one document and stay or go together; rows with a null id stay.
    """
    with common.passing(docs.sparkSession):
        found = like_documents(docs, id_col, text_col)
        gone = common.written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), stays=True)
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
