"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures (operator 3).

Each text's set of word shingles gives ``chunks * 5`` minima, each cut to 16 bits: the
signature.  Its lanes are split into chunks; signatures that differ in at most
``2 * chunks - 1`` lanes differ in at most one lane of some chunk, by pigeonhole.
So every chunk is indexed once for each place of the allowed error, with that lane left
out, and the index returns *all* pairs under the signature distance.  The number of
chunks is the least for which a pair just at the similarity has a distance beyond the
threshold with a probability of at most ``miss`` (binomial tail).

Pairs are never expanded within a bucket:

1. Rows are numbered.  Those with equal shingle sets are one class, named by its least row.
2. In every bucket each class meets the bucket's least class, its hub.  Of the distinct
   pairs under the signature distance, each class's nearest is confirmed on the full sets;
   the links give components.
3. A pair in a bucket that is not settled then lies in different components and shares
   the hub.  Hubs of one component and their classes are a family, dealt in blocks of a bounded number of
   shingles and classes (a family's size reaches its classes by a salted join, as one family may hold many); classes outside the family's largest component meet all others block by block, under
   the same distance and on the full sets.  Only links leave a block, at most one per class and
   component.  With them the components are complete.

Defined results: a null or blank text has an empty set and is linked with nothing; a
null doc_id is linked with nothing and names no component; rows of one doc_id count as
one document, linked with what any of its texts is linked with, so components that share a
doc_id are joined after step 3, and then named by their least doc_id; an empty table gives no rows; extra columns, also those named like the
result's or the steps', are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .components import connected_components, forest_roots
from .scratch import Scratch

LANES = 5
#: Shingles and classes in a block of step 3, and columns of an incidence matrix at once.
BLOCK_SHINGLES, BLOCK_CLASSES = 200_000, 512
_COLUMNS = 4096
#: Parts that the rows of one family or component are dealt in where they meet its one row.
PARTS = 32


def chunks_for(similarity: float, miss: float = 1e-5) -> int:
    """The least number of chunks whose distance threshold misses a pair at the similarity with probability <= miss."""
    p = 1 - similarity
    for m in range(4, 200):
        n, most = LANES * m, 2 * m - 1
        if sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(most + 1, n + 1)) <= miss:
            return m
    raise ValueError("the similarity is too low for this index")


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of width words, repeats and all, and where each document's begin; fewer words are one window."""
    starts, ends, first = flat.words(data, offsets)
    hashes = flat.hash_spans(data, starts, ends, lower=True)[0]
    n_words = np.diff(first)
    n_windows = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    factors = flat.randoms(width, 5) | np.uint64(1)
    room = np.concatenate([hashes, np.zeros(width, np.uint64)])
    last = np.repeat(first[1:], n_windows)
    at = flat.gather(np.arange(len(hashes), dtype=np.int64), first[:-1], n_windows)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out += np.where(at + k < last, flat.fmix(room[at + k] + np.uint64(k + 1)) * factors[k], np.uint64(0))
        out = flat.fmix(out)
    return out, np.concatenate([np.zeros(1, np.int64), np.cumsum(n_windows)])


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes, sorted, end to end, and the new bounds."""
    parts = [np.unique(hashes[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate(parts) if parts else hashes, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def minima(hashes: np.ndarray, bounds: np.ndarray, lanes: int) -> np.ndarray:
    """16 bits of the minimum under each of lanes hash functions; rows of documents without hashes are 0."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, lanes), np.uint16)
    if not len(full):
        return out
    factors, shifts = flat.randoms(lanes, 7) | np.uint64(1), flat.randoms(lanes, 8)
    block = 1 << 15  # documents end to end in runs that stay in cache
    at = 0
    with np.errstate(over="ignore"):
        while at < len(full):
            base = bounds[full[at]]
            to = max(at + 1, int(np.searchsorted(bounds[full], base + block, "right")) - 1)
            own, begins = hashes[base : bounds[full[to - 1] + 1]], bounds[full[at:to]] - base
            least = np.empty((to - at, lanes), np.uint64)
            for k in range(lanes):
                least[:, k] = np.minimum.reduceat((own ^ shifts[k]) * factors[k], begins)
            out[full[at:to]] = (flat.fmix(least) & np.uint64(0xFFFF)).astype(np.uint16)
            at = to
    return out


def sketch(docs: DataFrame, width: int, lanes: int) -> DataFrame:
    """row, n (set size), lo and hi (128 bits that name the set), sig (little-endian 16-bit lanes) of docs(row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in flat.pieces(batch):
                if not piece.num_rows:
                    continue
                hashes, bounds = distinct(*shingle_hashes(*flat.buffers(piece.column(1)), width))
                sizes = np.diff(bounds)
                sums = np.zeros((2, len(hashes) + 1), np.uint64)
                with np.errstate(over="ignore"):
                    np.cumsum(flat.fmix(hashes ^ np.uint64(0xA5A5A5A5)), out=sums[0, 1:])
                    np.cumsum(flat.fmix(hashes ^ np.uint64(0x5C5C5C5C5C)), out=sums[1, 1:])
                    lo, hi = (flat.fmix(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)
                sig = minima(hashes, bounds, lanes)
                sigs = flat.binary_array(sig, np.full(len(sig), 2 * lanes))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes), pa.array(lo), pa.array(hi), sigs], ["row", "n", "lo", "hi", "sig"])

    return docs.select("row", "text").mapInArrow(run, "row long, n long, lo long, hi long, sig binary")


def _lanes(column: pa.Array, lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, lanes)


def bucket_keys(classes: DataFrame, lanes: int) -> DataFrame:
    """(key, rep): a key for each chunk and each lane of it that may differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _lanes(batch.column(1), lanes).astype(np.uint64)
            keys = np.empty(sig.shape, np.uint64)
            factors = flat.randoms(lanes, 9) | np.uint64(1)
            with np.errstate(over="ignore"):
                parts = flat.fmix(sig * factors + factors)
                for c in range(0, lanes, LANES):
                    whole = parts[:, c : c + LANES].sum(axis=1, dtype=np.uint64)
                    for k in range(c, c + LANES):
                        keys[:, k] = flat.fmix(whole - parts[:, k] + factors[k])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * lanes), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["rep", "keys"])

    return classes.select("rep", "sig").mapInArrow(run, "rep long, keys array<long>").select(F.explode("keys").alias("key"), "rep")


def _near(pairs: DataFrame, lanes: int, most: int) -> DataFrame:
    """Pairs (a, b, far) whose signatures sa and sb differ in far lanes, at most most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = (_lanes(batch.column(2), lanes) != _lanes(batch.column(3), lanes)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far)], ["a", "b", "far"]).filter(pa.array(far <= most))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, far long")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(rep, shingles): the sorted distinct shingle hashes of docs(rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in flat.pieces(batch):
                if piece.num_rows:
                    hashes, bounds = distinct(*shingle_hashes(*flat.buffers(piece.column(1)), width))
                    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([piece.column(0), lists], ["rep", "shingles"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, shingles array<long>")


def _among(docs: DataFrame, ids: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """The rows of docs(rep, text) whose id is in ids(rep), which must be distinct.

    A bitmap of hashed ids drops most other rows before any text is shuffled.  Its size is fixed (8 MB), whatever the
    number of ids; what it lets through by chance the join drops.
    """
    spot = F.pmod(F.xxhash64("rep"), F.lit(bits))
    words = ids.select(F.bitmap_bucket_number(spot).alias("b"), F.bitmap_bit_position(spot).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    lead = F.broadcast(words.withColumnRenamed("b", "_b"))  # at most bits / 32768 rows of 4 KB
    byte = F.conv(F.hex(F.substring(F.col("m"), F.shiftright(F.col("_p"), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    seen = docs.withColumn("_s", spot).withColumns({"_k": F.bitmap_bucket_number("_s"), "_p": F.bitmap_bit_position("_s")}).join(lead, F.col("_k") == F.col("_b"))
    seen = seen.where(byte.bitwiseAND(F.pow(F.lit(2), F.col("_p") % 8).cast("int")) != 0)
    return seen.select("rep", "text").join(ids.hint("merge"), "rep")  # a semi join would be pushed below the bitmap


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets of a with those of b, by products of incidence matrices in slices."""
    out = np.zeros((len(a), len(b)), np.float32)
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(all_a, all_b)
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    spot_a, spot_b = np.searchsorted(common, all_a), np.searchsorted(common, all_b)
    hit_a = spot_a < len(common)
    hit_a[hit_a] = common[spot_a[hit_a]] == all_a[hit_a]
    hit_b = spot_b < len(common)
    hit_b[hit_b] = common[spot_b[hit_b]] == all_b[hit_b]
    spot_a, row_a, spot_b, row_b = spot_a[hit_a], row_a[hit_a], spot_b[hit_b], row_b[hit_b]
    for c in range(0, len(common), _COLUMNS):
        ma, mb = np.zeros((len(a), _COLUMNS), np.float32), np.zeros((len(b), _COLUMNS), np.float32)
        in_a, in_b = (spot_a >= c) & (spot_a < c + _COLUMNS), (spot_b >= c) & (spot_b < c + _COLUMNS)
        ma[row_a[in_a], spot_a[in_a] - c] = 1
        mb[row_b[in_b], spot_b[in_b] - c] = 1
        out += ma @ mb.T
    return out


def _block_links(percent: int, lanes: int, most: int):
    """Links between the components of a block's probe classes (outside the family's largest one) and those of its other side."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        probe = block.column("probe").to_numpy()
        comps = block.column("comp").to_numpy()
        sig = _lanes(block.column("sig"), lanes)
        lists = block.column("shingles").chunk(0) if block.num_rows else None
        flat_sets, at = lists.flatten().to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        p, q = np.flatnonzero(probe == 1), np.flatnonzero(probe == 0)
        links: list[tuple[int, int]] = []
        if len(p) and len(q):
            far = np.zeros((len(p), len(q)), np.int16)
            for k in range(lanes):
                far += sig[p, k][:, None] != sig[q, k][None]
            todo = (far <= most) & (comps[p][:, None] != comps[q][None])
            rows, cols = np.flatnonzero(todo.any(axis=1)), np.flatnonzero(todo.any(axis=0))
            if len(rows):
                sets = [[flat_sets[at[i] : at[i + 1]] for i in side] for side in (p[rows], q[cols])]
                both = _overlaps(*sets)
                na, nb = (np.array([len(s) for s in side], np.float64) for side in sets)
                linked = todo[np.ix_(rows, cols)] & (100 * both.astype(np.float64) >= percent * (na[:, None] + nb[None] - both))
                root: dict[int, int] = {}

                def find(x):
                    while root.get(x, x) != x:
                        x = root[x]
                    return x

                for i, j in np.argwhere(linked).tolist():
                    a, b = find(int(comps[p[rows[i]]])), find(int(comps[q[cols[j]]]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        links.append((a, b))
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    return run


def _by_run(keys: tuple[str, ...], function):
    """Calls function with the rows of each run of equal keys, which sorted batches hold one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys])
            stops = [0, *(np.flatnonzero((now[:, 1:] != now[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for k, (start, stop) in enumerate(zip(stops, stops[1:], strict=False)):
                part = batch.slice(start, stop - start)
                if held and (k or any(held[0].column(x)[0] != part.column(x)[0] for x in keys)):
                    yield from function(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(part)
        if held:
            yield from function(pa.Table.from_batches(held)).to_batches()

    return run


def _met(rows: DataFrame, own: str, few: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined with few(key, ...), a row a key; many rows may share a key, so each key's are dealt in PARTS by their own column."""
    few = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(own, F.lit(3)), F.lit(PARTS)).cast("int"))
    return rows.join(few.hint("merge"), [key, "_part"], how).drop("_part")


def without_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows(row, ...) without those in gone(row); numbers are not negative.

    gone is broadcast as bitmaps (a bit a row, 4 KB for each 32,768 numbers), so no row of rows is shuffled, however many go.
    """
    place, bit = F.shiftright("row", 15), F.col("row").bitwiseAND(F.lit(32767))
    maps = gone.groupBy(place.alias("_place")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(_byte, cast(row & 7 as int)) & 1") == 1
    got = rows.withColumn("_place", place).join(F.broadcast(maps), "_place", "left")
    return got.withColumn("_byte", byte).where(F.col("_byte").isNull() | ~hit).select(*rows.columns)


def linked_rows(rows: DataFrame, width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """row, n_shingles, component (its least row) of rows(row, text); rows are numbered without repeats and read twice alike.

    The result reads from scratch, its own if none is given.
    """
    scratch = scratch or Scratch(rows.sparkSession, "neardup")
    chunks = chunks_for(percent / 100)
    lanes, most = LANES * chunks, 2 * chunks - 1
    sketches = scratch.table(sketch(rows, width, lanes), "sketches")
    classes = scratch.table(sketches.where("n > 0").groupBy("lo", "hi").agg(F.min("row").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")

    keys = bucket_keys(classes, lanes)
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("far")).where("hub < far").select("key", "hub")
    stars = scratch.table(keys.join(hubs.hint("merge"), "key").where("rep <> hub").select("rep", "hub").distinct(), "stars")

    sig_of = classes.select("rep", "n", "sig")
    a, b = (sig_of.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
    pairs = stars.select(F.col("rep").alias("a"), F.col("hub").alias("b")).join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    pairs = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    # each class's nearest hub, the least of equals
    nearest = _near(pairs, lanes, most).groupBy("a").agg(F.min(F.struct("far", "b")).alias("m"))
    nearest = scratch.table(nearest.select("a", F.col("m.b").alias("b")), "nearest")

    wanted = stars.select("rep").unionByName(stars.select(F.col("hub").alias("rep"))).distinct()
    texts = _among(rows.select(F.col("row").alias("rep"), "text"), wanted)
    sets = scratch.table(shingle_sets(texts, width), "sets")

    left, right = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    confirmed = nearest.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
    # a hub is smaller than its classes, so these links are a forest
    found = forest_roots(confirmed.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), scratch)

    # step 3: hubs whose classes are not yet all of one component; hubs of one component are one family
    members = stars.unionByName(stars.select(F.col("hub").alias("rep"), "hub").distinct())
    for column, to in (("hub", "family"), ("rep", "comp")):
        known = found.select(F.col("node").alias(column), F.col("component").alias("_c"))
        members = members.join(known.hint("merge"), column, "left").withColumn(to, F.coalesce("_c", column)).drop("_c")
    members = scratch.table(members.select("family", "rep", "comp").distinct().join(sig_of.hint("merge"), "rep"), "members")
    sizes = members.groupBy("family", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    blocks_for = lambda n, k: F.greatest(F.ceil(n / F.lit(BLOCK_SHINGLES)), F.ceil(k / F.lit(BLOCK_CLASSES))).cast("int")
    top = F.max(F.struct("k", "comp", "n"))
    main = sizes.groupBy("family").agg(top.alias("top"), F.sum("n").alias("all"), F.sum("k").alias("ks"), F.count("*").alias("parts")).where("parts > 1")
    main = main.select("family", F.col("top.comp").alias("main"), blocks_for(F.col("all"), F.col("ks")).alias("all_blocks"), blocks_for(F.col("all") - F.col("top.n"), F.col("ks") - F.col("top.k")).alias("probe_blocks"))
    dealt = _met(members, "rep", scratch.table(main, "families"), "family", "inner")
    mine = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = dealt.select("family", "rep", "comp", "sig", "probe_blocks", F.lit(0).alias("probe"), mine("all_blocks", 1).alias("i"), every("probe_blocks").alias("j"))
    probe = dealt.where("comp <> main").select("family", "rep", "comp", "sig", "probe_blocks", F.lit(1).alias("probe"), mine("probe_blocks", 2).alias("j"), every("all_blocks").alias("i"))
    # a family's blocks go to tasks in turn: a hash would put several of a large one's in a task
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spot = F.pmod(F.xxhash64("family") + F.col("i").cast("long") * F.col("probe_blocks") + F.col("j"), F.lit(tasks)).cast("int")
    blocks = index.unionByName(probe).join(sets.hint("merge"), "rep").select("family", "i", "j", "comp", "probe", "sig", "shingles", spot.alias("spot"))
    blocks = blocks.repartitionById(tasks, "spot").sortWithinPartitions("family", "i", "j").drop("spot")
    more = scratch.table(blocks.mapInArrow(_by_run(("family", "i", "j"), _block_links(percent, lanes, most)), "u long, v long"), "more")
    merged = connected_components(more, scratch).select(F.col("node").alias("first"), F.col("component").alias("merged"))

    # by class, then one join with all rows
    named = classes.select("lo", "hi", "rep").join(found.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("first", F.coalesce("component", "rep"))
    named = scratch.table(_met(named, "rep", merged, "first", "left").select("lo", "hi", F.coalesce("merged", "first").alias("component")), "named")
    out = sketches.select("row", "n", "lo", "hi").join(named.hint("merge"), ["lo", "hi"], "left")
    return out.select("row", F.col("n").alias("n_shingles"), F.coalesce("component", "row").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id, kept.

    Documents are linked whose shingle sets have 100 * intersection >= percent * union.
    """
    scratch = Scratch(docs.sparkSession, "documents")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        found = linked_rows(named.select(F.col("doc_id").alias("row"), "text"), width, percent)
        out = found.select(F.col("row").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    else:  # an id is many rows', with one text or several: rows are numbered, once
        rows = scratch.table(named.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows", codec="zstd")
        found = linked_rows(rows.select("row", "text"), width, percent)
        found = scratch.table(rows.select("row", "doc_id").join(found.hint("merge"), "row"), "found")
        # components that share an id are joined
        apart = found.groupBy("doc_id").agg(F.min("component").alias("v"), F.max("component").alias("most")).where("v < most").select("doc_id", "v")
        edges = _met(found, "row", scratch.table(apart, "apart"), "doc_id", "inner").select(F.col("component").alias("u"), "v")
        merged = connected_components(edges, scratch).select(F.col("node").alias("component"), F.col("component").alias("merged"))
        found = _met(found, "row", merged, "component", "left").withColumn("component", F.coalesce("merged", "component")).drop("merged")
        names = found.groupBy("component").agg(F.min("doc_id").alias("name"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
        found = _met(found, "row", names, "component", "left")
        out = found.select("doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"))
    # a null doc_id: its own set and no component
    rest = sketch(docs.where("doc_id is null").withColumn("row", F.lit(0).cast("long")), width, 1).select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
