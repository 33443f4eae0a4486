"""Near-duplicates by SetSketch registers: banded registers propose pairs, a joint likelihood thins them, full sets decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import shingle_sets, slices
from millrace.llm.components import connected
from millrace.llm.tables import bit_set, bit_test, written

#: Registers are floor(1 - log_BASE(x / RATE)) of the smallest of exponential variables, cut to 0 .. TOP.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Registers in a band and number of bands. At a similarity of 0.85 all bands miss with a chance of 2e-7.
ROWS, BANDS = 4, 24
#: A pair is dropped unread only if its registers are exp(DOUBT) times likelier under its best similarity than under
#: any similarity that counts as a link.
DOUBT = 14.0
#: Bits of the filter that picks the texts to be read for their full sets; fixed, so its size never grows.
FILTER_BITS = 1 << 22
#: Rounds of stars before buckets are searched in full.
STARS = 2
#: Rows of a band bucket that are compared in memory at once; larger buckets are split into pairs of blocks.
BLOCK = 2048

_SKETCH = "doc_id long, n_shingles long, set_hi long, set_lo long, registers array<bigint>"


def _functions() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(77)
    factors = random.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors[:, None], random.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)[:, None]


def registers_of(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes. The registers of a union are the larger ones of its parts."""
    factors, terms = _functions()
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max)
    for low in range(0, len(shingles), 4096):
        least = np.minimum(least, (factors * shingles[None, low : low + 4096] + terms).min(axis=1))
    exponential = -np.log1p(-np.minimum(least.astype(np.float64) / 2.0**64, 1 - 2.0**-53)) / RATE
    values = np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE))
    return np.clip(values, 0, TOP).astype(np.uint16)


def _sketch(id_col: str, text_col: str, width: int):
    def run(batches):
        for batch in batches:
            for rows in slices(batch, text_col):
                sets = shingle_sets(rows.column(text_col), width)
                digests = [_digest(s) for s in sets]
                packed = [registers_of(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                flat = np.concatenate(packed) if packed else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(id_col).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(p) for p in packed]), pa.int32()), pa.array(flat)),
                    ],
                    names=["doc_id", "n_shingles", "set_hi", "set_lo", "registers"],
                )

    return run


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others."""
    x = shingles.astype(np.uint64)
    hi = np.bitwise_xor.reduce(x * np.uint64(0xD6E8FEB86659FD93) ^ (x >> np.uint64(29)), initial=np.uint64(0))
    lo = np.add.reduce((x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD), dtype=np.uint64, initial=np.uint64(len(x)))
    return int(np.uint64(hi).view(np.int64)), int(np.uint64(lo).view(np.int64))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``doc_id``, set size, digest of the set and registers of each row. Null and word-free texts have an empty set."""
    return docs.select(id_col, text_col).mapInArrow(_sketch(id_col, text_col, width), _SKETCH)


# ---- likelihood


def _log_likelihoods(more: np.ndarray, less: np.ndarray, same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: np.ndarray):
    """Log-likelihood of each similarity of ``grid`` for each pair, given how many registers are larger, smaller, equal."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = np.minimum(grid[None, :], most)

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = chance(u - v * j), chance(v - u * j)
    tiny = 1e-12
    return (
        more[:, None] * np.log(np.maximum(up, tiny))
        + less[:, None] * np.log(np.maximum(down, tiny))
        + same[:, None] * np.log(np.maximum(1 - up - down, tiny))
    ), j


def estimate(left: np.ndarray, right: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, at_least: float):
    """Similarity of most joint likelihood for pairs of register rows, and whether ``at_least`` stays plausible."""
    more, less = (left > right).sum(axis=1), (left < right).sum(axis=1)
    same = left.shape[1] - more - less
    grid = np.linspace(0, 1, 101)
    value, j = _log_likelihoods(more, less, same, n_a.astype(float), n_b.astype(float), grid)
    best = value.argmax(axis=1)
    rows = np.arange(len(best))
    link, _ = _log_likelihoods(more, less, same, n_a.astype(float), n_b.astype(float), np.linspace(at_least, 1, 16))
    return j[rows, best], value[rows, best] - link.max(axis=1) <= DOUBT


def _registers(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(len(column), ROWS * BANDS)


def _plausible(at_least: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                _, keep = estimate(
                    _registers(batch.column("reg_a")), _registers(batch.column("reg_b")),
                    batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), at_least,
                )
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


# ---- verification


def _sets(id_col: str, text_col: str, width: int):
    def run(batches):
        for batch in batches:
            for rows in slices(batch, text_col):
                sets = [s.tobytes() for s in shingle_sets(rows.column(text_col), width)]
                yield pa.RecordBatch.from_arrays([rows.column(id_col).cast(pa.int64()), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("set_a"), batch.column("set_b")):
                a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def shingle_table(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id``, ``shingles`` (sorted, packed) of the documents in ``ids``, and of others that share a slot of the filter.

    The filter has a fixed size and lets texts be passed over where they are read, so no text is shuffled.
    """
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(FILTER_BITS))
    words = bit_set(ids.select(slot("id").alias("slot")), FILTER_BITS).scalar()
    some = docs.where(bit_test(words, slot(id_col))).select(id_col, text_col)
    return some.mapInArrow(_sets(id_col, text_col, width), "id long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose full shingle sets reach the similarity."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")).hint("merge"), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")).hint("merge"), "b")
    return both.mapInArrow(_verified(percent), "a long, b long")


# ---- candidates


def _star_pairs(rows: DataFrame, found: DataFrame | None, percent: int) -> DataFrame:
    """Each member of a band bucket with the bucket's centre: as many pairs as members, however large the bucket.

    The centre is the member that meets most others in all its buckets, so the text that the others are copies of is
    the centre of most buckets. With ``found``, only buckets that hold several components count: the centre is then
    taken from the members outside the component of the first centre, and meets the members of other components.
    """
    best = F.max(F.struct("meets", (-F.col("id")).alias("minus"), "id", "n", "component"))
    if found is None:
        placed = rows.withColumn("component", F.col("id"))
        centres = placed.groupBy("band", "key").agg(best.alias("c"))
    else:
        placed = _placed(rows, found)
        first = placed.groupBy("band", "key").agg(best.alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        others = placed.join(first.select("band", "key", F.col("f.component").alias("not")), ["band", "key"]).where("component <> not")
        centres = others.groupBy("band", "key").agg(best.alias("c"))
    return (
        placed.join(centres, ["band", "key"])
        .where(F.col("component") != F.col("c.component"))
        .where(F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * percent)
        .select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b"))
        .distinct()
    )


def _placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _meetings(table: pa.Table, part: np.ndarray, at_least: float, percent: int):
    """For each row of the first block, the rows it may be linked with: of another component in ``part``, of fitting
    size, plausible by registers, and met in no earlier band."""
    regs, n, ids = _registers(table.column("registers")), table.column("n").to_numpy(), table.column("id").to_numpy()
    packed, block = regs.view(np.int64), table.column("block").to_numpy()
    i, j, band = (table.column(c)[0].as_py() for c in ("i", "j", "band"))
    rights = np.flatnonzero(block == j)
    for x in np.flatnonzero(block == i):
        ys = rights[(part[rights] != part[x]) & ((ids[rights] > ids[x]) if i == j else True)]
        ys = ys[np.minimum(n[ys], n[x]) * 100 >= np.maximum(n[ys], n[x]) * percent]
        ys = ys[(packed[ys] == packed[x]).argmax(axis=1) == band]
        if len(ys):
            _, keep = estimate(np.broadcast_to(regs[x], (len(ys), regs.shape[1])), regs[ys], np.full(len(ys), n[x]), n[ys], at_least)
            yield x, ys[keep]


def _hopeful(at_least: float, percent: int):
    """The rows of a bucket that have anything to be compared with in full."""

    def run(table: pa.Table) -> pa.Table:
        some = np.zeros(table.num_rows, bool)
        for x, ys in _meetings(table, table.column("component").to_numpy(), at_least, percent):
            some[ys] = True
            some[x] |= len(ys) > 0
        return table.filter(pa.array(some))

    return run


def _search(at_least: float, percent: int):
    """Links between members of a bucket (or of two of its blocks) that lie in different components: one for each
    component that is joined."""

    def run(table: pa.Table) -> pa.Table:
        n, ids, part = table.column("n").to_numpy(), table.column("id").to_numpy(), table.column("component").to_numpy().copy()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles")]
        out_a, out_b = [], []
        for x, ys in _meetings(table, part, at_least, percent):
            for y in ys:
                if part[y] == part[x]:
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (n[x] + n[y] - both):
                    out_a.append(ids[x])
                    out_b.append(ids[y])
                    part[part == part[y]] = part[x]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _open_links(rows: DataFrame, found: DataFrame, sketch: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that the stars missed, from buckets whose members are not all in one component yet."""
    placed = _placed(rows, found)
    open_buckets = (
        placed.groupBy("band", "key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("of"))
        .where("lo < hi")
        .select("band", "key", F.ceil(F.col("of") / BLOCK).cast("int").alias("blocks"))
    )
    members = (
        placed.join(open_buckets, ["band", "key"])
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "key", "id", "n", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    members = members.join(sketch.select(F.col("doc_id").alias("id"), "registers"), "id")
    bucket = ["band", "key", "i", "j"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields)
    hopeful = members.groupBy(*bucket).applyInArrow(_hopeful(percent / 100, percent), schema)
    full = hopeful.join(sets.hint("merge"), "id")
    return full.groupBy(*bucket).applyInArrow(_search(percent / 100, percent), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """Components of texts whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns one row per row of ``docs``: id, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept``.
    Rows of equal sets are one node from the start. Band buckets first give each member with a centre (a star);
    confirmed links join components; buckets that then still hold several components are searched in full, block by
    block and in memory, and give one link for each component they join, so that no component is lost. Every link rests on the full sets. Null,
    empty and word-free texts are linked with nothing; an empty table gives an empty result; ids are unique.
    """
    sketch = written(sketches(docs, id_col, text_col, width), "sketches")
    classes = sketch.where("n_shingles > 0").groupBy("n_shingles", "set_hi", "set_lo").agg(F.min("doc_id").alias("rep"))
    node = F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id"))
    members = written(
        sketch.select("doc_id", "n_shingles", "set_hi", "set_lo")
        .join(classes, ["n_shingles", "set_hi", "set_lo"], "left")
        .select("doc_id", "n_shingles", node.alias("rep")),
        "members",
    )
    nodes = sketch.join(members.where("doc_id = rep and n_shingles > 0").select("doc_id"), "doc_id", "left_semi")
    rows = nodes.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.posexplode("registers").alias("band", "key"))
    several = rows.groupBy("band", "key").agg(F.count("*").alias("of")).where("of > 1")
    rows = rows.join(several, ["band", "key"])
    meets = rows.groupBy("id").agg(F.sum("of").alias("meets"))
    rows = written(rows.drop("of").join(meets, "id"), "bands")
    side = sketch.select("doc_id", "n_shingles", "registers")
    sets = None

    links, found = None, None
    for _ in range(STARS):
        pairs = (
            _star_pairs(rows, found, percent)
            .join(side.select(F.col("doc_id").alias("a"), F.col("registers").alias("reg_a"), F.col("n_shingles").alias("n_a")), "a")
            .join(side.select(F.col("doc_id").alias("b"), F.col("registers").alias("reg_b"), F.col("n_shingles").alias("n_b")), "b")
            .mapInArrow(_plausible(percent / 100), "a long, b long")
        )
        pairs = written(pairs, "stars")
        if sets is None:
            sets = written(shingle_table(docs, rows.select("id").distinct(), id_col, text_col, width), "sets")
        new = written(verified(pairs, sets, percent), "links")
        links = new if links is None else links.unionByName(new)
        found = connected(links)
    rest = written(_open_links(rows, found, sketch, sets, percent), "links")
    found = connected(links.unionByName(rest))
    placed = members.join(found, members["rep"] == found["node"], "left")
    return placed.select(
        F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component", "rep").alias("component_id")
    ).withColumn("kept", F.col("component_id") == F.col(id_col))
