"""Near-duplicates by b-bit MinHash: bands find candidates, packed low bits estimate them, full shingle sets confirm them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, output, saved, slices, table, texts

#: A pair at similarity 0.8 shares none of 36 bands of 5 with probability 6e-7.
HASHES, BANDS, BAND_ROWS = 192, 36, 5
#: Low bits kept of each minimum, 16 minima to a 64-bit word.
BITS = 4
#: Estimates this far under the threshold (over five standard errors) are still confirmed on full sets.
MARGIN = 0.2

#: Members of a band to a deal; a centre with more of them gets as many deals as hold them.
DEAL = 512

_PIECE = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _constants(n: int, salt: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


_A, _B, _C = _constants(HASHES, 1) | np.uint64(1), _constants(HASHES, 2), _constants(64, 3) | np.uint64(1)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of `size` words, A-Z lower-cased; fewer words are one shingle, none are none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.array([xxhash.xxh3_64_intdigest(x) for x in words], dtype=np.uint64)
    size = min(size, len(w))
    total = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total += w[i : len(w) - size + 1 + i] * _C[i]
    return np.unique(_mix(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of HASHES multiply-shift hashes."""
    least = np.full(HASHES, 1 << 32, dtype=np.uint64)
    for i in range(0, len(shingles), _PIECE):
        np.minimum(least, ((shingles[i : i + _PIECE, None] * _A + _B) >> np.uint64(32)).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    return _mix((rows * _C[:BAND_ROWS]).sum(axis=1, dtype=np.uint64) + _C[20 : 20 + 1] * np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, 16 to a word."""
    low = (least & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def _sketch(column: str, size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            n, keys, bands, bits = [], [], [], []
            for text in texts(part, column):
                s = shingle_set(text, size)
                n.append(len(s))
                if not len(s):
                    keys.append(None), bands.append(None), bits.append(None)
                    continue
                least = minima(s)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(band_keys(least))
                bits.append(packed(least))
            yield output({"doc_id": part.column("doc_id"), "n_shingles": n, "key": keys, "bands": bands, "bits": bits}, schema)

    return run


def _sets(column: str, size: int):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            yield output({"node": part.column("doc_id"), "shingles": [shingle_set(x, size).view(np.int64) for x in texts(part, column)]}, schema)

    return run


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two arrays of packed low bits: the share of equal minima, less what equal low bits of unequal minima give by chance."""
    ones = F.lit(0x1111111111111111).cast("long")

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(ones))

    apart = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    return (1 - apart / HASHES - chance) / (1 - chance)


def _roots(parents: DataFrame) -> DataFrame:
    """From a forest (`node`, `component`, its parent, itself at a root) to each node's root, in steps that double their reach."""
    while True:
        onward = parents.select(F.col("node").alias("component"), F.col("component").alias("further"))
        further = saved(parents.join(onward, "component", "left").select("node", F.coalesce("further", "component").alias("component"), F.col("component").alias("was")), "parents")
        done = further.filter("component <> was").isEmpty()
        discard(parents)
        parents = further
        if done:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """From links (`a`, `b`) to `node`, `component`: the least node that can be reached.

    Each round maps every node to its least neighbour, if that is less than itself, follows these to their roots, which takes steps in
    the logarithm of their depth, and links what nodes map to. A root that no node maps to has only smaller neighbours in the next
    round, so two rounds leave half of the nodes at most, whatever the order of ids in a chain. Links shrink from round to round, each
    round is written to the shared folder, and minima are aggregated before they move.
    """
    label, links = None, saved(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while not links.isEmpty():
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = _roots(saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "parents"))
        before, label = label, up
        if before is not None:
            nxt = up.select(F.col("node").alias("component"), F.col("component").alias("root"))
            label = saved(before.join(nxt, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        pa_, pb = up.select(F.col("node").alias("a"), F.col("component").alias("x")), up.select(F.col("node").alias("b"), F.col("component").alias("y"))
        used, links = links, saved(links.join(pa_, "a").join(pb, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        discard(used, before, *([up] if label is not up else []))
    return label.select("node", "component") if label is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))


class _Compare:
    """Holds pairs (`a`, `b`) against each other. The rows of a hot `a` are dealt by `deal`, and what belongs to `a` is sent once for each deal.

    `hubs` has the number of deals of every `a` that has more than one.
    """

    def __init__(self, sketches: DataFrame, sets: DataFrame, hubs: DataFrame, percent: int):
        self.sketches, self.sets, self.hubs, self.percent = sketches, sets, hubs, percent

    def dealt(self, of_a: DataFrame) -> DataFrame:
        """`of_a`, unique by `a`, once for each deal of it."""
        deals = of_a.join(self.hubs, "a", "left").withColumn("deals", F.coalesce("deals", F.lit(1).cast("long")))
        return deals.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))).drop("deals")

    def with_both(self, pairs: DataFrame, table_: DataFrame, key: str, column: str) -> DataFrame:
        """`pairs` (`a`, `b`, `deal`) with `column` of both ends."""
        of = lambda end: table_.select(F.col(key).alias(end), F.col(column).alias(f"{column}_{end}"))
        return pairs.join(self.dealt(of("a")).hint("merge"), ["a", "deal"]).join(of("b").hint("merge"), "b")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs that packed low bits make likely: those whose estimate is at most MARGIN under the threshold."""
        near = self.with_both(pairs, self.sketches, "doc_id", "bits")
        return near.filter(estimate(F.col("bits_a"), F.col("bits_b")) >= max(0.0, self.percent / 100 - MARGIN)).drop("bits_a", "bits_b")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Of likely pairs those that full sets confirm."""
        both = self.with_both(self.likely(pairs), self.sets, "node", "shingles")
        common, sizes = F.size(F.array_intersect("shingles_a", "shingles_b")), F.size("shingles_a") + F.size("shingles_b")
        return both.filter(100 * common >= self.percent * (sizes - common)).select("a", "b")


def mates(around: DataFrame, compare: _Compare) -> DataFrame:
    """Pairs of nodes around one centre, in different components, that can still be linked: `a`, `b`, `deal`.

    `around` has rows (`a`, `b`, `deal`, `component` of b, `largest` component of a's rows). With D the symmetric difference of a
    node's set and the centre's, two nodes x and y differ in |D_x| + |D_y| - 2 |D_x & D_y| shingles, and are linked if that is at
    most share * (|x| + |y|), where share = (100 - percent) / (100 + percent). So D_x and D_y need a certain overlap; it is at
    least 1 where one of the two is not linked with the centre, as holds for nodes of two components. Two sets with an overlap of
    `need` have a shingle in common among the rarest of each, all but need - 1; only such pairs are made. A shingle that stands in
    the differences of one component alone counts for none of this.

    A node's least need over all partners cuts its list before the join: a partner of a linked node isn't linked with the centre,
    so |D| - share * |x| of it is above share * |centre|; else it is at least -share * |centre|.
    """
    share, slack = (100 - compare.percent) / (100 + compare.percent), 1e-9
    both = compare.with_both(around, compare.sets, "node", "shingles")
    apart = F.concat(F.array_except("shingles_a", "shingles_b"), F.array_except("shingles_b", "shingles_a"))
    rows = both.select("a", "b", "component", "largest", F.size("shingles_a").alias("n_a"), F.size("shingles_b").alias("n"), apart.alias("apart"))
    rows = saved(rows.withColumn("d", F.size("apart")).withColumn("which", F.xxhash64("apart")), "apart")

    each = rows.select(*[c for c in rows.columns if c != "apart"], F.explode("apart").alias("shingle"))
    holders = each.groupBy("a", "shingle").agg(F.count(F.lit(1)).alias("holders"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("a", "shingle", "holders")
    own = Window.partitionBy("a", "b", "which")
    ranked = each.join(holders, ["a", "shingle"]).withColumns({"place": F.row_number().over(own.orderBy("holders", "shingle")), "all": F.count(F.lit(1)).over(own)})
    rest = F.when(F.col("d") <= share * (F.col("n") + F.col("n_a")), share * F.col("n_a")).otherwise(-share * F.col("n_a"))
    least = F.greatest(F.lit(1), F.ceil((F.col("d") - share * F.col("n") + rest) / 2 - slack))
    ranked = saved(ranked.filter(F.col("place") <= F.col("all") - least + 1).drop("holders", "n_a", "which"), "ranked")

    probes = ranked.filter("component <> largest").select("a", "shingle", *[F.col(c).alias(f"x_{c}") for c in ("b", "component", "n", "d", "place", "all")])
    need = F.ceil((F.col("x_d") + F.col("d") - share * (F.col("x_n") + F.col("n"))) / 2 - slack)
    can = (F.col("x_place") <= F.col("x_all") - need + 1) & (F.col("place") <= F.col("all") - need + 1)
    once = (F.col("component") == F.col("largest")) | (F.col("x_b") < F.col("b"))
    met = probes.join(ranked, ["a", "shingle"]).filter((F.col("x_component") != F.col("component")) & once & can)
    return met.select(F.least("x_b", "b").alias("a"), F.greatest("x_b", "b").alias("b")).distinct().withColumn("deal", F.lit(0).cast("long"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id and kept.

    Documents are linked whose sets of `size`-word shingles have 100 * intersection >= percent * union; component_id is the
    smallest doc_id reachable. Equal sets collapse to one node, its smallest doc_id, before anything else. Nodes that share a band
    are candidates; an estimate from packed bits sorts out those that are unlike, full sets of 64-bit shingle hashes confirm.

    No band gives all its pairs. First each node is held against the smallest of its band, the centre, which joins nearly all
    copies of a text. Nodes of one centre that are in different components after this meet by what they have changed of the
    centre, see `mates`. No link between nodes of a band is lost by it.

    Null or empty text: no shingles, linked with nothing. doc_id is read as a long; null, or no number: n_shingles given,
    component_id null, kept. Rows that share a doc_id are one document with several texts: links of each count. Other columns,
    whatever their names, are not read. Empty table: empty.
    """
    ids = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = saved(ids.mapInArrow(_sketch("text", size), "doc_id long, n_shingles long, key binary, bands array<long>, bits array<long>"), "sketches")
    full = rows.filter("key is not null and doc_id is not null")
    nodes = saved(full.groupBy("key").agg(F.min("doc_id").alias("node")), "nodes")
    sketches = saved(full.join(nodes.select("key", F.col("node").alias("doc_id")).hint("merge"), ["key", "doc_id"]).dropDuplicates(["key", "doc_id"]), "classes")

    several = full.join(nodes.hint("merge"), "key").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.collect_set("node").alias("all")).filter("a <> b")
    same = several.select("a", F.explode("all").alias("b")).filter("a <> b")

    members = sketches.select(F.col("doc_id").alias("b"), F.explode("bands").alias("band"))
    centres = members.groupBy("band").agg(F.min("b").alias("a"), F.max("b").alias("last"), F.count(F.lit(1)).alias("n")).filter("a <> last")
    centres = saved(centres.select("band", "a", F.max(F.expr(f"1 + n div {DEAL}")).over(Window.partitionBy("a")).alias("deals")), "centres")
    hubs = saved(centres.filter("deals > 1").select("a", "deals").distinct(), "hubs")
    stars = members.join(centres.hint("merge"), "band").filter("b <> a").groupBy("a", "b").agg(F.first(F.pmod(F.xxhash64("b"), "deals")).alias("deal"))
    stars = saved(stars, "stars")
    met = stars.select(F.col("a").alias("doc_id")).unionAll(stars.select(F.col("b").alias("doc_id"))).distinct()
    sets = saved(ids.join(met.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets("text", size), "node long, shingles array<long>"), "sets")
    compare = _Compare(sketches, sets, hubs, percent)
    label = components(compare.linked(stars).unionAll(same))

    named = label.select(F.col("node").alias("b"), "component")
    around = stars.join(named, "b", "left").withColumn("component", F.coalesce("component", "b"))
    parts = around.groupBy("a", "component").agg(F.count(F.lit(1)).alias("of")).groupBy("a").agg(F.max_by("component", F.struct("of", "component")).alias("largest"), F.count(F.lit(1)).alias("parts"))
    mixed = compare.dealt(parts.filter("parts > 1").drop("parts"))
    more = compare.linked(mates(around.join(mixed, ["a", "deal"]), compare))
    for end in ("a", "b"):
        more = more.join(label.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left").withColumn(end, F.coalesce(f"of_{end}", end)).drop(f"of_{end}")
    roots = components(more).select(F.col("node").alias("component"), F.col("component").alias("root"))

    final = nodes.join(label, "node", "left").select("key", F.coalesce("component", "node").alias("component")).join(roots, "component", "left")
    final = final.select("key", F.coalesce("root", "component").alias("root"))
    out = rows.select("doc_id", "n_shingles", "key").join(final.hint("merge"), "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """`docs` without those of which a near-duplicate with a smaller doc_id stays. All columns pass through.

    Null or empty text and null doc_id: stay. Rows that share a doc_id go or stay together. Empty table: empty.
    """
    dropped = near_duplicates(docs, size, percent, text).filter("not kept").select("doc_id").distinct()
    return docs.join(dropped.hint("merge"), docs["doc_id"].try_cast("long") == dropped["doc_id"], "left_anti")


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 1 THEN [ws[1]] WHEN len(ws) > 1 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE [] END AS sh FROM d),
c AS (SELECT doc_id, len(sh)::BIGINT AS n, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS nx, any_value(y.n) AS ny, count(*) AS k FROM c x JOIN c y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (nx + ny - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS doc_id, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON r.doc_id = u.a AND r.root < u.b),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY 1)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(root, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(root, s.doc_id)) AS kept FROM s LEFT JOIN m USING (doc_id)
"""
