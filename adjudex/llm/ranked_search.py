"""Ranked lexical search, pipelined over term owners: item bundles carry document accumulators from one owner of terms to the next."""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ONE_TASK, ascii_lower, discard, prefix_sums, saved, slices, table, texts, word_spans
from .decontaminate import _FOLD

#: A term: a run of ASCII letters and digits and of anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
#: Owners of terms, which is how many stages bundles pass through.
OWNERS = 4
#: Documents of a shard, and items of a bundle, on average: what one call of a stage holds is a matrix of them.
SHARD_DOCS, BUNDLE = 2048, 256
#: Bytes of the items' terms that are broadcast; with more of them, all terms of all documents meet the items' in a join.
VOCABULARY_BYTES = 16 << 20

_known: dict[str, dict[bytes, int]] = {}
_ACCUMULATORS = "shard int, bundle int, item long, docs array<int>, scores array<long>"


def _count(schema: T.StructType, column: str, run_id: str, vocabulary):
    """Terms of each text with repeats, and the number of times it holds each term of the vocabulary, or each term at all without one."""
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        if vocabulary is not None:
            if run_id not in _known:
                _known.clear()
                _known[run_id] = pickle.loads(vocabulary.value)
            known = _known[run_id].get
        for part in slices(batches, column):
            sizes, terms, times = [], [], []
            for text in texts(part, column):
                counts: Counter[bytes] = Counter()
                for words in word_spans(text.translate(_FOLD)):
                    counts.update(words)
                sizes.append(counts.total())
                held = [(w, c) for w, c in counts.items()] if known is None else [(k, c) for w, c in counts.items() if (k := known(w)) is not None]
                terms.append([w.decode("utf-8", "replace") for w, _ in held] if known is None else [k for k, _ in held])
                times.append([c for _, c in held])
            made = {"n": pa.array(sizes, pa.int64()), "terms": pa.array(terms, pa.list_(pa.string() if known is None else pa.int32())), "times": pa.array(times, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_arrays([made[x] if x in made else part.column(x) for x in names], names=names)

    return run


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _stage(k: int | None):
    """One owner's work on one bundle and shard: adds its terms' contributions to the accumulators; the last owner (`k`) keeps the k best."""

    def run(key: tuple, bundles: pa.Table, owned: pa.Table) -> pa.Table:
        lists = list(zip(owned.column("items").to_pylist(), owned.column("docs").combine_chunks(), owned.column("adds").combine_chunks(), strict=True)) if owned.num_rows else []
        carried = list(zip(bundles.column("item").to_pylist(), bundles.column("docs").combine_chunks(), bundles.column("scores").combine_chunks(), strict=True)) if bundles.num_rows else []
        items = np.array(sorted({x for ids, _, _ in lists for x in ids} | {x for x, _, _ in carried}), dtype=np.int64)
        whole = lambda x: x.values.to_numpy()
        wide = 1 + max((int(whole(d).max()) for _, d, _ in [*lists, *carried]), default=-1)
        sums = np.zeros((len(items), wide), dtype=np.int64)
        for item, docs, scores in carried:
            sums[np.searchsorted(items, item), whole(docs)] = whole(scores)
        for ids, docs, adds in lists:
            sums[np.searchsorted(items, ids)[:, None], whole(docs)] += whole(adds)
        if k is not None:
            for row in sums:
                if np.count_nonzero(row) > k:
                    # Places go by id, so that of equal scores the first ones stay.
                    least = np.partition(row, -k)[-k]
                    equal = np.flatnonzero(row == least)
                    row[equal[k - int((row > least).sum()) :]] = 0
                    row[row < least] = 0
        at, docs = np.nonzero(sums)
        bounds = np.searchsorted(at, np.arange(len(items) + 1))
        n = len(items)
        return pa.table({
            "shard": pa.array([key[0].as_py()] * n, pa.int32()), "bundle": pa.array([key[1].as_py()] * n, pa.int32()), "item": pa.array(items, pa.int64()),
            "docs": _lists(docs, bounds, pa.int32()), "scores": _lists(sums[at, docs], bounds, pa.int64()),
        })

    return run


def _best(rows: DataFrame, k: int, key: str, shards: int, *order) -> DataFrame:
    """The first k rows of each `key` in `order`, found within groups of shards first."""
    groups = max(1, round(shards**0.5))
    first = Window.partitionBy(key, F.pmod("shard", F.lit(groups))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).drop("rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    owners: int = OWNERS, shard_docs: int = SHARD_DOCS, bundle: int = BUNDLE, vocabulary_bytes: int = VOCABULARY_BYTES,
) -> DataFrame:
    """Each item's k best documents: item_id, rank (from 1), doc_id, score; scores above 0, of equal ones the smaller doc_id first.

    A document's score sums, over the item's distinct terms, w * ((10^9 * tf) div (1000 * tf + 20 * m)) with w = floor(1000 * ln((2N + 2) /
    (2df + 1))) and m = 50 + (50 * n * N) div L: n terms in the document, L in all, N documents with a term, df with this one.

    One pass counts terms and writes for each document those that items ask for. Documents are dealt by hash into shards, and stand in
    them by doc_id. Terms are dealt to `owners` in order of df, so that all have about as many postings and rare terms come first, while
    accumulators are few. An owner's lists lie by shard and term and hold what a term adds to each document. Items go in bundles,
    one for each shard, from owner to owner: a stage cogroups them with that owner's lists and adds; the last keeps a shard's k best.
    So a group is `shard_docs` by `bundle` numbers at most, a word that all documents hold is in as many lists as there are shards, and
    no count is left out. The items' terms, and which items ask for them, are broadcast up to `vocabulary_bytes` each, and joined beyond, with the same rows.

    Null or empty text: no terms, never found; as an item no rows. Rows of one item_id count as one item with all their terms, those
    with a null id among them. Documents of one doc_id each take a rank; a null doc_id stands last among equals. Other columns are not read.
    Empty tables: no rows.
    """
    spark, null_safe = docs.sparkSession, F.col("a.item_id").eqNullSafe(F.col("b.item_id"))
    terms_of = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col(f"`{item_text}`")), F.lit(TERM), F.lit(0)))
    asked = saved(items.select(F.col(f"`{item_id}`").alias("item_id"), F.explode(terms_of).alias("name")).distinct(), "asked")
    numbers = saved(asked.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    bundles = max(1, -(-numbers.count() // bundle))
    names = asked.select("name").distinct()
    small = (names.agg(F.sum(F.octet_length("name") + 64).alias("bytes")).first()["bytes"] or 0) <= vocabulary_bytes
    if small:
        known = sorted(r["name"] for r in names.collect())
        vocabulary = spark.createDataFrame(list(enumerate(known)), "term int, name string")
        known = spark.sparkContext.broadcast(pickle.dumps({w.encode(): i for i, w in enumerate(known)}))
    else:
        vocabulary, known = names.withColumn("term", F.col("name")), None
    wanted = asked.alias("a").join(numbers.alias("b"), null_safe).join(vocabulary, "name").withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int"))
    wanted = saved(wanted.groupBy("term", "bundle").agg(F.collect_list("item").alias("items")), "wanted")
    few = small and (wanted.agg(F.sum(8 * F.size("items") + 64).alias("bytes")).first()["bytes"] or 0) <= vocabulary_bytes

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(f"n long, terms array<{'int' if small else 'string'}>, times array<int>")])
    index = saved(rows.mapInArrow(_count(schema, "text", uuid.uuid4().hex, known), schema).filter("n > 0").withColumn("row", F.monotonically_increasing_id()), "index")
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-n_docs // shard_docs))
    place = Window.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    mean = F.expr(f"50 + (CAST(50 * n AS DECIMAL(20, 0)) * CAST({n_docs} AS DECIMAL(18, 0))) div CAST({max(n_terms, 1)} AS DECIMAL(20, 0))")
    placed = index.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("place", F.row_number().over(place) - 1)
    placed = saved(placed.select("shard", "place", "doc_id", mean.alias("m"), "terms", "times"), "placed")
    discard(index)

    weights = placed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = saved(weights.join(vocabulary, "term", "left_semi"), "frequencies")
    n_terms, n_postings = weights.agg(F.count(F.lit(1)), F.sum("df")).first()
    weights = prefix_sums(weights, [F.col("df"), F.col("term")], {"before": F.col("df")}, spread=n_terms > ONE_TASK)
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    weights = weights.select("term", weight.alias("w"), F.floor(F.col("before") * owners / (n_postings or 1)).cast("int").alias("owner"))

    postings = placed.select("shard", "place", "m", F.explode(F.arrays_zip("terms", "times")).alias("x")).select("shard", "place", "m", F.col("x.terms").alias("term"), F.col("x.times").cast("long").alias("tf"))
    adds = F.expr("w * ((1000000000 * tf) div (1000 * tf + 20 * m))")
    lists = postings.repartition("shard").join(F.broadcast(weights) if small else weights, "term").groupBy("shard", "owner", "term").agg(F.collect_list(F.struct("place", adds.alias("adds"))).alias("x"))
    lists = saved(lists.join(F.broadcast(wanted) if few else wanted, "term").select("shard", "bundle", "owner", "items", F.col("x.place").alias("docs"), F.col("x.adds").alias("adds")), "lists", by=("owner",))

    bundles_ = spark.createDataFrame([], _ACCUMULATORS)
    for owner in range(owners):
        owned = lists.filter(F.col("owner") == owner).select("shard", "bundle", "items", "docs", "adds")
        bundles_ = bundles_.groupBy("shard", "bundle").cogroup(owned.groupBy("shard", "bundle")).applyInArrow(_stage(k if owner == owners - 1 else None), _ACCUMULATORS)
    found = bundles_.select("shard", "item", F.explode(F.arrays_zip("docs", "scores")).alias("x"))
    found = saved(found.select("shard", "item", F.col("x.docs").alias("place"), F.col("x.scores").alias("score")), "found")
    discard(lists)

    least = _best(found, k, "item", shards, F.desc("score")).groupBy("item").agg(F.min("score").alias("least"))
    found = found.join(least, "item").filter("score >= least").join(placed.select("shard", "place", "doc_id"), ["shard", "place"])
    best = _best(found, k, "item", shards, F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("shard"), F.col("place"))
    return best.join(numbers, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, ts, len(ts)::BIGINT AS n FROM t WHERE len(ts) > 0),
f AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, doc_id, 50 + (50 * n * nd) // l AS m, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS term FROM d) CROSS JOIN f WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, nd, l, term),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term) CROSS JOIN f),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
