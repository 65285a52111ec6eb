"""Corpus preparation: keys, connected groups, conflicts, duplicates, splits, samples, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import hash_unit
from .shared import saved


def connected_groups(cases: DataFrame, case: str = "id", key: str = "key") -> DataFrame:
    """(`id`, `root`): cases that share a key, directly or over others, have the smallest id among them as root.

    Each round gives every key its least root and every case its keys' least root, then follows roots of roots; minima are
    aggregated before they are shuffled and each round is written.
    """
    pairs = saved(cases.select(F.col(case).alias("id"), F.col(key).alias("key")).distinct())
    label = saved(pairs.groupBy("id").agg(F.min("id").alias("root")))
    while True:
        by_key = pairs.join(label, "id").groupBy("key").agg(F.min("root").alias("least"))
        near = pairs.join(by_key, "key").groupBy("id").agg(F.min("least").alias("near"))
        up = label.join(near, "id").select("id", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = up.select(F.col("id").alias("root"), F.col("root").alias("further"))
        new = saved(up.join(jump, "root", "left").select("id", F.least("root", F.coalesce("further", "root")).alias("root"), "was"))
        if new.filter("root <> was").isEmpty():
            return new.select("id", "root")
        label = new.select("id", "root")


def without_conflicts(cases: DataFrame, key: str, target: str) -> DataFrame:
    """Drops all cases of a key that has more than one target."""
    bad = cases.groupBy(key).agg(F.min(target).alias("__x"), F.max(target).alias("__y")).filter("__x <> __y").select(key)
    return cases.join(bad, key, "left_anti")


def first_of_each(cases: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first case of each key; min_by aggregates before the shuffle where a window would not."""
    rest = [c for c in cases.columns if c != key]
    return cases.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")).select(key, "__first.*").select(*cases.columns)


def split_of(group: Column, any_test: Column, any_dev: Column, seed: str = "") -> Column:
    """test if any case was; halves of validation and calibration if any was for development; else 80/7/7/6 by hash."""
    u = hash_unit(F.concat(F.lit(seed), group))
    even = F.when(u < 0.5, "validation").otherwise("calibration")
    return F.when(any_test, "test").when(any_dev, even).otherwise(F.when(u < 0.8, "train").when(u < 0.87, "validation").when(u < 0.94, "calibration").otherwise("test"))


def balanced_take(cases: DataFrame, strata: list[str], rank: Column, limit: int, within: list[str] | None = None) -> DataFrame:
    """Round-robin over strata, by hash rank inside each, up to `limit` rows (of each `within`)."""
    inside = Window.partitionBy(*(within or []), *strata).orderBy(rank)
    firsts = cases.withColumn("__r", F.row_number().over(inside)).filter(F.col("__r") <= limit)
    order = Window.partitionBy(*(within or [F.lit(0)])).orderBy("__r", *strata)
    return firsts.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= limit).drop("__r", "__n")


def head_per_source(cases: DataFrame, source: str, rank: Column, n: int) -> DataFrame:
    return cases.withColumn("__r", F.row_number().over(Window.partitionBy(source).orderBy(rank))).filter(F.col("__r") <= n).drop("__r")


def leaked(cases: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split."""
    return cases.groupBy(key).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


#: A sentence with its end marks, closing quotes and the white space after, or what is left at the end.
SENTENCE = r"[^.!?。！？]++(?:[.!?。！？]++[\"')\]]*+\s*+|\z)"


def piece_sizes(block: Column, most: int = 300) -> Column:
    """Word counts of a block's pieces: the block itself up to `most` words, else whole sentences packed greedily, a longer sentence in runs of `most`."""
    none, n = F.expr("cast(array() as array<int>)"), X.count_words(block)

    def flushed(s: Column) -> Column:
        return F.when(X.count_words(s["open"]) > 0, F.concat(s["sizes"], F.array(X.count_words(s["open"])))).otherwise(s["sizes"])

    def add(s: Column, sentence: Column) -> Column:
        w = X.count_words(sentence)
        runs = F.concat(F.array_repeat(F.lit(most), F.floor(w / most).cast("int")), F.when(w % most > 0, F.array((w % most).cast("int"))).otherwise(none))
        full = X.count_words(s["open"]) + w > most
        sizes = F.when(w > most, F.concat(flushed(s), runs)).when(full, flushed(s)).otherwise(s["sizes"])
        open_ = F.when(w > most, F.lit("")).when(full, sentence).otherwise(F.concat(s["open"], sentence))
        return F.struct(sizes.alias("sizes"), open_.alias("open"))

    sentences = F.regexp_extract_all(F.regexp_replace(block, r"^\s+|\s+$", ""), F.lit(SENTENCE), F.lit(0))
    split = F.aggregate(sentences, F.struct(none.alias("sizes"), F.lit("").alias("open")), add, flushed)
    return F.when(n > most, split).when(n > 0, F.array(n)).otherwise(none)


def pack_texts(blocks: Column, most: int = 300, least: int = 40) -> Column:
    """As `pack_blocks`, from the blocks' texts; a block of more than `most` words is split first, and its pieces have its place."""
    pieces = F.transform(blocks, lambda b, i: F.transform(piece_sizes(b, most), lambda w: F.struct(i.alias("i"), w.alias("w"))))
    return _packed(F.flatten(pieces), most, least)


def pack_blocks(sizes: Column, most: int = 300, least: int = 40) -> Column:
    """Greedy chunks of consecutive blocks, from their word counts: array of (first, last, words). A last chunk under `least` joins the one before."""
    return _packed(F.filter(F.transform(sizes, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda b: b["w"] > 0), most, least)


def _packed(blocks: Column, most: int, least: int) -> Column:
    empty = F.expr("cast(array() as array<struct<first:int,last:int,words:int>>)")

    def add(chunks: Column, b: Column) -> Column:
        fresh = F.struct(b["i"].cast("int").alias("first"), b["i"].cast("int").alias("last"), b["w"].cast("int").alias("words"))
        open_ = F.element_at(chunks, -1)
        grown = F.struct(open_["first"].alias("first"), b["i"].cast("int").alias("last"), (open_["words"] + b["w"]).cast("int").alias("words"))
        fits = (F.size(chunks) > 0) & (F.coalesce(F.try_element_at(chunks, F.lit(-1))["words"], F.lit(1 << 30)) + b["w"] <= most)
        return F.when(fits, F.concat(F.slice(chunks, 1, F.size(chunks) - 1), F.array(grown))).otherwise(F.concat(chunks, F.array(fresh)))

    def close(chunks: Column) -> Column:
        a, b = F.element_at(chunks, -2), F.element_at(chunks, -1)
        both = F.struct(a["first"].alias("first"), b["last"].alias("last"), (a["words"] + b["words"]).cast("int").alias("words"))
        short = (F.size(chunks) > 1) & (F.coalesce(F.try_element_at(chunks, F.lit(-1))["words"], F.lit(0)) < least)
        return F.when(short, F.concat(F.slice(chunks, 1, F.size(chunks) - 2), F.array(both))).otherwise(chunks)

    return F.aggregate(blocks, empty, add, close)


def even_sample(n: Column, most: int) -> Column:
    """`most` places out of n, evenly, first and last among them; all if there are no more."""
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (n - 1) / (most - 1) + 0.5).cast("int"))
    return F.when(n <= most, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"))).otherwise(picked)


def first_per_category(cases: DataFrame, category: str, rank: Column) -> DataFrame:
    """The row with the least `rank` of each category, picked by a minimum that is aggregated before it moves; a null rank is never picked."""
    whole = F.struct(*[F.col(c) for c in cases.columns])
    return cases.groupBy(category).agg(F.min_by(whole, rank).alias("__row")).filter("__row is not null").select("__row.*")


def eligibility(values: DataFrame, feature: str = "feature", kind: str = "kind", value: str = "value") -> DataFrame:
    """Which features can be learned: binary ones with two zeros and two ones at least, others with two distinct values. Nulls don't apply.

    Distinct values are not gathered: a feature has two of them if its least and its greatest differ.
    """
    v = F.col(value)
    rows = values.groupBy(feature, kind).agg(F.count(value).alias("applicable"), F.count_if(v == 0).alias("zeros"), F.count_if(v == 1).alias("ones"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    can = F.when(F.col(kind) == "binary", (F.col("zeros") >= 2) & (F.col("ones") >= 2)).otherwise(F.coalesce(F.col("minimum") < F.col("maximum"), F.lit(False)))
    return rows.withColumn("eligible", can)


# --- converters, negatives, lookups, views -----------------------------------------------------------------------------------------


def case(dataset: str, task: str, state: Column, instructions: Column, primitive: str, criteria: Column, target: Column, split: Column, source_id: Column, *context: Column) -> list[Column]:
    """The columns of a uniform case from a source's row: id, task, state, question, target, context keys and where it comes from."""
    return [
        F.sha2(F.concat_ws("|", F.lit(dataset), source_id.cast("string")), 256).alias("id"), F.lit(task).alias("task"), state.alias("state"), instructions.alias("instructions"), F.lit(primitive).alias("primitive"),
        criteria.alias("criteria"), target.cast("string").alias("target"), F.array(*[X.text_key(X.squeezed(c)) for c in context]).alias("context_keys"), F.lit(dataset).alias("dataset"), split.alias("original_split"),
    ]


def yes_no(rows: DataFrame, dataset: str, passage: str, question: str, answer: str, split: str, row_id: str) -> DataFrame:
    """Passages with a question of which the answer is yes or no, as cases of `noul`."""
    criteria = F.create_map(F.lit("true"), F.lit("The passage supports it."), F.lit("false"), F.lit("The passage does not support it."))
    return rows.select(*case(dataset, "reading", F.col(passage), F.col(question), "noul", F.to_json(criteria), F.col(answer).cast("boolean"), F.col(split), F.col(row_id), F.col(passage)))


def sentence_pairs(rows: DataFrame, dataset: str, first: str, second: str, same: str, split: str, row_id: str) -> DataFrame:
    """Pairs of sentences that mean the same or not, as cases of `noul`; both sentences are context keys."""
    state = F.to_json(F.struct(F.col(first).alias("sentence1"), F.col(second).alias("sentence2")))
    return rows.select(*case(dataset, "equivalence", state, F.lit("Do both sentences mean the same?"), "noul", F.lit(None).cast("string"), F.col(same).cast("boolean"), F.col(split), F.col(row_id), F.col(first), F.col(second)))


def banded(rows: DataFrame, dataset: str, state: str, value: str, thresholds: list[float], split: str, row_id: str) -> DataFrame:
    """A number in bands, as cases of `score`: the level is how many thresholds are not above it."""
    from ..functions.probability import band

    levels = F.to_json(F.array(*[F.lit(f"level {i}") for i in range(len(thresholds) + 1)]))
    return rows.select(*case(dataset, "band", F.col(state), F.lit("Which level is it?"), "score", levels, band(F.col(value), thresholds), F.col(split), F.col(row_id), F.col(state)))


def with_negatives(rows: DataFrame, ontology: DataFrame, row_id: str, gold: str, option: str, k: int, seed: str = "") -> DataFrame:
    """`rows` with `options`: the gold option and k - 1 others of the ontology, by hash rank for each row, all put in order by a second hash.

    The ontology is a closed list of answers, broadcast; a row meets all of it, and keeps k, without a shuffle of pairs.
    """
    listed = ontology.select(F.col(option).alias("option")).distinct().agg(F.array_sort(F.collect_list("option")).alias("every"))
    at = lambda tag, o: F.sha2(F.concat_ws("|", F.lit(f"{seed}{tag}"), F.col(row_id).cast("string"), o), 256)
    others = F.array_sort(F.transform(F.filter("every", lambda o: o != F.col(gold)), lambda o: F.struct(at("negative", o).alias("h"), o.alias("o"))))
    taken = F.concat(F.transform(F.slice(others, 1, k - 1), lambda x: x["o"]), F.array(gold))
    ordered = F.transform(F.array_sort(F.transform(taken, lambda o: F.struct(at("order", o).alias("h"), o.alias("o")))), lambda x: x["o"])
    return rows.join(F.broadcast(listed)).withColumn("options", ordered).drop("every")


def looked_up(rows: DataFrame, originals: DataFrame, key: str, label: str) -> DataFrame:
    """`rows` with the `status` of their key among originals: ok, missing, contradictory (originals disagree), or other label."""
    known = originals.groupBy(key).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    status = F.when(F.col("low").isNull(), "missing").when(F.col("low") != F.col("high"), "contradictory").when(F.col("low") != F.col(label), "other label").otherwise("ok")
    return rows.join(known, key, "left").withColumn("status", status).drop("low", "high")


def rejections(rows: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that no reason rejects, and the number of rejected ones by the first reason that does."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(reasons.items()):
        reason = F.when(condition, name).otherwise(reason)
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def semantic_key(dataset: Column, *parts: Column, unordered: bool = False) -> Column:
    """What a case asks, as a digest of its squeezed parts; of `unordered` parts the order doesn't count."""
    squeezed = F.array(*[X.squeezed(p) for p in parts])
    return F.sha2(F.to_json(F.struct(dataset.alias("dataset"), (F.array_sort(squeezed) if unordered else squeezed).alias("parts"))), 256)


def group_ids(members: DataFrame, root: str = "root", key: str = "key") -> DataFrame:
    """(`root`, `group_id`): the digest of a component's distinct keys in order. Digests of keys are summed up in blocks by their first
    two digits, so that the keys of a giant component don't have to meet in one row."""
    keys = members.select(root, F.sha2(key, 256).alias("k")).distinct()
    blocks = keys.groupBy(root, F.substring("k", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), ","), 256).alias("h"))
    return blocks.groupBy(root).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("b", "h"))), ","), 256).alias("group_id"))


def bundle_views(cases: DataFrame) -> DataFrame:
    """Each case with its views: `view` 0 as it is; of yes/no questions the complement, truth and criteria exchanged; of pairs the swapped one.

    Test bundles word the complement otherwise than training ones. `relation` says what a view is to the first.
    """
    noul, pair, test = F.col("primitive") == "noul", F.col("task") == "equivalence", F.col("split") == "test"
    said = F.when(test, "Is the answer NO to the following complete yes/no judgment? [").otherwise("Is it false that the answer is YES to the following complete yes/no judgment? [")
    both = F.from_json("criteria", "map<string,string>")
    exchanged = F.when(F.col("criteria").isNotNull(), F.to_json(F.create_map(F.lit("true"), both["false"], F.lit("false"), both["true"])))
    s = F.from_json("state", "struct<sentence1:string,sentence2:string>")
    swapped = F.to_json(F.struct(s["sentence2"].alias("sentence1"), s["sentence1"].alias("sentence2")))
    view = lambda n, relation, state, instructions, criteria, target: F.struct(F.lit(n).alias("view"), F.lit(relation).alias("relation"), state.alias("state"), instructions.alias("instructions"), criteria.alias("criteria"), target.alias("target"))
    state, instructions, criteria, target = (F.col(c) for c in ("state", "instructions", "criteria", "target"))
    turned = F.when(target == "true", "false").otherwise("true")
    views = F.array_compact(F.array(view(0, None, state, instructions, criteria, target), F.when(noul, view(1, "complement", state, F.concat(said, instructions, F.lit("]")), exchanged, turned)), F.when(pair, view(2, "invariant", swapped, instructions, criteria, target))))
    return cases.select("id", "task", "split", "primitive", F.inline(views))


def quota_sample(cases: DataFrame, strata: list[str], rank: Column, source: str, split: str, quotas: dict[str, int], other: int) -> DataFrame:
    """Balanced by strata within each split and source, up to the source's quota; a source that `quotas` doesn't name has `other`."""
    most = F.coalesce(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(source)], F.lit(other)) if quotas else F.lit(other)
    inside = Window.partitionBy(split, source, *strata).orderBy(rank)
    firsts = cases.withColumn("quota_r", F.row_number().over(inside)).filter(F.col("quota_r") <= most)
    order = Window.partitionBy(split, source).orderBy("quota_r", *strata)
    return firsts.withColumn("quota_n", F.row_number().over(order)).filter(F.col("quota_n") <= most).drop("quota_r", "quota_n")


def first_views(views: DataFrame) -> DataFrame:
    """The broad suite: the first view of each bundle as a case with one question."""
    return views.filter("view = 0").drop("view", "relation")


def disjoint_picks(rows: DataFrame, row_id: str, keys: list[str], rank: Column, blocked: DataFrame | None = None) -> DataFrame:
    """Rows taken in order of `rank` such that no two share a value of any of `keys`, nor one that `blocked` (`key`) has.

    The greedy choice by rounds: a row that is the first of all its keys' rows is taken, rows that share a key with it go, and so on with
    the rest. That is what one pass in order would take. Each round is three aggregates; the first of all rows left is taken in each, so
    it ends, and most rows are settled in the first few.
    """
    tagged = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in keys]))
    left = saved(rows.select(F.col(row_id).alias("pick"), rank.alias("rank"), F.explode(tagged).alias("key")))
    if blocked is not None:
        bad = left.join(blocked.select("key").distinct(), "key", "left_semi").select("pick").distinct()
        left = saved(left.join(bad, "pick", "left_anti"))
    taken = None
    while not left.isEmpty():
        firsts = left.groupBy("key").agg(F.min_by("pick", F.struct("rank", "pick")).alias("first"))
        marked = left.join(firsts, "key")
        now = saved(marked.groupBy("pick").agg(F.bool_and(F.col("pick") == F.col("first")).alias("all")).filter("all").select("pick"))
        taken = now if taken is None else taken.unionAll(now)
        gone = left.join(left.join(now, "pick", "left_semi").select("key").distinct(), "key", "left_semi").select("pick").distinct()
        left = saved(left.join(gone, "pick", "left_anti"))
    found = taken if taken is not None else left.select("pick")
    return rows.join(found.select(F.col("pick").alias(row_id)), row_id, "left_semi")
