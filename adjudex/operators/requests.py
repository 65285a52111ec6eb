"""Question trees to scoring units, answer trees to leaves and back, and whether answers are valid. Trees are JSON texts; what a row needs of Python is small."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import probability as P
from .trees import dumped, outline, parsed

_S = T.StringType()
LEAVES = T.ArrayType(T.StructType([T.StructField("path", _S), T.StructField("leaf", _S)]))


def _path(parts: tuple) -> str:
    return dumped(list(parts))


def _named(members: Column, name: str) -> Column:
    """The member of that name; null without one."""
    return F.get(F.filter(members, lambda m: m["name"] == name), F.lit(0))


def _first_fault(rules: list[tuple[Column, str]]) -> Column:
    """What the first rule says whose condition holds; null if none does."""
    out = F.lit(None).cast("string")
    for broken, said in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), said).otherwise(out)
    return out


#: By primitive: the kind that its criteria have, how many there may be, whether they may be left out, and what is said of others. Fixed values.
CRITERIA = {
    "choice": ("object", 1, 255, False, "a choice needs 1 to 255 options"),
    "score": ("array", 2, 10, False, "a score needs 2 to 10 levels"),
    "noul": ("object", 0, 2, True, "criteria of a yes/no question are true and false"),
}
_FIELDS = ("type", "instructions", "criteria")


def _leaf_fault(leaf: Column) -> Column:
    """What is wrong with a typed leaf; null if nothing is."""
    criteria = _named(leaf["members"], "criteria")
    absent = criteria.isNull() | (criteria["kind"] == "null")
    rules = [(~leaf["label"].isin(*CRITERIA), "unknown type"), (F.exists(leaf["members"], lambda m: ~m["name"].isin(*_FIELDS)), "unexpected fields")]
    for primitive, (kind, least, most, optional, said) in CRITERIA.items():
        fits = (criteria["kind"] == kind) & F.size(criteria["entries"]).between(least, most)
        if primitive == "noul":
            fits = fits & F.forall(criteria["entries"], lambda e: e["name"].isin("true", "false"))
        rules.append(((leaf["label"] == primitive) & ~F.coalesce(fits | absent if optional else fits & ~absent, F.lit(False)), said))
    return F.concat(_first_fault(rules), F.lit(" at "), leaf["path"])


def _leaf_units(leaf: Column, state: Column) -> Column:
    """The units of a leaf without fault, each a struct; their texts are put together from canonical parts, keys in order."""
    criteria, null = _named(leaf["members"], "criteria"), F.lit("null")
    entries = F.coalesce(criteria["entries"], F.array().cast("array<struct<name: string, quoted: string, kind: string, json: string>>"))
    question = F.coalesce(_named(leaf["members"], "instructions")["json"], null)
    side = lambda name: F.coalesce(_named(entries, name)["json"], null)
    both = F.concat(F.lit('{"false":'), side("false"), F.lit(',"true":'), side("true"), F.lit("}"))
    option = lambda e: F.concat(F.lit('{"description":'), e["json"], F.lit(',"name":'), e["quoted"], F.lit("}"))
    level = lambda e: F.concat(F.lit('{"description":'), e["json"], F.lit("}"))

    def unit(place: Column, name: Column, field: str, said: Column) -> Column:
        payload = [F.lit(f'{{"{field}":'), said, F.lit(',"question":'), question, F.lit(',"state":'), state, F.lit("}")]
        message = F.concat_ws("\n", F.lit("STATE:"), state, F.lit("QUESTION:"), question, F.lit(f"{field.upper()}:"), said)
        readout = F.lit(int(field == "binary_criteria"))
        return F.struct(leaf["path"].alias("path"), leaf["label"].alias("primitive"), place.cast("int").alias("place"), name.alias("option"), readout.alias("readout"), F.concat(*payload).alias("payload"), message.alias("message"))

    choices = F.transform(entries, lambda e, i: unit(i, e["name"], "criterion", option(e)))
    levels = F.transform(entries, lambda e, i: unit(i, e["name"], "criterion", level(e)))
    return F.when(leaf["label"] == "choice", choices).when(leaf["label"] == "score", levels).otherwise(F.array(unit(F.lit(0), F.lit("true"), "binary_criteria", both)))


def compile_requests(requests: DataFrame, request: str = "request", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each request's units: `keep`, `model`, path (a JSON array), primitive, place, option, readout (1 for yes/no), payload and message; `error`.

    A unit is what one forward pass scores: an option of a choice, a level of a score, a yes/no question. `trees.outline` gives a request's
    parts in their order, which VARIANT would lose; the rules, and the texts, are expressions over them. A request that isn't valid has one
    row, with its first error and no unit. Requests of any number are compiled where they lie. Null request: as no JSON.
    """
    rows = requests.select(*keep, outline(F.col(request), F.lit("questions"), F.lit("type")).alias("o"))
    rows = rows.withColumns({x: _named(F.col("o.members"), x) for x in ("state", "questions", "model")})
    rows = rows.withColumn("faults", F.filter(F.transform("o.found", _leaf_fault), lambda x: x.isNotNull()))
    told = F.col("model").isNotNull()
    error = _first_fault([
        (F.col("o").isNull(), "no strict JSON"), ((F.col("o.kind") != "object") | F.col("state").isNull() | F.col("questions").isNull(), "a request has state and questions"),
        (~F.col("state.kind").isin("string", "object", "array"), "the state is a text, an object or an array"),
        (told & ((F.col("model.kind") != "string") | F.col("model.json").rlike(r'^"(\\[nrtfb]|\s)*"$')), "the model's name is empty"),
        (F.size("o.strays") > 0, "neither container nor question"),
    ])
    error = F.coalesce(error, F.get("faults", F.lit(0)), F.when(F.size("o.found") == 0, "no question"))
    name = F.when(told, F.get_json_object(F.concat(F.lit('{"m":'), F.col("model.json"), F.lit("}")), "$.m")).otherwise("default")
    units = F.flatten(F.transform("o.found", lambda leaf: _leaf_units(leaf, F.col("state.json"))))
    rows = rows.withColumn("error", error)
    rows = rows.select(*keep, F.when(F.col("error").isNull(), name).alias("model"), "error", F.when(F.col("error").isNull(), units).alias("units"))
    return rows.select(*keep, "model", "error", F.inline_outer("units"))


@F.udf(returnType=T.StringType(), useArrow=True)
def canonical(text: str):
    """The canonical text of a JSON value; null if it isn't strict JSON."""
    try:
        return dumped(parsed(text))
    except ValueError:
        return None


def request_hash(request: Column) -> Column:
    """The digest by which identical requests are found."""
    return F.sha2(canonical(request), 256)


@F.udf(returnType=LEAVES, useArrow=True)
def answer_leaves(text: str):
    """The leaves of an answer tree: objects with `noul`, `choice`, `score` or `probabilities`; null if the text is no JSON."""

    def walk(node, path):
        if isinstance(node, dict) and set(node) & {"noul", "choice", "score", "probabilities"}:
            yield {"path": _path(path), "leaf": dumped(node)}
        else:
            for key, child in node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ():
                yield from walk(child, (*path, key))

    try:
        return list(walk(parsed(text), ()))
    except ValueError:
        return None


@F.udf(returnType=T.StringType(), useArrow=True)
def _nested(leaves: list):
    def fill(node: dict):
        if None in node:
            return node[None]
        made = {k: fill(v) for k, v in node.items()}
        return [made[i] for i in sorted(made)] if made and all(isinstance(k, int) for k in made) else made

    root: dict = {}
    for leaf in leaves:
        at = root
        for part in json.loads(leaf["path"]):
            at = at.setdefault(part, {})
        at[None] = json.loads(leaf["leaf"])
    return dumped(fill(root))


def restore_trees(leaves: DataFrame, by: list[str]) -> DataFrame:
    """From leaves (`path`, `leaf`) back to one tree per group, as canonical JSON in `answers`."""
    return leaves.groupBy(*by).agg(_nested(F.collect_list(F.struct("path", "leaf"))).alias("answers"))


def leaf_decision(leaf: Column) -> Column:
    """What a leaf decides: its choice, true or false from 0.5 on, or the likeliest level, the first of equals."""
    noul = F.get_json_object(leaf, "$.noul").cast("double")
    levels = F.from_json(F.get_json_object(leaf, "$.probabilities"), "map<string,double>")
    best = F.array_sort(F.transform(F.map_entries(levels), lambda e: F.struct((-e["value"]).alias("p"), e["key"].cast("int").alias("level"))))[0]["level"]
    return F.coalesce(F.get_json_object(leaf, "$.choice"), F.when(noul.isNotNull(), F.when(noul >= 0.5, "true").otherwise("false")), best.cast("string"))


def tree_difference(left: DataFrame, right: DataFrame, by: list[str], column: str = "answers") -> DataFrame:
    """Two runs' answer trees leaf by leaf: paths that one side lacks, and the greatest difference of a probability (`path`, `side`, `difference`)."""
    flat = lambda df, side: df.select(*by, F.inline(answer_leaves(F.col(column)))).select(*by, "path", F.col("leaf").alias(side))
    both = flat(left, "l").join(flat(right, "r"), [*by, "path"], "full_outer")
    values = lambda c: F.coalesce(F.from_json(F.get_json_object(c, "$.probabilities"), "map<string,double>"), F.when(F.get_json_object(c, "$.noul").isNotNull(), F.create_map(F.lit("true"), F.get_json_object(c, "$.noul").cast("double"))))
    off = F.array_max(F.map_values(F.map_zip_with(values(F.col("l")), values(F.col("r")), lambda k, a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))))))
    side = F.when(F.col("r").isNull(), "left only").when(F.col("l").isNull(), "right only").otherwise("both")
    return both.select(*by, "path", side.alias("side"), F.when(side == "both", off).alias("difference"))


# --- flat schemas ----------------------------------------------------------------------------------------------------------------


def _fields(schema) -> dict[str, list]:
    """Choices by field of a schema {name: {"type": "boolean"} | {"type": "enum", "choices": [..]}}; ValueError for others."""
    if not isinstance(schema, dict) or not schema:
        raise ValueError("a schema is an object with fields")
    out = {}
    for name, spec in schema.items():
        if not name.strip() or not isinstance(spec, dict) or not isinstance(spec.get("description", ""), str):
            raise ValueError(f"no field: {name!r}")
        if spec.get("type") == "boolean":
            out[name] = [False, True]
            continue
        choices = spec.get("choices")
        if spec.get("type") != "enum" or not isinstance(choices, list) or not 2 <= len(choices) <= 255:
            raise ValueError(f"{name}: boolean, or enum of 2 to 255 choices")
        if any(not isinstance(c, str) or not c for c in choices) or len(set(choices)) != len(choices):
            raise ValueError(f"{name}: choices are different texts")
        out[name] = choices
    return out


@F.udf(returnType=T.StringType(), useArrow=True)
def schema_error(schema: str):
    """What is wrong with a schema; null if nothing is."""
    try:
        _fields(parsed(schema))
        return None
    except (ValueError, TypeError) as error:
        return str(error)


@F.udf(returnType=T.BooleanType(), useArrow=True)
def valid_answer(answer: str, schema: str):
    """Whether a text is strict JSON with exactly the schema's fields and one of each field's choices, true being no 1."""
    try:
        fields, said = _fields(parsed(schema)), parsed(answer)
    except (ValueError, TypeError):
        return False
    return isinstance(said, dict) and set(said) == set(fields) and all(any(type(said[f]) is type(c) and said[f] == c for c in cs) for f, cs in fields.items())


def natural_answer(said: Column, codes: list[str]) -> Column:
    """The code that a text is, but for white space around it; null if it is none."""
    bare = F.regexp_replace(said, r"^\s+|\s+$", "")
    return F.when(bare.isin(*codes), bare)


def detector_answers(text: Column, keys: list[str]) -> Column:
    """From {"key": {"noul": p}, ..} to a map of all `keys` with finite numbers; null if one lacks."""
    found = F.from_json(text, T.MapType(T.StringType(), T.StructType([T.StructField("noul", T.DoubleType())])))
    values = [F.element_at(found, F.lit(k))["noul"] for k in keys]
    ok = [v.isNotNull() & ~F.isnan(v) & (F.abs(v) != math.inf) for v in values]
    whole = ok[0]
    for x in ok[1:]:
        whole = whole & x
    return F.when(whole, F.create_map(*[x for k, v in zip(keys, values, strict=True) for x in (F.lit(k), v)]))


def option_code(place: Column) -> Column:
    """A letter for each option from 0 on: A to Z, AA to ZZ, AAA and so on."""
    letter = lambda n: F.char(65 + n % 26)
    two, three = place - 26, place - 26 - 26 * 26
    return F.when(place < 26, letter(place)).when(two < 26 * 26, F.concat(letter(F.floor(two / 26)), letter(two))).otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26)), letter(three)))


def flat_prompt(context: Column, field: Column, description: Column, choices: Column) -> Column:
    """The prompt of one field: context, question, lettered options as JSON."""
    lines = F.transform(choices, lambda c, i: F.concat(option_code(i), F.lit(": "), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)))
    return F.concat(F.lit("CONTEXT (data):\n"), context, F.lit('\n\nQuestion for "'), field, F.lit('": '), description, F.lit("\nOptions:\n"), F.array_join(lines, "\n"), F.lit("\nAnswer only the option code."))


def decoded_scores(shown: Column, probabilities: Column, canonical_: Column) -> Column:
    """Probabilities of options in the order shown, put into canonical order."""
    return F.transform(canonical_, lambda c: F.get(probabilities, (F.array_position(shown, c) - 1).cast("int")))


def answer_view(p: Column, reported: Column, options: Column, choice: Column) -> Column:
    """A remote answer checked: struct of `probabilities` (null unless they sum to 1, or nearly so in hundredths), `raw` sum, whether it was `normalised`, and `ok`.

    The choice must have the largest probability within 1e-6, and a reported mean level must fit the vector.
    """
    fixed, sum_ = P.cent_grid(p), P.total(p)
    normalised = F.abs(sum_ - 1) > 1e-6
    top = F.get(fixed, (F.array_position(options, choice) - 1).cast("int"))
    ok = fixed.isNotNull() & F.coalesce(top >= F.array_max(fixed) - 1e-6, choice.isNull()) & F.coalesce(P.mean_within(fixed, reported, normalised), reported.isNull())
    return F.struct(fixed.alias("probabilities"), sum_.alias("raw"), normalised.alias("normalised"), ok.alias("ok"))


def reference_pool(sets: DataFrame, by: list[str], question_type: str = "question_type", entry_type: str = "entry_type", p: str = "probabilities", label: str = "label", options: str = "options") -> DataFrame:
    """The mean of a question's reference sets: `status` (ok, tied, missing, incompatible), `label`, `probabilities`, `probabilistic`.

    A set is a vector, normalised as displayed ones are, or a label, which counts as certain. Any of another type, or that fits no
    option, makes its question incompatible.
    """
    sure = F.transform(options, lambda o: F.when(o == F.col(label), 1.0).otherwise(0.0))
    vector = F.when(F.col(p).isNotNull(), P.display_rounded(F.col(p))).when(F.array_contains(options, F.col(label)), sure)
    given = F.col(p).isNotNull() | F.col(label).isNotNull()
    rows = sets.withColumns({"vector": vector, "given": given, "bad": given & ((F.col(question_type) != F.col(entry_type)) | vector.isNull() | (F.size(vector) != F.size(options)))})
    each = rows.select(*by, options, "given", "bad", F.col(p).isNotNull().alias("soft"), F.posexplode_outer("vector").alias("i", "v"))
    means = each.groupBy(*by, "i").agg(F.avg("v").alias("v"), F.bool_or("bad").alias("bad"), F.bool_or("given").alias("given"), F.bool_or("soft").alias("soft"), F.first(options).alias(options))
    pooled = means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "v")))), lambda x: x["v"]).alias("mean"), F.bool_or("bad").alias("bad"), F.bool_or("given").alias("given"), F.bool_or("soft").alias("soft"), F.first(options).alias(options))
    winner = P.unique_winner(F.col("mean"))
    status = F.when(F.col("bad"), "incompatible").when(~F.col("given"), "missing").when(winner.isNull(), "tied").otherwise("ok")
    usable = status.isin("ok", "tied")
    return pooled.select(*by, status.alias("status"), F.when(status == "ok", F.get(options, winner)).alias("label"), F.when(usable, F.col("mean")).alias("probabilities"), (usable & F.col("soft")).alias("probabilistic"))


def _apart(left, right, at: str) -> set[str]:
    """Paths below `at` where two JSON values differ; lists of unlike lengths and values of unlike kinds differ as a whole."""
    if type(left) is not type(right):
        return {at}
    if isinstance(left, dict):
        shared = left.keys() & right.keys()
        return {f"{at}.{k}" for k in left.keys() ^ right.keys()}.union(*[_apart(left[k], right[k], f"{at}.{k}") for k in shared])
    if isinstance(left, list) and len(left) == len(right):
        return set().union(*[_apart(a, b, f"{at}[{i}]") for i, (a, b) in enumerate(zip(left, right, strict=True))])
    return set() if left == right else {at}


@F.udf(returnType=T.ArrayType(T.StringType()), useArrow=True)
def changed_paths(left: str, right: str):
    """Where two JSON records differ, as sorted paths from `record`; null if one isn't strict JSON."""
    try:
        return sorted(_apart(parsed(left), parsed(right), "record"))
    except ValueError:
        return None
