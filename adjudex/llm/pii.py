"""Personal data replaced by keyed surrogates of the same type and format, coreferent mentions alike, in DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, table

# Titles by gender, syllables by script.
MEN = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Signor", "Господин", "Κύριος")
#: These tell no gender, so a given name after them has no ending.
EITHER = ("Dr", "Prof", "Doctor", "Professor")
#: After these two names or more are a person, of no known gender.
CUES = ("my name is", "name", "contact", "contact person", "author", "signed", "regards", "best regards", "kind regards", "sincerely", "yours sincerely")
WOMEN = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Signora", "Госпожа", "Κυρία")
#: What characters change places with, in addresses, numbers and names. Those beyond ASCII that stand in no class do so with Han, Hangul, or the sixteen of their own block.
WORDS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ")
#: The same in secrets: hexadecimal digits stay hexadecimal.
SECRETS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")
#: First and last code points of Han and Hangul.
WIDE = ((0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
#: Ends of names by gender: man, woman, neither. None is the end of another, so a name is known by what stands before its end.
ENDINGS = {"latin": ("an", "ina", "el"), "cyrillic": ("ан", "ина", "ел"), "greek": ("αν", "ινα", "ελ")}

#: Country calling codes: 1 and 7, those of two digits, all others of three.
CALLING_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

_TITLES = "|".join(sorted((*MEN, *WOMEN, *EITHER), key=len, reverse=True))
_CUES = "|".join(sorted(CUES, key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_NAME = r"\p{Lu}[\p{L}'’-]++(?![\p{N}_@])"
#: What stands before a person's names: a title, or a cue.
_LEAD = rf"(?:(?:{_TITLES})\.? |(?i:{_CUES})(?: ?[:,]| is)?\s{{1,3}}(?=\p{{Lu}}[\p{{L}}'’-]++ \p{{Lu}}))"
TYPES = {
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-][\p{L}\p{N}.-]*\.\p{L}\p{L}++",
    "secret": r"(?i:(?:token|secret|api_?key|password|passwd|pwd)\s{0,3}[=:]\s{0,3})[\"']?[A-Za-z0-9_+/-]{12,}",
    "key": r"AKIA[0-9A-Z]{16}(?!\w)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\w)])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\w.-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?![\w-])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "person": rf"{_LEAD}{_NAME}(?: {_NAME}){{0,2}}",
}
#: Every entity but a secret begins where no letter or digit stands before it, so most places fail at once; a secret's name may have any prefix, which stays as it is.
PATTERN = rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(v for k, v in TYPES.items() if k != 'secret')})|{TYPES['secret']}"
#: A word that may be a name standing alone.
ALONE = r"(?<![\p{L}\p{N}_@.])\p{Lu}[\p{L}'’-]++(?![\p{N}_@])"
_OWNED = r"['’]s$"


def _let(value: Column, then) -> Column:
    """`then` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-256 of a text, as 64 hexadecimal digits."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytearray(x ^ 0x36 for x in raw)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(x ^ 0x5C for x in raw)), F.unhex(inner)), 256)


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _code(size: int | Column, base: int | Column, at: Column) -> Column:
    """A place `at` in a class of `size` that begins at `base`; of size 0 what stays as it is."""
    as_int = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("int")
    return F.struct(as_int(size).alias("size"), as_int(base).alias("base"), as_int(at).alias("at"))


def _codes(value: Column, classes: tuple[str, ...]) -> Column:
    """The characters of a text as places in their classes."""
    table_ = "".join(classes)

    def one(x: Column) -> Column:
        at, point, found, start = x["at"], x["point"], None, 0
        for c in classes:
            here = at.between(start + 1, start + len(c))
            found = (F if found is None else found).when(here, _code(len(c), start, at - 1 - start))
            start += len(c)
        for low, high in WIDE:
            found = found.when(point.between(low, high), _code(high - low + 1, -low, point - low))
        block = (point >= 0x100) & (point < 0xD800) & ~point.between(0x2000, 0x206F) | point.between(0xE000, 0xFFFF)
        return found.when(block, _code(16, -(point - point % 16), point % 16)).otherwise(_code(0, 0, F.lit(0)))

    return F.transform(F.split(value, ""), lambda c: _let(F.struct(F.position(c, F.lit(table_)).alias("at"), F.ascii(c).alias("point")), one))


def _characters(value: Column, codes: Column, classes: tuple[str, ...]) -> Column:
    """The text that changed codes of `value` stand for."""
    table_ = F.lit("".join(classes))

    def one(c: Column, x: Column) -> Column:
        wide = F.decode(F.unhex(F.lpad(F.hex((x["at"] - x["base"]).cast("long")), 4, "0")), "UTF-16BE")
        return F.when(x["size"] == 0, c).when(x["base"] < 0, wide).otherwise(F.substring(table_, x["base"] + x["at"] + 1, F.lit(1)))

    return F.array_join(F.zip_with(F.split(value, ""), codes, one), "")


def _octets(value: Column) -> Column:
    """An address's four numbers as codes: what may begin or end an address of a host stays so."""

    def one(c: Column, i: Column) -> Column:
        n = c.cast("int")
        first, last = (i == 0) & n.between(1, 223), (i == 3) & n.between(1, 254)
        found = F.when(first, _code(223, 1, n - 1)).when(last, _code(254, 1, n - 1))
        found = found.when(i == 0, _code(33, 223, F.greatest(n - 223, F.lit(0)))).when(i == 3, _code(2, 254, F.greatest(n - 254, F.lit(0))))
        return found.otherwise(_code(256, 0, n))

    return F.transform(F.split(value, r"\."), one)


def _address(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda x: F.when((x["base"] > 1) & (x["at"] == 0), 0).otherwise(x["base"] + x["at"]).cast("string")), ".")


def permuted(codes: Column, key: str, label: Column) -> Column:
    """Another text of the same classes: a keyed permutation, without fixed points, of all texts that have them.

    A round of an unbalanced Feistel network moves every second place within its class, by amounts that follow from the others by HMAC.
    Three rounds, one step of the first place within its class, and the rounds undone make a permutation that leaves no text as it is.
    """

    def turned(x: Column, n: Column, sign: Column) -> Column:
        others = F.array_join(F.transform(x, lambda c, i: F.when(i % 2 != n % 2, c["at"].cast("string")).otherwise("")), ",")
        amount = lambda h, i: F.conv(F.substring(h, F.floor(i / 2).cast("int") % 16 * 4 + 1, F.lit(4)), 16, 10).cast("int")
        moved = lambda h, c, i: F.when((i % 2 == n % 2) & (c["size"] > 0), _code(c["size"], c["base"], F.pmod(c["at"] + sign * amount(h, i), c["size"]))).otherwise(c)
        return _let(_hmac(key, F.concat_ws("|", n.cast("string"), label, others)), lambda h: F.transform(x, lambda c, i: moved(h, c, i)))

    def stepped(x: Column) -> Column:
        first = F.array_position(F.transform(x, lambda c: c["size"] > 0), True)
        return _let(first, lambda p: F.transform(x, lambda c, i: F.when(i + 1 == p, _code(c["size"], c["base"], (c["at"] + 1) % c["size"])).otherwise(c)))

    steps = [(0, 1), (1, 1), (2, 1), (0, 0), (2, -1), (1, -1), (0, -1)]
    rounds = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(sign).alias("sign")) for n, sign in steps])
    return F.aggregate(rounds, codes, lambda x, r: F.when(r["sign"] == 0, stepped(x)).otherwise(turned(x, r["n"], r["sign"])))


def _filled(value: Column, digits: Column) -> Column:
    """`value` with its digits, from the right, replaced by those of `digits`."""
    n, of = F.length(_only_digits(value)), lambda x: F.length(_only_digits(x))
    skip = F.length(digits) - n
    one = lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(digits, skip + of(F.substring(value, F.lit(1), i + 1)), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _cased(value: Column, made: Column) -> Column:
    """`made` with capitals where `value` has them."""
    chars = F.zip_with(F.split(made, ""), F.split(value, ""), lambda m, c: F.when(c.rlike(r"^\p{Lu}$"), F.upper(m)).otherwise(m))
    return F.when(F.length(made) == F.length(value), F.array_join(chars, "")).otherwise(made)


def _luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn check over digits that stand before the check digit."""
    doubled = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b)


def _payload(value: Column) -> tuple[Column, Column]:
    digits = _only_digits(value)
    return digits.substr(F.lit(1), F.length(digits) - 1), digits.substr(F.length(digits), F.lit(1)).cast("int")


def _of_script(name: Column, of: dict[str, Column]) -> Column:
    return F.when(name.rlike(r"^\p{IsCyrillic}"), of["cyrillic"]).when(name.rlike(r"^\p{IsGreek}"), of["greek"]).otherwise(of["latin"])


def kind_of(value: Column) -> Column:
    """The type of an entity; null for a number that is no card by its check digit."""
    payload, check = _payload(value)
    card = (_luhn_sum(payload) + check) % 10 == 0
    found = F.when(value.rlike(rf"^{_LEAD}\p{{Lu}}"), "person")
    found = found.when(value.contains("@"), "email").when(value.rlike(r"^AKIA[0-9A-Z]{16}$"), "key").when(value.rlike(r"[=:]"), "secret")
    found = found.when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(value.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), "ip")
    return found.when(value.rlike(r"^(\+|\()|^\d{3}-\d{3}-\d{4}$"), "phone").when(card, "card")


def _secret_lead(value: Column) -> Column:
    return F.regexp_extract(value, r"^[^=:]*[=:]\s*[\"']?", 0)


def _person_lead(value: Column) -> Column:
    return F.regexp_extract(value, rf"^{_LEAD}", 0)


def _after(value: Column, lead: Column) -> Column:
    return value.substr(F.length(lead) + 1, F.length(value))


def _name_norm(name: Column) -> Column:
    return F.concat(F.lit("name|"), F.lower(F.regexp_replace(name, _OWNED, "")))


def _names(value: Column) -> Column:
    return F.split(_after(value, _person_lead(value)), " ")


def norms(value: Column) -> Column:
    """The normal forms of an entity, each led by its type: of a person one for each name, of others one. All spellings of one entity share them.

    E-mail addresses in lower case; cards, phones and social security numbers by their digits, a phone with its calling code unless
    that is 1; secrets without the name before them; names without title and possessive, in lower case. No entity: none.
    """

    def of(kind: Column) -> Column:
        code = F.regexp_extract(value, CALLING_CODE, 0)
        number = _only_digits(_after(value, code))
        phone = F.when(code.isin("", "+1"), number).otherwise(F.concat(F.substring(code, 2, 3), F.lit(":"), number))
        one = F.when(kind == "email", F.lower(value)).when(kind == "secret", _after(value, _secret_lead(value))).when(kind == "phone", phone)
        one = one.when(kind.isin("card", "ssn"), _only_digits(value)).when(kind == "ip", F.array_join(F.transform(F.split(value, r"\."), lambda c: c.cast("int").cast("string")), ".")).otherwise(value)
        return F.when(kind == "person", F.transform(_names(value), _name_norm)).when(kind.isNotNull(), F.array(F.concat(kind, F.lit("|"), one))).otherwise(F.array().cast("array<string>"))

    return _let(kind_of(value), of)


def canonical(norm: Column, key: str) -> Column:
    """What stands for a normal form, as a normal form of the same type, format and length: a permutation of these, see `permuted`.

    Kept are an e-mail address's last label, a phone's calling code, a card's first digit, `AKIA` of a key; a card's check digit follows.
    """

    def parts(kind: Column, value: Column) -> Column:
        n = F.length(value)
        head = F.when(kind == "key", "AKIA").when(kind == "phone", F.regexp_extract(value, r"^\d+:", 0)).when(kind == "card", F.substring(value, 1, 1)).otherwise("")
        tail = F.when(kind == "email", F.regexp_extract(value, r"\.\p{L}++$", 0)).when(kind == "card", value.substr(n, F.lit(1))).otherwise("")
        return F.struct(kind.alias("kind"), value.alias("value"), head.alias("head"), tail.alias("tail"))

    def made(x: Column) -> Column:
        kind, body = x["kind"], x["value"].substr(F.length(x["head"]) + 1, F.length(x["value"]) - F.length(x["head"]) - F.length(x["tail"]))
        letters = kind.isin("secret", "key")
        codes = F.when(kind == "ip", _octets(body)).when(letters, _codes(body, SECRETS)).otherwise(_codes(body, WORDS))
        text = lambda c: F.when(kind == "ip", _address(c)).when(letters, _characters(body, c, SECRETS)).otherwise(_characters(body, c, WORDS))
        check = lambda payload: F.concat(payload, F.when(kind == "card", ((10 - _luhn_sum(payload) % 10) % 10).cast("string")).otherwise(x["tail"]))
        return F.concat(kind, F.lit("|"), _let(F.concat(x["head"], _let(permuted(codes, key, kind), text)), check))

    kind = F.substring_index(norm, "|", 1)
    return _let(parts(kind, _after(norm, F.concat(kind, F.lit("|")))), made)


def _bare(made: Column) -> Column:
    return F.regexp_replace(made, r"(?s)^[^|]*\|", "")


def _name(name: Column, ending: Column, stand) -> Column:
    """A name's surrogate with the ending of a gender ('m', 'w' or ''), in capitals if the name is, with its possessive."""
    ends = lambda k: _of_script(name, {s: F.lit(x[k]) for s, x in ENDINGS.items()})
    made = F.concat(_bare(stand(_name_norm(name))), F.when(ending == "m", ends(0)).when(ending == "w", ends(1)).otherwise(ends(2)))
    bare = F.regexp_replace(name, _OWNED, "")
    return F.concat(F.when(bare.rlike(r"^\p{Lu}{2,}$"), F.upper(made)).otherwise(F.initcap(made)), F.regexp_extract(name, _OWNED, 0))


def _given(value: Column) -> Column:
    """The names of a person as structs (`name`, `ending`): a given name, which is one that others follow, has its title's gender."""
    title = F.regexp_replace(_person_lead(value), r"\.? $", "")
    gender = F.when(title.isin(*MEN), "m").when(title.isin(*WOMEN), "w").otherwise("")
    return _let(_names(value), lambda names: F.transform(names, lambda n, i: F.struct(n.alias("name"), F.when((i == 0) & (F.size(names) > 1), gender).otherwise("").alias("ending"))))


def surrogate(value: Column, stand) -> Column:
    """What is written for an entity; `stand` gives the normal form that stands for one. No entity: the value itself."""

    def of(kind: Column) -> Column:
        one = _let(F.get(norms(value), F.lit(0)), lambda n: _bare(stand(n)))
        code = F.regexp_extract(value, CALLING_CODE, 0)
        lead = _secret_lead(value)
        person = F.concat(_person_lead(value), F.array_join(F.transform(_given(value), lambda n: _name(n["name"], n["ending"], stand)), " "))
        said = F.when(kind == "person", person).when(kind == "email", _cased(value, one)).when(kind == "secret", F.concat(lead, one))
        said = said.when(kind == "phone", F.concat(code, _let(F.regexp_replace(one, r"^\d+:", ""), lambda d: _filled(_after(value, code), d))))
        return said.when(kind.isin("card", "ssn"), _let(one, lambda d: _filled(value, d))).when(kind.isNotNull(), one).otherwise(value)

    return _let(kind_of(value), of)


def clashes(found: DataFrame, key: str) -> DataFrame:
    """Of distinct normal forms (`norm`), those that share a surrogate or have themselves as one: `made`, `n`. A check; there are none."""
    made = found.select("norm", canonical(F.col("norm"), key).alias("made"))
    return made.groupBy("made").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("made") == F.col("norm")).cast("int")).alias("same")).filter("n > 1 or same = 1").drop("same")


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with every entity in `text` replaced, and `n_entities`.

    Types: e-mail, phone, IP address, payment card with a right check digit, US social security number, cloud key, secret after
    token= and the like (whatever stands before that name), person after a title or a cue such as "my name is". A surrogate follows
    from `key`, by HMAC, and from type and normal form alone (`norms`), so that an entity has the same one everywhere and in all its
    spellings, each of which keeps its own format, script and case. A person's names have a surrogate each; a given name carries the
    title's gender. Names found so are also replaced where they stand alone in the same text, but for those of under three letters
    and those that the text also has in lower case.

    Distinct normal forms have distinct surrogates, by permutation rather than by comparing (`permuted`, checked by `clashes`), so no
    row meets another and no text is shuffled. A surrogate may be another's original where a format has few members; that one has a
    surrogate itself. Letters and digits without a class, from the astral planes, stay. Keep `key` secret: who has it can undo
    everything. It stands in the plan, as literals do.

    Null text: stays null, n_entities 0. Empty text: empty. Repeated rows: each replaced alike. Other columns pass through, but a
    column n_entities is replaced. Empty table: empty.
    """
    if not key:
        raise ValueError("the key is empty")
    kept = [c for c in docs.columns if c.lower() != "n_entities"]
    found, names = (free_name(docs, c) for c in ("found", "names"))
    t = F.col(f"`{text}`")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)).alias(found))
    stand = lambda n: canonical(n, key)

    persons = F.filter(found, lambda e: e.rlike(rf"^{_LEAD}\p{{Lu}}"))
    short = lambda n: F.regexp_replace(n["name"], _OWNED, "")
    in_lower = lambda n: F.regexp_like(t, F.concat(F.lit(r"(?<!\p{L})"), F.lower(short(n)), F.lit(r"(?!\p{L})")))
    rows = rows.withColumn(names, F.when(F.size(persons) > 0, F.filter(F.flatten(F.transform(persons, _given)), lambda n: (F.length(short(n)) > 2) & ~in_lower(n))))

    def alone(word: Column) -> Column:
        same = F.get(F.filter(names, lambda n: _name_norm(n["name"]) == _name_norm(word)), F.lit(0))
        return _let(same, lambda n: F.when(n.isNull(), word).otherwise(_name(word, n["ending"], stand)))

    def without_names(gap: Column) -> Column:
        words = F.zip_with(F.split(gap, ALONE, -1), F.regexp_extract_all(gap, F.lit(ALONE), F.lit(0)), lambda g, w: F.when(w.isNull(), g).otherwise(F.concat(g, alone(w))))
        return F.when(F.size(F.col(names)) > 0, F.array_join(words, "")).otherwise(gap)

    pieces = F.zip_with(F.split(t, PATTERN, -1), F.col(found), lambda gap, e: _let(without_names(gap), lambda g: F.when(e.isNull(), g).otherwise(F.concat(g, surrogate(e, stand)))))
    swapped = F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(t)
    count = F.coalesce(F.size(F.filter(found, lambda e: kind_of(e).isNotNull())), F.lit(0))
    return rows.select(*[swapped.alias(c) if c == text else F.col(f"`{c}`") for c in kept], F.greatest(count, F.lit(0)).cast("long").alias("n_entities"))


#: Stands in, in the query, for a key that its users keep to themselves.
QUERY_KEY = "key of the query, no secret"


def op5_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
