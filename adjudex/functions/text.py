"""Scalar functions of texts and keys, as columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = r"[\p{L}\p{N}_]+"


def digest(x: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hexadecimal."""
    return F.sha2(x, 256)


def hash_unit(x: Column, digits: int = 16) -> Column:
    """A number in [0, 1) from the first `digits` hexadecimal digits of the digest."""
    return F.conv(F.substring(digest(x), 1, digits), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(16**digits))


def squeezed(x: Column) -> Column:
    """Lower-cased with runs of white space as one space: what built-ins can do of `normalised`."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


@F.pandas_udf(T.StringType())
def normalised(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, case-folded, white space squeezed. Neither folding nor NFKC is a built-in."""
    for s in batches:
        yield s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def text_key(normal: Column) -> Column:
    return F.concat(F.lit("text:"), digest(normal))


def wordbag_key(normal: Column) -> Column:
    """Digest of the sorted words, repeats kept."""
    return F.concat(F.lit("wordbag:"), digest(F.array_join(F.array_sort(F.regexp_extract_all(normal, F.lit(WORDS), F.lit(0))), " ")))


def count_words(x: Column) -> Column:
    return F.coalesce(F.regexp_count(x, F.lit(r"\S+")), F.lit(0))


def plain_newlines(x: Column) -> Column:
    return F.regexp_replace(x, r"\r\n?", "\n")


def split_blocks(x: Column) -> Column:
    """Parts between blank lines, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(x, r"\r?\n\s*\r?\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")


def truncated(x: Column, most: int) -> Column:
    """Cut at `most` characters, back to the last space if that lies beyond four fifths."""
    cut = F.substring(x, 1, most)
    last = F.length(cut) - F.locate(" ", F.reverse(cut))
    return F.when(F.length(x) <= most, x).when((F.locate(" ", cut) > 0) & (last > most * 0.8), cut.substr(F.lit(1), last.cast("int"))).otherwise(cut)


def without_markdown(x: Column) -> Column:
    """Bold marks, headings to the fourth level, bullets and numbers of lists go, from texts that have any of the first three."""
    bare = F.regexp_replace(F.regexp_replace(x, r"\*\*(.+?)\*\*", "$1"), r"(?m)^#{1,4} +", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?m)^[-*] +", ""), r"(?m)^[0-9]+\. +", "")
    return F.when(x.rlike(r"(?m)\*\*|^#{1,4} |^[-*] "), bare).otherwise(x)


def slug(x: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)


# Named references in the order in which they are decoded, parts of pages without prose, and what no paragraph has.
NAMED = (("nbsp", " "), ("ndash", "–"), ("mdash", "—"), ("rsquo", "’"), ("lsquo", "‘"), ("rdquo", "”"), ("ldquo", "“"), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"))
NO_PROSE = (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?is)<sup[^>]*>.*?</sup>", r"(?is)<table.*?</table>", r"(?is)<nav.*?</nav>", r"(?is)<header.*?</header>", r"(?is)<footer.*?</footer>")
JUNK = r"(?i)Jump to navigation|Jump to search|Wayback Machine has not archived|cookie"


def _numeric(x: Column, pattern: str, base: int) -> Column:
    """Numeric references as their characters; those beyond Unicode stay."""

    def said(digits: Column) -> Column:
        point = F.conv(digits, base, 10).cast("decimal(20,0)")
        return F.when(point <= 0x10FFFF, F.decode(F.unhex(F.lpad(F.conv(digits, base, 16), 8, "0")), "UTF-32"))

    pieces = F.zip_with(F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), lambda gap, d: F.when(d.isNull(), gap).otherwise(F.concat(gap, F.coalesce(said(d), F.concat(F.lit("&#x" if base == 16 else "&#"), d, F.lit(";"))))))
    return F.when(x.contains("&#"), F.array_join(pieces, "")).otherwise(x)


def decoded(x: Column) -> Column:
    """Character references decoded: hexadecimal, decimal, then named ones in order, so that `&amp;lt;` becomes `<`."""
    out = _numeric(_numeric(x, "&#x([0-9a-fA-F]+);", 16), "&#([0-9]+);", 10)
    for name, said in NAMED:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(said))
    return out


def cleaned(x: Column) -> Column:
    """A paragraph without citation and edit marks and rests of templates; blanks and newlines squeezed, ends trimmed."""
    for mark in (r"\[[0-9]+\]", r"(?i)\[citation needed\]", r"(?i)\[edit\]", r"Template:[A-Za-z0-9_\-]+"):
        x = F.regexp_replace(x, mark, "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r" *\n *", "\n"), r"^\s+|\s+$", "")


def is_junk(x: Column) -> Column:
    """No paragraph of prose: null, under 20 characters, boilerplate, or markup."""
    return F.coalesce((F.length(x) < 20) | x.rlike(JUNK) | x.contains("{") | x.contains("Template:"), F.lit(True))


def paragraphs(html: Column) -> Column:
    """Bodies of <p>, without scripts, tables, notes and page furniture: tags dropped, references decoded, then cleaned; empty ones left out."""
    for part in NO_PROSE:
        html = F.regexp_replace(html, part, "")
    found = F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(found, lambda p: cleaned(decoded(F.regexp_replace(p, "<[^>]+>", "")))), lambda p: p != "")


def assembled(paragraphs_: Column, least: int = 150, most: int = 400, skip: int = 0) -> Column:
    """Paragraphs that are no junk, in order, until the next would pass `most` words and `least` are reached; struct of text and words, null under `least` words."""
    good = F.filter(paragraphs_, lambda p: ~is_junk(p))
    good = F.slice(good, skip + 1, F.greatest(F.size(good) - skip, F.lit(0))) if skip else good

    def add(s: Column, p: Column) -> Column:
        w = count_words(p)
        stop = s["stop"] | ((s["words"] + w > most) & (s["words"] >= least)) | (s["words"] >= most)
        return F.when(stop, F.struct(s["text"].alias("text"), s["words"].alias("words"), F.lit(True).alias("stop"))).otherwise(
            F.struct(F.concat(s["text"], F.array(p)).alias("text"), (s["words"] + w).alias("words"), F.lit(False).alias("stop")))

    start = F.struct(F.expr("cast(array() as array<string>)").alias("text"), F.lit(0).alias("words"), F.lit(False).alias("stop"))
    done = lambda s: F.when(s["words"] >= least, F.struct(F.array_join(s["text"], "\n\n").alias("text"), s["words"].alias("words")))
    return F.aggregate(good, start, add, done)


def verdict(said: Column) -> Column:
    """The last VERDICT: YES or NO, in capitals; null if there is none."""
    found = F.regexp_extract_all(said, F.lit(r"(?i)VERDICT:\s*(YES|NO)"), F.lit(1))
    return F.when(F.size(found) > 0, F.upper(F.element_at(found, -1)))


def human_source(file: Column) -> Column:
    """Where a human text comes from: what stands before the first - of its file name, else the name without .txt."""
    return F.when(F.contains(file, F.lit("-")), F.substring_index(file, "-", 1)).otherwise(F.regexp_replace(file, r"(?i)\.txt$", ""))


def rule_blocks(x: Column, starts: str = r"^rule( |<|$)", ends: str = r"^(syntax|endmodule|module|configuration)|^$") -> Column:
    """Blocks of lines of a text without its `/* */` and `//` comments: each begins at a line that `starts`, trimmed, and goes on to the next such line or one that `ends`.

    Null text gives null, a text without such lines an empty list.
    """
    bare = F.regexp_replace(F.regexp_replace(x, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    none = F.lit(None).cast("string")

    def step(state: Column, line: Column) -> Column:
        said = F.trim(line)
        begins, open_ = said.rlike(starts), state["open"]
        closed = F.when(open_.isNotNull() & (begins | said.rlike(ends)), F.concat(state["done"], F.array(open_))).otherwise(state["done"])
        now = F.when(begins, line).when(open_.isNull() | said.rlike(ends), none).otherwise(F.concat(open_, F.lit("\n"), line))
        return F.struct(closed.alias("done"), now.alias("open"))

    nothing = F.struct(F.array().cast("array<string>").alias("done"), none.alias("open"))
    return F.aggregate(F.split(bare, "\n"), nothing, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


#: Operators with a rule of one line each. Fixed values.
ATOMIC_OPERATORS = ("<=", "==", "&&", "||", "+", "-", "*", "/", "%", "<", "!")


def relevant_rules(blocks: Column, program: Column) -> Column:
    """Of rule blocks those that `program` may need: rules of one operator, short and without a cell, go if the program has none of theirs."""

    def needed(block: Column) -> Column:
        head = F.substring_index(block, "=>", 1)
        named = {o: head.rlike(r"(?<![A-Za-z0-9_])\Q" + o + r"\E(?![A-Za-z0-9_=])") for o in ATOMIC_OPERATORS}
        any_of = lambda tests: F.exists(F.array(*tests), lambda t: t)
        single = ~F.contains(head, F.lit("<k>")) & (count_words(head) <= 5) & any_of(named.values())
        return ~single | any_of([named[o] & F.contains(program, F.lit(o)) for o in ATOMIC_OPERATORS])

    return F.filter(blocks, needed)
