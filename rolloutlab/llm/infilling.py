"""Fill-in-the-middle by lookaround splitting.

A unit grammar names classes of code points and which of them go on with a
unit: between a left and a right neighbour that do not, a unit ends. That
becomes a zero-width regex of a lookbehind and a lookahead, at which Spark's
``split`` cuts a text without losing a character. Prefix, middle and suffix
are runs of units.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All code points. The halves of those beyond 16 bits are in no class, so that none is taken for a neighbour.
ANY = r"\x{0}-\x{D7FF}\x{E000}-\x{10FFFF}"
SPACES = r" \t-\r"


@dataclass(frozen=True)
class Grammar:
    """Disjoint classes (contents of a regex class) that cover all code points, and the pairs (left, right) that stay in one unit."""

    classes: Mapping[str, str]
    goes_on: frozenset[tuple[str, str]]

    def boundary(self) -> str:
        """The regex that matches, with no width, between two code points where a unit ends and the next begins.

        A lookbehind counts 16-bit halves, so it is let back one or two.
        """
        ends = []
        for left, inside in self.classes.items():
            begun = [c for right, c in self.classes.items() if (left, right) not in self.goes_on]
            if begun:
                ends.append(f"(?<=[{inside}]{{1,2}})(?=[{begun[0] if len(begun) == 1 else ''.join(f'[{c}]' for c in begun)}])")
        if not ends:
            raise ValueError("in this grammar a unit never ends")
        return "|".join(ends)


def _except(inside: str) -> str:
    return f"{ANY}&&[^{inside}]"


#: Code points; lines with the line feed that ends them; words with the white space before them; runs of letters, of digits, of white space and single other code points.
GRAMMARS = {
    "code_point": Grammar({"any": ANY}, frozenset()),
    "line": Grammar({"feed": r"\n", "other": _except(r"\n")}, frozenset({("other", "other"), ("other", "feed")})),
    "word": Grammar({"space": SPACES, "other": _except(SPACES)}, frozenset({("space", "space"), ("space", "other"), ("other", "other")})),
    "run": Grammar({"letter": r"\p{L}\p{M}", "digit": r"\p{Nd}", "space": SPACES, "other": _except(rf"\p{{L}}\p{{M}}\p{{Nd}}{SPACES}")},
                   frozenset({("letter", "letter"), ("digit", "digit"), ("space", "space")})),
}


def units(text: Column, grammar: Grammar) -> Column:
    """The units of a text in order, which joined are the text; none of an empty or null one."""
    return F.when(F.char_length(text) > 0, F.split(text, grammar.boundary(), -1)).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Marks:
    """What stands before prefix, suffix and middle in a rearranged text."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def regex(self) -> str:
        return "|".join(rf"\Q{m}\E" for m in (self.prefix, self.suffix, self.middle))


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text from output and form alone.

    A form other than plain tells that the text holds no mark, so that the
    marks cut the output into an empty piece and the three parts.
    """
    def joined(p: Column) -> Column:
        return F.when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1]))

    # inside a lambda the output is split once, not at each use of a part
    moved = F.transform(F.array(F.split(output, marks.regex(), -1)), joined)[0]
    return F.when(form == "plain", output).otherwise(moved)


def draws(key: Column, seed: str, n: int = 4) -> list[Column]:
    """n (up to 8) longs from 0 to 2^32 - 1: the 32-bit groups of the sha256 of seed, colon and key; of a null key, of what comes before it."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def fill_in_middle(docs: DataFrame, grammar: str | Grammar = "code_point", rate: int = 90, spm_rate: int = 20, seed: str = "1", marks: Marks = Marks(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n (its units), form, prefix_units, middle_units, output.

    Two draws by key set the ends of prefix and middle among the n + 1 places
    between units. ``rate`` % of the texts are rearranged, of them ``spm_rate``
    % with the suffix first (``spm``), the others with the prefix first
    (``psm``). Empty and null texts and those that hold a mark are ``plain``:
    the output is the text (null: empty), prefix_units and middle_units are
    null. Null keys are drawn like an empty key; repeated rows stay rows and
    share a fate; extra columns are left out; an empty input gives no rows. A
    text is handled whole, in about a hundred bytes of memory a unit; nothing
    is shuffled.
    """
    grammar = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), whole.alias("text"), F.array(*draws(F.col(key), seed)).alias("h"))
    marked = F.lit(False)
    for m in (marks.prefix, marks.suffix, marks.middle):
        marked = marked | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | marked | (F.col("h")[2] % 100 >= rate), "plain").when(F.col("h")[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "h", form.alias("form"), units(F.col("text"), grammar).alias("units"))
    n = F.size("units").cast("long")
    first, second = F.col("h")[0] % (n + 1), F.col("h")[1] % (n + 1)
    rows = rows.select("doc_id", "text", "form", "units", n.alias("n"), F.least(first, second).cast("int").alias("begin"), F.greatest(first, second).cast("int").alias("end"))

    def joined(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("units", start + 1, length), "")

    prefix, middle, suffix = joined(F.lit(0), F.col("begin")), joined(F.col("begin"), F.col("end") - F.col("begin")), joined(F.col("end"), (F.col("n") - F.col("end")).cast("int"))
    p, s, m = F.concat(F.lit(marks.prefix), prefix), F.concat(F.lit(marks.suffix), suffix), F.concat(F.lit(marks.middle), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, s, m)).otherwise(F.concat(s, p, m))
    moved = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(moved, F.col("begin").cast("long")).alias("prefix_units"),
                       F.when(moved, (F.col("end") - F.col("begin")).cast("long")).alias("middle_units"), output.alias("output"))


def infilled_digests(docs: DataFrame) -> DataFrame:
    """fill_in_middle over code points, with digests of the output and of the text rebuilt from output and form."""
    out = fill_in_middle(docs, "code_point")
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
                      F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
