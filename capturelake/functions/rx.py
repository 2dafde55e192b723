"""Regex and expression helpers shared by every module.

Patterns are always compiled in Java's Unicode mode, so word boundaries,
whitespace, digits and case folding see all letters and not only ASCII.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def head(c: ColumnOrName, n: int | None) -> Column:
    """The first ``n`` characters, or the whole text without ``n``."""
    return as_col(c) if n is None else F.substring(as_col(c), 1, n)


# letters outside ASCII that Java's Unicode folding holds equal to an ASCII one
FOLDS = {"s": "\u017f", "k": "\u212a", "i": "\u0130\u0131"}
KANA_HAN = "\u3000-\u9fff"


def _letters(c: str, ci: bool) -> str | None:
    """A character class's content that holds a letter and what folds to it; null for what is no plain letter."""
    if "\u3041" <= c <= "\u9fff":
        return KANA_HAN
    if not (c.isascii() and c.isalnum()):
        return None
    return c.lower() + c.upper() + FOLDS.get(c.lower(), "") if ci else c


@cache
def lead(pattern: str, ci: bool) -> str:
    """A look at the first two letters of a list of words, empty for any other pattern.

    Java tries every word at every place of a text; with the look it tries them only where one can start.
    """
    words, depth = [""], 0
    if not (pattern.startswith("(") and pattern.endswith(")")) or pattern[1:2] == "?" or set(pattern) & set("[]\\{}^$.*+"):
        return ""
    for c in pattern[1:-1]:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return ""
        if c == "|" and not depth:
            words.append("")
        else:
            words[-1] += c
    firsts, pairs = set(), set()
    for w in words:
        first, second = (_letters(c, ci) for c in w[:2].ljust(2))
        if first is None or w[1:2] == "?":
            return ""
        firsts.add(first)
        pairs.add(f"[{first}]" + (f"[{second}]" if first != KANA_HAN and second and w[2:3] != "?" else ""))
    return f"(?-i:(?=[{''.join(sorted(firsts))}])(?={'|'.join(sorted(pairs))}))"


def rx(pattern: str, ci: bool = False) -> str:
    return ("(?Ui)" if ci else "(?U)") + lead(pattern, ci) + pattern


def matches(c: ColumnOrName, pattern: str, ci: bool = False) -> Column:
    return as_col(c).rlike(rx(pattern, ci))


def extract(c: ColumnOrName, pattern: str, group: int = 0, ci: bool = False) -> Column:
    """First hit of a group, or null when the pattern is absent."""
    return F.nullif(F.regexp_extract(as_col(c), rx(pattern, ci), group), F.lit(""))


def extract_all(c: ColumnOrName, pattern: str, ci: bool = False) -> Column:
    return F.regexp_extract_all(as_col(c), F.lit(rx(pattern, ci)), 0)


def replace_all(c: ColumnOrName, pattern: str, by: str = "", ci: bool = False) -> Column:
    return F.regexp_replace(as_col(c), rx(pattern, ci), by)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression once, so a body that uses it often stays small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def one_of(c: ColumnOrName, values) -> Column:
    return as_col(c).isin(*values)


def blank_to_null(c: ColumnOrName) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def str_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


#: Lists of at most so many members are compared by pairs; longer ones are sorted.
FEW = 16


def first_by(items: Column, key: Callable[[Column], list[Column]]) -> Column:
    """Members of an array whose key was not seen before, in order; two sorts, where there are more than FEW."""

    def few(xs: Column) -> Column:
        return let(F.transform(xs, lambda x: F.struct(*key(x))), lambda ks: F.filter(xs, lambda x, i: F.array_position(ks, F.get(ks, i)) == i + 1))

    def many(xs: Column) -> Column:
        # sort_array makes its order once, array_sort, and any order of a struct in a struct, at every comparison
        keyed = F.sort_array(
            F.transform(xs, lambda x, i: F.struct(*[k.alias(f"k{j}") for j, k in enumerate(key(x))], i.alias("i"), x.alias("x")))
        )

        def new(ks: Column, e: Column, j: Column) -> Column:
            names = [f"k{n}" for n in range(len(key(e["x"])))]
            return (j == 0) | ~reduce(lambda a, b: a & b, [F.get(ks, j - 1)[n].eqNullSafe(e[n]) for n in names])

        heads = let(keyed, lambda ks: F.filter(ks, lambda e, j: new(ks, e, j)))
        ordered = F.sort_array(F.transform(heads, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
        return F.transform(ordered, lambda e: e["x"])

    return let(items, lambda xs: F.when(F.size(xs) <= FEW, few(xs)).otherwise(many(xs)))


def explode_rows(df, array: str, *keep: str, ord_name: str = "ord", item: str = "item"):
    """One row per array element, with its 0-based ordinal.

    The outer form is filtered afterwards on purpose: for the inner form the
    optimizer infers "array is not empty" and pushes it below, which inlines
    and evaluates the whole array expression a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(ord_name, item))
    return rows.where(F.col(ord_name).isNotNull())


def keep_rows(df, test: Column):
    """Rows that pass a test on costly computed columns.

    A plain filter would be pushed below the projection that computes them
    and evaluate them twice; this one stays above it.  On a stored table use
    ``where``, which reaches the scan.
    """
    flag = F.explode_outer(F.when(test, F.array(F.lit(True))))
    return df.withColumn("_keep", flag).where(F.col("_keep")).drop("_keep")
