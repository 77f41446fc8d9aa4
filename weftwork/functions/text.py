"""Text functions: normal forms, chunks, shingles, similarities and answers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(c: Column) -> Column:
    """Case folded (also sharp s), white space single."""
    return F.replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss"))


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda x: x != "")


def _with(value: Column, use) -> Column:
    """use(value), with the value worked out once: a lambda's variable, where an expression would be evaluated at each mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks(c: Column, size: int = 220, overlap: int = 40) -> Column:
    """Windows of `size` words that overlap; the last ends with the text."""
    step = max(1, size - overlap)

    def cut(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.size(w) - size)
        starts = F.sequence(F.lit(0), (F.lit(step) * F.ceil(last / F.lit(step))).cast("int"), F.lit(step))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))

    return _with(words(c), cut)


def _grams(c: Column, n: int, make) -> Column:
    """make(text) of each n words in a row, lower case; fewer words: of all; none: empty. Words are taken by place, as a slice would copy the array."""

    def cut(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: make(F.concat_ws(" ", *(F.get(w, i + j) for j in range(n)))))
        whole = F.array(make(F.array_join(w, " ")))
        return F.when(F.size(w) >= n, many).when(F.size(w) > 0, whole).otherwise(F.slice(whole, 1, 0))

    return F.array_distinct(_with(words(F.lower(c)), cut))


def shingles(c: Column, n: int = 3) -> Column:
    """The set of n words in a row, lower case; fewer words: the whole text; none: empty."""
    return _grams(c, n, lambda x: x)


def shingle_hashes(c: Column, n: int = 3) -> Column:
    """The set of hashes of n words in a row, for comparisons that need no words."""
    return _grams(c, n, F.xxhash64)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(size != 0, size))


def score(c: Column) -> Column:
    """A mark from 0 to 5, rounded; 0 if it is no number."""
    mark = F.bround(c.try_cast("double"), 0)
    return F.when(mark.isNull() | F.isnan(mark), 0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(5.0), mark)).cast("int"))


def unanswerable(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit(" "), F.lit("_"))).contains("NOT_IN_PASSAGE")


def request_key(canonical_json: Column) -> Column:
    return F.sha2(canonical_json, 256)
