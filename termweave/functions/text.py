"""Cleaning, n-grams, tokens and vectors as column expressions (no Python on the executors)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default stop words, and the ASCII punctuation that cleaning deletes.
STOPWORDS = ("a", "an", "the", "of", "for", "and", "or", "in", "on", "to", "with", "is", "are", "was", "were", "by", "at", "as", "from")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode blanks included (trim knows spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_value(c: Column) -> Column:
    """The value as stripped text; null is the empty text."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def clean(c: Column, lowercase: bool = True, remove_punctuation: bool = True, remove_stopwords: bool = False, stopwords: Iterable[str] = STOPWORDS, strip_whitespace: bool = True) -> Column:
    """Normal form of a term. Punctuation is deleted, not replaced, so ``foo-bar`` becomes ``foobar``; runs of
    white space become one blank; null is the empty text."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    if strip_whitespace:
        out = strip(out)
    if lowercase:
        out = F.lower(out)
    if remove_punctuation:
        out = F.translate(out, PUNCTUATION, "")
    if remove_stopwords:
        words = F.filter(F.split(out, r"(?U)\s+"), lambda w: (w != "") & ~w.isin(*stopwords))
        out = F.array_join(words, " ")
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def plain(c: Column, lowercase: bool = True) -> Column:
    """What matchers use without a cleaner: stripped, and in lower case for n-grams."""
    out = clean_value(c)
    return F.lower(out) if lowercase else out


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` as a lambda's variable: made once, also where ``use`` names it inside another lambda (there
    Spark would make the expression again for every element)."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def ngrams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is its own only n-gram, the empty text has none."""
    if n < 1:
        raise ValueError("n must be 1 or more")

    def grams(ch: Column) -> Column:
        many = F.array_distinct(F.filter(F.transform(ch, lambda x, i: F.concat(x, *[F.get(ch, i + k) for k in range(1, n)])), lambda g: g.isNotNull()))
        return F.when(F.size(ch) == 0, F.array().cast("array<string>")).when(F.size(ch) < n, F.array(F.array_join(ch, ""))).otherwise(many)

    return bound(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), grams)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays zero."""

    def scaled(v: Column) -> Column:
        both = F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("norm"))
        return bound(both, lambda t: F.transform(t["v"], lambda x: F.when(t["norm"] > 0, x.cast("double") / t["norm"]).otherwise(F.lit(0.0))))

    return bound(v, scaled)


def round_even(c: Column, digits: int = 3) -> Column:
    return F.bround(c, digits)


def hashed_embedding(c: Column, dims: int = 64, n: int = 3) -> Column:
    """Deterministic embedding: signed hashed n-grams counted into ``dims`` cells, scaled to length one."""
    # a cell is named twice, for its two signs; names are counted without a lambda for each n-gram and cell
    name = lambda g: F.pmod(F.xxhash64(g), F.lit(dims)) + F.when(F.xxhash64(g, F.lit(1)) % 2 == 0, 0).otherwise(dims)
    cells = F.transform(ngrams(clean(c), n), lambda g: name(g).cast("int"))
    without = lambda x, k: F.size(F.array_remove(x, k))
    sums = lambda x: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: (without(x, k + dims) - without(x, k)).cast("double"))
    return unit(bound(cells, sums)).cast("array<float>")


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of those token vectors whose mask is not 0; null if the mask keeps none."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["v"])

    def mean(v: Column) -> Column:
        return F.when(F.size(v) > 0, F.transform(F.get(v, F.lit(0)), lambda _, i: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.get(x, i).cast("double")) / F.size(v)))

    return bound(kept, mean)
