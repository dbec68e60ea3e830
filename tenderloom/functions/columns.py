"""Expressions on identifiers, money, dates, text and vectors. All are built-in
Catalyst expressions, so they stay inside code generation; a null gives null
unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exact sums of money need a fixed scale.
MONEY = "decimal(28,6)"


def name_key(c: Column) -> Column:
    """Trimmed and lower-case; blank is null."""
    return F.lower(F.nullif(F.btrim(c), F.lit("")))


def id_key(c: Column) -> Column:
    """Trimmed and upper-case; blank is null."""
    return F.upper(F.nullif(F.btrim(c.cast("string")), F.lit("")))


def alias_key(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), F.lit(""))


def total(c: Column) -> Column:
    """Sum of money, 0 over nothing, independent of the order of rows."""
    return F.coalesce(F.sum(c.cast(MONEY)).cast("double"), F.lit(0.0))


def rounded(c: Column, digits: int = 2) -> Column:
    """Rounded half up in decimals, so that a tie does not hang on the last bit."""
    return F.round(c.cast(MONEY), digits).cast("double")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def first_column(df: DataFrame, ladder: list[str], default: Column | None = None) -> Column:
    """The first column of the ladder that df has, chosen when the plan is made."""
    for c in ladder:
        if c in df.columns:
            return F.col(c)
    return F.lit(None) if default is None else default


def price_of(df: DataFrame) -> Column:
    """Unit price in pounds, else plain, else any column named like a price, else 0."""
    both = [F.col(c) for c in ("unit_price_gbp", "unit_price") if c in df.columns]
    named = [F.col(c) for c in df.columns if "price" in c.lower()][:1]
    return F.coalesce(*(both or named), F.lit(0.0))


def quantity_of(df: DataFrame) -> Column:
    named = [c for c in df.columns if "qty" in c.lower() or "quantity" in c.lower()]
    return F.coalesce(F.col(named[0]), F.lit(1)) if named else F.lit(1)


def terms_days(c: Column) -> Column:
    """Days of payment terms: immediate is 0, else the first whole number."""
    low = F.lower(c)
    now = low.rlike("immediate|upon receipt|on receipt|cash on delivery|due now")
    return F.when(now, 0).otherwise(F.nullif(F.regexp_extract(low, "([0-9]{1,6})", 1), F.lit("")).cast("int"))


def terms_score(days: Column, most: int = 90) -> Column:
    """100 for immediate payment down to 0 at `most` days; unknown is 50."""
    return F.when(days.isNull(), 50.0).otherwise(F.round((1 - F.least(F.greatest(days, F.lit(0)), F.lit(most)) / most) * 100, 2))


def clean_number(c: Column) -> Column:
    """The number in a text: the last one, or the first where a percent sign
    stands; commas go, parentheses negate, a leading minus is not read."""
    bare = F.replace(c, F.lit(","), F.lit(""))
    every = F.regexp_extract_all(bare, F.lit("([0-9]+(?:[.][0-9]+)?)"), 1)
    chosen = F.when(F.size(every) == 0, None).when(F.contains(c, F.lit("%")), F.try_element_at(every, F.lit(1))).otherwise(F.try_element_at(every, F.lit(-1)))
    value = chosen.try_cast("double")
    return F.when(F.contains(bare, F.lit("(")) & F.contains(bare, F.lit(")")) & ~F.contains(c, F.lit("%")), -value).otherwise(value)


def numeric(c: Column, precision: int, scale: int) -> Column:
    """Rounded to the scale; null where it does not fit the precision."""
    value = c.try_cast("double")
    return F.when(F.abs(value) < 10.0 ** (precision - scale), F.round(value, scale))


def risk_share(c: Column) -> Column:
    """A risk of 0..1 or 0..100 as a share; null gives 0."""
    return F.when(c.isNull() | (c < 0), 0.0).when(c > 1, F.least(c / 100, F.lit(1.0))).otherwise(c)


def any_date(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/MM/dd")) -> Column:
    """The first format that reads the whole text."""
    return F.coalesce(*[F.try_to_timestamp(F.btrim(c), F.lit(f)).cast("date") for f in formats])


def words_of(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))


def bucket_of(word: Column) -> Column:
    """One of 256 buckets: the last two hex digits of the word's sha1."""
    return F.conv(F.right(F.sha1(word.cast("binary")), F.lit(2)), 16, 10).cast("int")


def collapsed(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, "[ \\t\\r\\n]+", " "))


def text_key(c: Column) -> Column:
    """sha1 of the lower-case a-z, 0-9 and single spaces of a text."""
    return F.sha1(F.regexp_replace(F.regexp_replace(F.lower(c), "[ \\t\\r\\n]+", " "), "[^a-z0-9 ]", "").cast("binary"))


def without_markup(html: Column) -> Column:
    """Text of a page: script and style blocks, comments and tags become spaces."""
    out = html
    for pattern in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "(?s)<!--.*?-->", "(?s)<[^>]*>"):
        out = F.regexp_replace(out, pattern, " ")
    return collapsed(out)


def path_of(*levels: Column) -> Column:
    """Category levels joined by ` > `, blanks left out."""
    return F.concat_ws(" > ", *[F.nullif(F.btrim(x), F.lit("")) for x in levels])


def finding_key(policy: Column, detector: Column, sources: Column, supplier: Column, item: Column) -> Column:
    digest = F.substring(F.sha1(F.concat_ws("|", F.sort_array(sources)).cast("binary")), 1, 8)
    return F.concat_ws("_", policy, detector, digest, supplier, item)
