"""String expressions with the whitespace and case rules the snapshot needs."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every code point that counts as whitespace around or inside a value.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
def stripped(col: Column) -> Column:
    """``col`` without surrounding whitespace; a missing value becomes an empty string."""
    return F.btrim(F.coalesce(col, F.lit("")), F.lit(WHITESPACE))


def single_spaced(col: Column) -> Column:
    """Runs of whitespace become one space and the ends are trimmed."""
    spaced = F.trim(F.translate(col, WHITESPACE, " " * len(WHITESPACE)))
    return F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " +", " ")).otherwise(spaced)


def has_nul(col: Column) -> Column:
    return F.contains(col, F.lit("\x00"))


_NAMES = T.ArrayType(
    T.StructType([T.StructField("name", T.StringType()), T.StructField("key", T.StringType())])
)


@F.arrow_udf(_NAMES)
def _distinct_unicode(lists: pa.Array) -> pa.Array:
    """NFKC form and case-folded key of every new name of each list, one batch at a time."""
    folded: dict[str, tuple[str, str]] = {}
    out = []
    for row in lists.to_pylist():
        if row is None:
            out.append(None)
            continue
        first: dict[str, str] = {}
        for raw in row:
            if raw not in folded:
                name = " ".join(unicodedata.normalize("NFKC", raw).split())
                folded[raw] = (name, name.casefold())
            name, key = folded[raw]
            if name:
                first.setdefault(key, name)
        out.append([{"name": name, "key": key} for key, name in first.items()])
    return pa.array(out, pa.list_(pa.struct([("name", pa.string()), ("key", pa.string())])))


def distinct_names(rows: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with ``out`` = ``array<struct<name, key>>``: display form and comparison key.

    The first spelling of a key is kept. ASCII text is its own NFKC form and folds by
    ``lower``, so such rows stay in the JVM; only lists with other characters are handed
    to Python.
    """
    joined = F.array_join(column, "", "")
    steps = rows.withColumn("_ascii", F.octet_length(joined) == F.char_length(joined))
    steps = steps.withColumn("_folded", _distinct_unicode(F.when(~F.col("_ascii"), F.col(column))))
    steps = steps.withColumn("_names", F.when(F.col("_ascii"), F.transform(column, single_spaced)))
    steps = steps.withColumn("_keys", F.transform("_names", F.lower))
    pairs = F.arrays_zip(F.col("_names").alias("name"), F.col("_keys").alias("key"))
    native = F.filter(
        pairs, lambda p, i: (p["name"] != "") & (F.array_position("_keys", p["key"]) == i + 1)
    )
    return steps.withColumn(out, F.coalesce(native, F.col("_folded"))).drop(
        "_ascii", "_folded", "_names", "_keys"
    )


# Choices of this library. They find likely names by their surroundings and miss others.
NAME_MARK = "[name]"
NAME_BEFORE = (
    r"\b((?i:hosted by|stayed with|thank you|thanks to|thanks|our hosts?|the hosts?|"
    r"your hosts?|my hosts?|met|dear|hi|hello)[ ,]+)(\p{Lu}\p{Ll}+)\b"
)
NAME_AFTER = r"\b(\p{Lu}\p{Ll}+)( (?:was|is|were|has been) (?:a|an|the|our|such a)[a-z ]{0,40}\bhosts?\b)"


def without_names(col: Column, names: tuple[str, ...] = ()) -> Column:
    """``col`` with probable personal names replaced, by context and by a given list.

    Best effort: a name in a sentence that neither pattern describes stays.
    """
    out = F.regexp_replace(col, NAME_BEFORE, "$1" + r"\[name\]")
    out = F.regexp_replace(out, NAME_AFTER, r"\[name\]" + "$2")
    if names:
        listed = "|".join(r"\Q" + name.replace(r"\E", r"\E\\E\Q") + r"\E" for name in sorted(set(names)))
        out = F.regexp_replace(out, rf"(?U)\b(?:{listed})\b", r"\[name\]")
    return out
