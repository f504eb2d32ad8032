"""Names: forms used by price lists, and their normal form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENDS, _SPACE = r"^\s+|\s+$", r"\s+"


@F.pandas_udf(T.StringType())
def _strip_marks(names: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; Spark has no built-in for it."""
    return names.map(lambda n: None if n is None else "".join(
        c for c in unicodedata.normalize("NFKD", n) if not unicodedata.combining(c)))


def surname_first(name: Column) -> Column:
    """``Given Surname`` as ``Surname G.``; a single word as it is, null as empty."""
    words = F.split(F.regexp_replace(name, _ENDS, ""), _SPACE)
    short = F.concat(F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " "), F.lit(" "),
                     F.substring(F.get(words, F.lit(0)), 1, 1), F.lit("."))
    return F.coalesce(F.when(F.size(words) < 2, name).otherwise(short), F.lit(""))


def normal_form(name: Column) -> Column:
    """Without accents, in lower case, blanks collapsed, and then hyphens as blanks."""
    plain = F.regexp_replace(F.lower(_strip_marks(name)), _ENDS, "")
    return F.coalesce(F.replace(F.regexp_replace(plain, _SPACE, " "), F.lit("-"), F.lit(" ")), F.lit(""))


def initial_pattern(name: Column) -> Column:
    """``Surname G.`` as a pattern for ``Given Surname``; special characters are escaped."""
    words = F.split(F.regexp_replace(F.replace(name, F.lit(".")), _ENDS, ""), _SPACE)
    escape = lambda c: F.regexp_replace(c, r"([^\w])", r"\\$1")
    n = F.size(words)
    whole = F.concat(F.lit("^"), escape(F.get(words, n - 1)), F.lit(r"\w+\s+"),
                     escape(F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), " ")), F.lit("$"))
    return F.coalesce(F.when(n < 2, escape(name)).otherwise(whole), F.lit(""))
