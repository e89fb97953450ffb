"""Which of a persona's many names its texts hold, without comparing each text with each name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a name that it is looked up by; shorter names by all of theirs.
KEY = 4


def grams(text: Column, most: int = KEY) -> Column:
    """Set of the strings of 2 to ``most`` neighbouring characters of a text."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    # one lambda variable holds the characters, so the text is taken apart once
    def all_of(c: Column) -> Column:
        out, row = [], c
        for n in range(2, most + 1):
            row = F.zip_with(row, F.slice(c, F.lit(n), F.greatest(F.size(c), F.lit(1))), lambda a, b: F.concat(a, b))
            out.append(F.filter(row, lambda g: g.isNotNull()))
        return F.array_distinct(F.concat(*out))

    return F.element_at(F.transform(F.array(chars), all_of), 1)


def occurrences(texts: DataFrame, names: DataFrame, ids: list[str], text: str = "text", most: int = KEY) -> DataFrame:
    """(persona_id, *ids, name), distinct: the names of two characters and more that occur in a text of their persona.

    texts: (persona_id, *ids, text), ids unlike for unlike texts; names: (persona_id, name). The strings of up to ``most`` characters of a text
    are joined with the beginnings of the names; only what agrees there is looked at whole. Null texts hold nothing.
    """
    keyed = names.filter(F.length("name") >= 2).select("persona_id", "name", F.substring("name", 1, most).alias("_g")).distinct()
    on = ["persona_id", *ids]
    rows = texts.filter(F.col(text).isNotNull()).select(*on, F.col(text).alias("_text"))
    found = rows.select(*on, F.explode(grams(F.col("_text"), most)).alias("_g")).join(keyed, ["persona_id", "_g"]).select(*on, "name").distinct()
    whole = found.filter(F.length("name") <= most)
    long = found.filter(F.length("name") > most).join(rows.distinct(), on).filter(F.contains("_text", F.col("name"))).select(*on, "name")
    return whole.unionByName(long)
