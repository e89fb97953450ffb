"""Column functions on text and time. All but term_counts() run inside the JVM; ``now`` is always a parameter."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that carry no topic in English.
ENGLISH_STOP_WORDS = (
    "the a an i me my mine you your yours he him his she her hers it its we us our ours they them their theirs "
    "is am are was were be been being do does did have has had and or but so as of to in on at by for with from "
    "this that these those not no yes if then than too very just"
).split()
#: Tokens, about, that term_counts() counts at once.
AT_ONCE = 1 << 19
# Fixed value: what ends a text that was cut.
CUT_MARK = "……[截断]"
# Retention labels and their months, in order of precedence; months of an unknown label.
RETENTION_MONTHS = (("core", -1.0), ("lasting", 60.0), ("passing", 8.0), ("fleeting", 1.0))
DEFAULT_MONTHS = 8.0


def strip(c: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def estimate_tokens(c: Column) -> Column:
    """0 for null or empty, else a third of the UTF-8 bytes, at least 1."""
    return F.when(F.coalesce(F.octet_length(c), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.octet_length(c) / 3))).cast("long")


def clamp(c: Column, cap: int | Column) -> Column:
    """Texts of more than ``cap`` estimated tokens are cut, never inside a character, and marked; the mark counts."""
    keep = 3 * cap - len(CUT_MARK.encode())
    head = F.call_function("make_valid_utf8", F.substring(F.encode(c, "UTF-8"), F.lit(1), keep if isinstance(keep, Column) else F.lit(keep)).cast("string"))
    head = F.regexp_replace(F.regexp_replace(head, "�+$", ""), r"(?U)\s+$", "")
    return F.when(estimate_tokens(c) > cap, F.concat(head, F.lit(CUT_MARK))).otherwise(c)


def norm_term(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def split_terms(c: Column) -> Column:
    """Parts of a compound name, cut at punctuation and white space only."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)[、，,；;/／|｜&＆+＋\s]+"), lambda s: s != "")


def words(c: Column, names: Iterable[str] = ()) -> Column:
    """Default tokenizer: lower-case runs of letters and digits in order.

    Known names stay whole, also inside a run of a script without spaces; a name that begins or ends with an ASCII letter or
    digit isn't looked for inside a longer word of them.
    """
    run = r"[\p{L}\p{N}]"
    ends = ("(?<![a-z0-9])", "(?![a-z0-9])")
    lowered = sorted({n.strip().lower() for n in names} - {""}, key=lambda n: (-len(n), n))
    known = "|".join((ends[0] if n[0].isascii() and n[0].isalnum() else "") + re.escape(n) + (ends[1] if n[-1].isascii() and n[-1].isalnum() else "") for n in lowered)
    pattern = f"(?:{known})|(?:(?!{known}){run})+" if known else f"{run}+"
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))


def topic_words(c: Column, stop: list[str] | None = None, names: Iterable[str] = ()) -> Column:
    """words() of two characters and more, without stop words and numbers."""
    stop = ENGLISH_STOP_WORDS if stop is None else stop
    return F.filter(words(c, names), lambda w: (F.length(w) >= 2) & ~w.isin(*stop) & ~w.rlike(r"^[0-9]+$"))


def term_counts(rows: DataFrame, tokens: Column, kept: list[str], keep: Callable | None = None) -> DataFrame:
    """The ``kept`` columns of rows, once for each distinct one of their tokens, plus term, tf (how often it occurs in the row) and dl (all tokens).

    The tokens of some rows at a time are numbered, and equal numbers of a row counted, so nothing is shuffled. keep: told the kept columns, the
    terms and, for each pair, its row, term and tf in order of the rows, says which pairs to return; all pairs of a row come in one call.
    """
    rows = rows.select(*kept, tokens.alias("_t"))
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column("_t")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(sizes) // AT_ONCE
            ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(part)) if len(part) else []
            for start, end in zip([0, *ends[:-1]], ends):
                some, n = b.slice(start, end - start), sizes[start:end]
                coded = some.column("_t").flatten().dictionary_encode(null_encoding="encode")
                if not len(coded):
                    continue
                words = max(1, len(coded.dictionary))
                key, tf = np.unique(np.repeat(np.arange(len(n)), n) * words + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                row, word = np.divmod(key, words)
                if keep is not None:
                    some_of = keep(some, coded.dictionary, row, word, tf)
                    row, word, tf = row[some_of], word[some_of], tf[some_of]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[some.column(c).take(at) for c in kept], coded.dictionary.take(pa.array(word)), pa.array(tf, pa.int64()), pa.array(n[row], pa.int32())], names=[*kept, "term", "tf", "dl"])

    return rows.mapInArrow(count, ", ".join([*fields, "term string", "tf long", "dl int"]))


def without_stop_words(rows: DataFrame, stop: DataFrame, word: str = "word") -> DataFrame:
    """rows whose word isn't in the table ``stop`` (word), which may be of any size."""
    return rows.join(stop.select(F.col("word").alias(word)).distinct(), word, "left_anti")


def keyword_tokens(c: Column) -> Column:
    """Set of tokens for overlap: ASCII words of two characters and more, Han characters, and pairs of neighbouring Han characters."""
    text = F.coalesce(c, F.lit(""))
    ascii_words = F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z0-9]{2,}"), F.lit(0)), F.lower)
    han = F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"), F.lit(0))
    pairs = F.zip_with(han, F.slice(han, 2, F.greatest(F.size(han) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_union(F.array_union(ascii_words, han), F.filter(pairs, lambda p: p.isNotNull()))


def overlap_score(query_tokens: Column, card_tokens: Column) -> Column:
    """Shared tokens over the square root of the query's tokens; 0 without any."""
    n = F.size(query_tokens)
    return F.when(n > 0, F.size(F.array_intersect(query_tokens, card_tokens)) / F.sqrt(n)).otherwise(0.0)


def bigrams(c: Column) -> Column:
    """Set of the pairs of neighbouring characters, lower-cased; a shorter text is its own only pair."""
    pairs = F.regexp_extract_all(F.lower(c), F.lit("(?s)(?=(..))."), F.lit(1))
    return F.when(F.length(c) < 2, F.array(F.lower(c))).otherwise(F.array_distinct(pairs))


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Jaccard similarity of the character pairs of two texts, in time linear in their lengths."""
    sides = F.array(F.struct(bigrams(a).alias("a"), bigrams(b).alias("b")))
    sizes = F.transform(sides, lambda s: F.struct((F.size(s["a"]) + F.size(s["b"])).alias("all"), F.size(F.array_intersect(s["a"], s["b"])).alias("both")))
    return F.element_at(F.transform(sizes, lambda s: s["both"] / (s["all"] - s["both"])), 1)


def strip_think(c: Column) -> Column:
    """Without <think> blocks of a model's reply."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<think>.*?</think>", ""))


def retention_months(c: Column) -> Column:
    """Months of a retention label, or of a number; else the default."""
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    out = F.coalesce(low.try_cast("double"), F.lit(DEFAULT_MONTHS))
    for label, months in reversed(RETENTION_MONTHS):
        out = F.when(F.contains(low, F.lit(label)), F.lit(months)).otherwise(out)
    return out


def normalize_level(c: Column) -> Column:
    """Whole level from a number, "3" or "m2"; anything else, or under 0, is 0."""
    text = F.lower(strip(F.coalesce(c.cast("string"), F.lit("0"))))
    n = F.floor(F.regexp_replace(text, "^m", "").try_cast("double")).cast("int")
    return F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))


def or_if_empty(c: Column, default: str) -> Column:
    """c, or default where it is empty; unlike in F.when(), c is written once, so it is evaluated once."""
    return F.regexp_replace(c, r"\A\z", default.replace("\\", "\\\\").replace("$", "\\$"))


def safe_session_id(c: Column) -> Column:
    out = F.regexp_replace(strip(F.when(F.coalesce(c, F.lit("")) == "", F.lit("default")).otherwise(c)), r"[^a-zA-Z0-9_.-]+", "_")
    return or_if_empty(out, "default")


def safe_filename(c: Column, default: str = "default") -> Column:
    name = strip(F.when(F.coalesce(c, F.lit("")) == "", F.lit(default)).otherwise(c))
    name = F.regexp_replace(name, r"(?U)[^\w.\-\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]+", "_")
    name = F.regexp_replace(F.replace(name, F.lit(".."), F.lit("_")), r"^[_. ]+|[_. ]+$", "")
    return or_if_empty(name, default)


def stable_id(prefix: str, *cols: Column) -> Column:
    """Reproducible id: prefix and 32 hex digits (128 bits) of what identifies the row."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256), 1, 32))


def time_period(c: Column) -> Column:
    """Name of the part of the day."""
    h = F.hour(c)
    return F.when(h < 6, "凌晨").when(h < 12, "上午").when(h < 18, "下午").otherwise("晚上")


def card_text(content: Column, keywords: Column, tags: Column) -> Column:
    """Content, keywords and tags as one text to index; empty parts are left out."""
    some = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x != "")
    return F.array_join(F.concat(F.filter(F.array(content), lambda x: x != ""), some(keywords), some(tags)), " ")


def recency(created: Column, now: Column, rate: float = 0.01) -> Column:
    """exp(-rate * days since)."""
    return F.exp(-rate * (F.unix_micros(now) - F.unix_micros(created)) / F.lit(86400e6))


def time_prefix(created: Column, source_time: Column, card_id: Column, now: Column) -> Column:
    """How long ago a card was made, in words; which of equivalent phrases follows from its id.

    Future times count as recent days. A null time gives the empty string.
    """
    micros = F.unix_micros(now) - F.unix_micros(created)
    days, hours = F.floor(micros / F.lit(86400e6)), micros / F.lit(3600e6)
    seed = F.aggregate(F.transform(F.split(F.coalesce(card_id, F.lit("")), ""), lambda ch: F.coalesce(F.ascii(ch), F.lit(0))), F.lit(0), lambda a, x: a + x)
    when_said = F.coalesce(source_time, F.lit(""))

    def pick(*phrases: Column | str) -> Column:
        return F.element_at(F.array(*[p if isinstance(p, Column) else F.lit(p) for p in phrases]), (seed % len(phrases) + 1).cast("int"))

    has = lambda *parts: F.coalesce(sum((F.contains(when_said, F.lit(p)).cast("int") for p in parts), F.lit(0)) > 0, F.lit(False))
    # The phrases and their bounds in hours and days.
    today = (
        F.when(hours < 2, pick("刚才，", "刚刚，")).when(has("早", "上午"), pick("今天早上，", "今天上午，"))
        .when(has("下午"), pick("今天下午，", "今天，")).when(has("晚", "夜"), pick("今晚，", "今天晚上，")).otherwise("今天，")
    )
    yesterday = F.when(has("晚", "夜", "凌晨"), pick("昨晚，", "昨天晚上，")).when(has("下午"), pick("昨天下午，", "昨天，")).otherwise("昨天，")
    weekday = F.element_at(F.array(*[F.lit(f"上{d}，") for d in ("周一", "周二", "周三", "周四", "周五", "周六", "周日")]), F.weekday(created) + 1)
    return (
        F.when(created.isNull(), "").when(days == 0, today).when(days == 1, yesterday).when(days == 2, pick("前天，", "前两天，"))
        .when(days <= 4, pick("前几天，", "好几天前，")).when(days <= 7, pick(weekday, "好几天前，", "前几天，"))
        .when(days <= 14, pick("上周，", "一两周前，")).when(days <= 30, pick("几周前，", "大半个月前，", "半个多月前，"))
        .when(days <= 60, pick("上个月，", "一个多月前，")).when(days <= 120, pick("几个月前，", "两三个月前，"))
        .otherwise(pick("好几个月前，", "很久以前，", "很早之前，"))
    )


def register(spark: SparkSession) -> None:
    """Temporary SQL functions of the same meaning."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION estimate_tokens(x STRING) RETURNS BIGINT RETURN CASE WHEN coalesce(octet_length(x), 0) = 0 THEN 0 ELSE greatest(1, octet_length(x) DIV 3) END")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION topic_words(x STRING) RETURNS ARRAY<STRING> RETURN filter(regexp_extract_all(lower(coalesce(x, '')), '[\\p{L}\\p{N}]+', 0), w -> length(w) >= 2)")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION strip_think(x STRING) RETURNS STRING RETURN trim(regexp_replace(coalesce(x, ''), '(?s)<think>.*?</think>', ''))")
    whens = " ".join(f"WHEN contains(lower(x), '{label}') THEN {months}D" for label, months in RETENTION_MONTHS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION retention_months(x STRING) RETURNS DOUBLE RETURN CASE {whens} ELSE coalesce(try_cast(x AS DOUBLE), {DEFAULT_MONTHS}D) END")
