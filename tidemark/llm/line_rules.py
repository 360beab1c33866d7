r"""Operator 11, quality rules: cross-document line frequency, with DataFrame functions only.

Lines are normalised (lower case, runs of digits as one 0, runs of white space as one space, trimmed) and hashed to
64 bits.  For each (host, line) the distinct documents of the host that have it are counted; equal texts
of a host are one document.  A line in more than ``max_docs`` documents of its host is removed from all of them but the
one with the smallest id, so that nothing is lost from the host as a whole.  A document of which less than ``min_left`` of its words remains is depleted
and rejected.

Before that each document meets base rules of its own: too few words, or too many words in eight-word windows that recur in
it.  All measures are taken over whole texts: words are runs of ``[^\x20\x09-\x0D]``; windows are hashed by doubling (words, pairs,
fours, eights), and positions are sorted only for documents in which a window recurs.

The text is read once, into a staged table of measures and line hashes.  Counts fold by (host, line) before they are
shuffled; lines of documents meet the frequent lines by (host, line, salt), so a line that a third of all documents
have is ``salts`` tasks; rejected texts meet their rows in the same way, so a text with many copies is too.

Null text counts as empty: no words, base rules fail.  Rows without a host share one.  Rows may repeat, with the same id or not: each
gets its own verdict, and equal rows equal ones.  A line above the limit whose documents have no id stays nowhere; of several texts with the same smallest id
each keeps it.  An empty table gives an empty result.  Other columns are ignored by ``line_rules`` and carried by ``without_common_lines``,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged, text_or_empty

MAX_DOCS, MIN_LEFT, SALTS = 100, 0.2, 16
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def normalised(text: Column) -> Column:
    """A text with its lines in their normal form, but for spaces at their ends."""
    flat = F.translate(F.lower(text), SPACES.replace("\n", ""), "    ")
    return F.regexp_replace(F.regexp_replace(flat, "[0-9]+", "0"), " +", " ")


def normalised_lines(text: Column) -> Column:
    """The lines of a text in their normal form; lines without a word are left out."""
    return F.array_remove(F.transform(F.split(normalised(text), "\n", -1), lambda line: F.trim(line)), "")


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, F.lit(by + 1), F.greatest(F.size(values), F.lit(1)))


def _paired(values: Column, by: int) -> Column:
    return F.zip_with(values, _shifted(values, by), lambda a, b: F.xxhash64(a, b))


def measured(rows: DataFrame) -> DataFrame:
    """Columns ``text`` of ``rows`` as measures: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Each step's array is used more than once in the next, so that it is computed once and not inlined.
    """
    text, none = F.col("text"), F.array().cast("array<bigint>")
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " ", -1), "")
    told = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = rows.withColumns({"_words": words, "_told": told})
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_told") - F.size(F.array_distinct("_told"))).cast("long"),
            "_h": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_words", "_told")
    for by in (1, 2, 4):
        out = out.withColumn("_h", _paired(F.col("_h"), by))
    out = out.withColumn("_h", F.when(F.col("n_words") >= WINDOW, F.slice("_h", F.lit(1), F.col("n_words").cast("int") - WINDOW + 1)).otherwise(none))
    placed = F.zip_with("_h", F.sequence(F.lit(1), F.size("_h")), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    recurs = F.size(F.array_distinct("_h")) < F.size("_h")
    out = out.withColumn("_s", F.when(recurs, F.sort_array(placed))).drop("_h")
    # Equal windows are neighbours now; each of them starts a repeat.
    twins = F.zip_with("_s", _shifted(F.col("_s"), 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("_starts", F.sort_array(F.array_distinct(F.flatten(twins)))).drop("_s")
    covered = F.zip_with("_starts", _shifted(F.col("_starts"), 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda acc, n: acc + n)
    return out.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("_starts")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _salted(keys: DataFrame, salts: int) -> DataFrame:
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _hashed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, host, text and its digest."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host"), text_or_empty(f"`{text_col}`").alias("text")
    ).withColumn("digest", F.unhex(F.md5("text")))


def _lines(text: Column) -> Column:
    """Of each line with a word its hash and its number of words."""
    words = lambda line: F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return F.transform(normalised_lines(text), lambda line: F.struct(F.xxhash64(line).alias("h"), words(line).alias("n")))


def _texts(rows: DataFrame) -> DataFrame:
    """One row per host and distinct text."""
    return rows.groupBy("host", "digest").agg(F.min("doc_id").alias("first_id"), F.first("n_words").alias("n_words"), F.first("lines").alias("lines"))


def frequent_lines(texts: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """host, line hash, number of documents and the document that keeps it, of lines above the limit."""
    each = texts.select("host", "first_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    return each.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs"), F.min("first_id").alias("holder")).filter(F.col("n_docs") > max_docs)


def _removed(texts: DataFrame, frequent: DataFrame, salts: int) -> DataFrame:
    """host, digest, h, n of each line that is removed from a text, as often as it stands there."""
    lines = texts.select("host", "digest", "first_id", F.inline("lines")).withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(salts)).cast("int"))
    return lines.join(_salted(frequent, salts), ["host", "h", "salt"]).filter(~F.col("first_id").eqNullSafe(F.col("holder"))).select("host", "digest", "h", "n")


def line_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    min_left: float = MIN_LEFT,
    salts: int = SALTS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, the measures, base_failed, depleted, kept."""
    rows = measured(_hashed(docs, id_col, text_col, host_col)).withColumn("lines", _lines(F.col("text"))).drop("text")
    rows = staged(rows, "line-rows")
    texts = staged(_texts(rows), "line-texts")
    removed = _removed(texts, frequent_lines(texts, max_docs), salts)
    lost = removed.groupBy("host", "digest").agg(F.sum("n").alias("lost"))
    depleted = lost.join(texts.select("host", "digest", "n_words"), ["host", "digest"]).filter(F.col("n_words") - F.col("lost") < min_left * F.col("n_words"))
    marks = _salted(depleted.select("host", "digest", F.lit(True).alias("depleted")), salts)
    rows = rows.drop("lines").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    out = rows.join(marks, ["host", "digest", "salt"], "left").withColumns({"base_failed": base_failed(), "depleted": F.coalesce("depleted", F.lit(False))})
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "depleted", (~F.col("base_failed") & ~F.col("depleted")).alias("kept")
    )


def without_common_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, salts: int = SALTS
) -> DataFrame:
    """``docs`` without the lines above the limit; other lines, their order and all columns stay."""
    names = docs.columns
    keyed = _hashed(docs, id_col, text_col, host_col)
    rows = keyed.select("doc_id", "host", "digest", F.lit(0).alias("n_words"), _lines(F.col("text")).alias("lines"))
    texts = staged(_texts(rows), "line-texts")
    # At most the lines of one text gather in a row.
    gone = _removed(texts, frequent_lines(texts, max_docs), salts).groupBy("host", "digest").agg(F.collect_set("h").alias("gone"))
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    host = F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit(""))
    text = text_or_empty(f"`{text_col}`")
    whole = docs.select(row.alias("_row"), host.alias("host"), F.unhex(F.md5(text)).alias("digest"), F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(salts)).cast("int").alias("salt"))
    hit = whole.join(_salted(gone, salts), ["host", "digest", "salt"], "left")
    lines = F.split(F.col("_row")[text_col], "\n", -1)
    kept = F.filter(lines, lambda line: ~F.array_contains("gone", F.xxhash64(F.trim(normalised(line)))))
    cut = F.when(F.col("gone").isNull(), F.col("_row")[text_col]).otherwise(F.array_join(kept, "\n"))
    return hit.select(*[cut.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names])


def op11_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(documents(spark, sf_dir))


OP11_SQL = rf"""
with d as (select row_number() over () as u, doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, string_split(text, chr(10)) as raw from d),
told as (select u, list_filter(raw, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as told from w),
windows as (select u, i, array_to_string(words[i:i + 7], ' ') as t from (select u, words, unnest(range(1, len(words) - 6)) as i from w)),
starts as (select u, i from (select *, count(*) over (partition by u, t) as n from windows) where n > 1),
covered as (select u, count(distinct p) as n from (select u, unnest(range(i, i + 8)) as p from starts) group by 1),
measures as (
    select w.u, doc_id, host, text, len(words) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
           cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
           len(told) - len(list_distinct(told)) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words
    from w join told using (u) left join covered using (u)),
texts as (select host, text, min(doc_id) as first_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as n_words from d group by all),
lines as (
    select host, text, first_id, n_words, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) as line
    from (select *, unnest(string_split(text, chr(10))) as x from texts)),
frequent as (select host, line, min(first_id) as holder from (select distinct host, text, line, first_id from lines where line <> '') group by all having count(*) > {MAX_DOCS}),
lost as (
    select host, text, any_value(n_words) as n_words, sum(len(string_split(line, ' '))) as lost
    from lines join frequent using (host, line) where first_id is distinct from holder group by all),
judged as (
    select m.*, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
           exists (select 1 from lost l where l.host = m.host and l.text = m.text and l.n_words - l.lost < {MIN_LEFT} * l.n_words) as depleted
    from measures m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, depleted, not base_failed and not depleted as kept from judged
"""
