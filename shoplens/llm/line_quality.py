"""Quality rules: lines that many documents of a host repeat are taken out, and documents left with little are rejected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import SPACE, WORD, stored, with_defaults

_SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\x0b\f\r"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(words: Column) -> Column:
    """How many words lie in three-word windows whose words occur twice or more in the text."""

    def count(hashes: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - 3),
            lambda i: F.struct(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("p")),
        )
        return F.when(F.size(hashes) > 3, _let(F.sort_array(windows), twice)).otherwise(0)

    def twice(sorted_: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(sorted_, i)["h"], F.lit(False))
        marked = F.transform(sorted_, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["p"]))
        return _let(F.sort_array(F.filter(marked, lambda p: p.isNotNull())), covered)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), count)


def _without(text: Column, gone: Column) -> Column:
    """``text`` without the lines whose normalised form has a hash in ``gone``; lines without a word stay."""
    words_of = lambda x: F.filter(F.split(x, SPACE), lambda w: w != "")
    stays = lambda x: ~x.rlike(WORD) | ~F.array_contains(gone, F.xxhash64(F.lower(F.array_join(words_of(x), " "))))
    return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")


def _measures(text: Column) -> Column:
    """All figures of one text, and its lines as (hash of the normalised line, words)."""
    spaces = lambda t: F.split(t, SPACE)
    words_of = lambda t: F.filter(spaces(t), lambda w: w != "")

    def lines(found: Column) -> Column:
        return F.transform(
            found,
            lambda x: F.struct(
                F.xxhash64(F.lower(F.array_join(words_of(x), " "))).alias("h"), F.size(words_of(x)).alias("w")
            ),
        )

    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return F.struct(
        (F.length(text) - F.length(F.regexp_replace(text, f"[{_SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        F.length(F.translate(text, _WHITE, "")).cast("long").alias("word_chars"),
        _let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).cast("long").alias("again"))).alias("words"),
        _let(worded, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), lines(x).alias("all"))).alias("lines"),
    )


def line_quality(
    docs: DataFrame, min_docs: int = 5, max_share: float = 0.02, max_removed: float = 0.5, min_words: int = 50, cleaned: bool = True,
) -> DataFrame:
    """Figures and verdict per row: ``doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, kept``,
    and with ``cleaned`` also ``text`` without the lines taken out (a null text stays null).

    A line, with white space collapsed and in lower case, is taken out of a host's (``source``'s) documents if more than ``min_docs`` of
    its documents and more than ``max_share`` of them hold it; exact copies of a text count as one document.
    A document that loses more than ``max_removed`` of its words is rejected, as is one that fails the base rule
    (under ``min_words`` words, or over half of them in repeated three-word windows).

    Texts are read once, and once more where they are cleaned; figures and line hashes are written. Frequencies are summed before they are shuffled, and a host with a
    third of all rows is spread by line. A null source is a host of its own. A null or empty text has no words and fails. Repeated
    rows get equal results. Other columns are ignored; no rows give no rows. Whole texts are measured.
    """
    docs = with_defaults(docs, doc_id="long", source="string", text="string")
    texts = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    read = texts.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("host"), "source", F.xxhash64("text").alias("mark"), F.length("text").alias("chars"), _measures(F.col("text")).alias("m"))
    read = stored(read.select(
        "doc_id", "host", "source", "mark", "chars", "m.n_symbols", "m.word_chars", F.col("m.words.n").alias("n_words"),
        F.col("m.words.again").alias("n_repeat_words"), F.col("m.lines.dup").alias("n_dup_lines"), F.col("m.lines.all").alias("lines"),
    ), "lines")

    distinct = read.groupBy("host", "mark", "chars").agg(F.first("lines").alias("lines"))
    counts = distinct.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    hosts = distinct.groupBy("host").agg(F.count("*").alias("docs"))
    frequent = counts.where(F.col("n") > min_docs).join(hosts, "host").where(F.col("n") > F.col("docs") * max_share).select("host", "h")
    held = distinct.select("host", "mark", "chars", F.explode("lines").alias("line")).select("host", "mark", "chars", "line.h", "line.w")
    held = held.join(frequent, ["host", "h"])
    removed = held.groupBy("host", "mark", "chars").agg(F.sum("w").alias("removed_words"))
    columns = ["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept"]

    if cleaned:
        # Figures hang on host and text alone, so one row of them serves all rows with that text.
        read = read.dropDuplicates(["host", "mark", "chars"]).drop("doc_id", "source")
    out = read.drop("lines").join(removed, ["host", "mark", "chars"], "left")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("removed_words") <= F.col("n_words") * max_removed))
    if not cleaned:
        return out.select(*columns)
    gone = held.groupBy("host", "mark", "chars").agg(F.collect_set("h").alias("gone"))
    rows = docs.select(
        "doc_id", "source", "text", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("host"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), F.length(F.coalesce("text", F.lit(""))).alias("chars"),
    )
    found = out.join(gone, ["host", "mark", "chars"], "left")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("gone")))
    return rows.join(found, ["host", "mark", "chars"]).select(*columns, text.alias("text"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    found = line_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), cleaned=False)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


_WORD = r"[^\x20\x09-\x0D]+"
OP4_SQL = rf"""
WITH texts AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '{_WORD}')] AS lines
  FROM documents
), windows AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words[p], words[p + 1], words[p + 2]) AS n
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM texts)
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM windows WHERE n > 1) GROUP BY doc_id
), held AS (
  SELECT doc_id, source, text, lower(array_to_string(regexp_extract_all(l, '{_WORD}'), ' ')) AS line, len(regexp_extract_all(l, '{_WORD}')) AS w
  FROM (SELECT doc_id, source, text, unnest(lines) AS l FROM texts)
), hosts AS (
  SELECT source, count(DISTINCT text) AS docs FROM texts GROUP BY source
), frequent AS (
  SELECT h.source, line FROM held h JOIN hosts o ON h.source IS NOT DISTINCT FROM o.source
  GROUP BY h.source, line HAVING count(DISTINCT text) > 5 AND count(DISTINCT text) > max(docs) * 0.02
), removed AS (
  SELECT doc_id, sum(w) AS removed_words FROM held h JOIN frequent f ON h.source IS NOT DISTINCT FROM f.source AND h.line = f.line GROUP BY doc_id
), figures AS (
  SELECT t.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM texts t LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= n_words * 0.5 AS kept
FROM figures
"""
