"""Quality rules with cross-document line frequency, in DataFrame functions only.

A text is judged by its own words, symbols and repeats. Its lines, normalised and hashed, are counted over the
distinct documents of its host; a line in more documents than the limits allow is furniture of the host and is
taken out. A document that the removals deplete is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line is furniture in more than so many documents of a host and more than this share of them.
MIN_DOCS, MAX_SHARE = 20, 0.01
#: A document is depleted if fewer words than this, or less than this share of its words, remain.
MIN_LEFT, MIN_SHARE_LEFT = 10, 0.3
#: The base rules: fewest words, largest percentage of repeated words, words of a repeated window.
MIN_WORDS, MAX_REPEAT, WINDOW = 10, 20, 5
WHITE = "[\\x20\\x09-\\x0D]"


def word_list(text: Column) -> Column:
    """Runs outside ASCII white space."""
    return F.filter(F.split(text, WHITE + "+"), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that occur twice or more in a word list.

    Windows are compared by 64-bit hashes. A text whose windows all differ costs one pass; else the hashes are
    sorted with their places, and the places of equal neighbours, sorted, cover min(window, gap) words each.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(window)]))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(p: Column) -> Column:
            last = F.size(p) - 1
            at = F.transform(
                p,
                lambda e, j: F.when(
                    ((j > 0) & (F.get(p, F.greatest(j - 1, F.lit(0)))["x"] == e["x"])) | ((j < last) & (F.get(p, F.least(j + 1, last))["x"] == e["x"])),
                    e["i"],
                ),
            )
            return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

        def total(s: Column) -> Column:
            step = F.aggregate(
                s,
                F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1 - window).alias("last")),
                lambda a, i: F.struct((a["sum"] + F.least(F.lit(window), i - a["last"])).cast("long").alias("sum"), i.alias("last")),
                lambda a: a["sum"],
            )
            return step

        return bind(placed, lambda p: bind(places(p), lambda s: total(s)))

    return F.when(n < window, F.lit(0).cast("long")).otherwise(
        bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    )


def blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\x0b\f\r", "    ")) == ""


def line_norm(line: Column) -> Column:
    """Lower case, white space trimmed at the ends."""
    return F.lower(F.trim(line))


def cleaned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE,
    min_left: int = MIN_LEFT, min_share_left: float = MIN_SHARE_LEFT,
) -> DataFrame:
    """Rows (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left, kept, clean_text).

    clean_text is the text without its furniture lines (null for null), n_left its words, all other lines as they were. Null and empty texts have no words and fail. Rows without host form one host of their own. Rows equal in
    id, host and text count as one document of the line counts, and each gets its row; null ids too. Lines are
    counted by 64-bit hashes of (host, normalised line). Further columns, whatever their names, are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(host_col).cast("string"), F.lit("\0"))).alias("host"), text.alias("text"), F.col(text_col).isNull().alias("was_null"))
    base = base.withColumn("key", F.xxhash64(F.col("id"), "host", "text"))
    lines = F.filter(F.split("text", "\n"), lambda x: ~blank(x))
    per_doc = base.select("key", "host", F.explode(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(line_norm(x))))).alias("line"))
    copies = base.groupBy("key", "host").agg(F.count("*").alias("rows"))
    hosts = copies.groupBy("host").agg(F.count("*").alias("docs"))
    # Rows of repeated keys are one document: each of its rows counts for 1 / rows.
    repeated = copies.where("rows > 1").select("key", "rows")
    counted = per_doc.join(repeated, "key", "left").groupBy("host", "line").agg(F.round(F.sum(1.0 / F.coalesce("rows", F.lit(1))), 6).alias("n"))
    limit = F.greatest(F.lit(float(min_docs)), F.col("docs") * max_share)
    furniture = counted.where(F.col("n") > min_docs).join(hosts, "host").where(F.col("n") > limit).select("host", "line")
    gone = per_doc.join(furniture, ["host", "line"], "left_semi").groupBy("key").agg(F.collect_set("line").alias("gone"))
    words = word_list(F.col("text"))
    measured = base.select(
        "id", "key", "text", "was_null", F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", WHITE + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        bind(words, lambda w: repeated_words(w)).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    stay = F.filter(F.split("text", "\n"), lambda x: blank(x) | ~F.array_contains("gone", F.xxhash64(line_norm(x))))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    left = F.when(F.col("gone").isNull(), F.col("n_words")).otherwise(F.size(word_list(F.col("clean_text"))).cast("long"))
    out = measured.join(gone, "key", "left").withColumn("base_failed", failed).withColumn("clean_text", text).withColumn("n_left", left)
    kept = ~F.col("base_failed") & (F.col("n_left") >= min_left) & (F.col("n_left") >= min_share_left * F.col("n_words"))
    clean = F.when(~F.col("was_null"), F.col("clean_text"))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", kept.alias("kept"), clean.alias("clean_text")
    )


def quality(docs: DataFrame, *args, **kwargs) -> DataFrame:
    """The rows of cleaned() without the text."""
    return cleaned(docs, *args, **kwargs).drop("clean_text")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, words[i:i + 4] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
ln AS (SELECT doc_id, host, lower(trim(x, ' ')) AS line, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS k
       FROM (SELECT doc_id, host, unnest(lines) AS x FROM w)),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
cnt AS (SELECT host, line, count(DISTINCT doc_id) AS n FROM ln GROUP BY host, line),
furn AS (SELECT c.host, c.line FROM cnt c JOIN hosts h ON c.host = h.host WHERE c.n > 20 AND c.n > h.docs * 0.01),
gone AS (SELECT doc_id, sum(k) AS gone FROM ln JOIN furn USING (host, line) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(words) - coalesce(gone.gone, 0) AS BIGINT) AS n_left
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id LEFT JOIN gone ON w.doc_id = gone.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left,
       NOT base_failed AND n_left >= 10 AND n_left >= 0.3 * n_words AS kept FROM f
"""
