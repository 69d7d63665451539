"""Names of known people found in narratives and blanked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A word begins with a letter; hyphens, apostrophes and spaces join the words of a name.
WORD = r"\p{L}[\p{L}\p{M}\p{N}_#]*"
TOKENS = WORD + r"|[^\p{L}]+"
JOINT = r"^[ \t\n'’-]{1,3}$"
#: Longest run of words that is looked up; a longer name is covered by overlapping runs.
MOST_WORDS = 3
#: A single word shorter than this is no name (particles such as "al", "de", "bin").
LEAST_LETTERS = 3
PERSON = "[PERSON]"


def tokens_of(text: Column) -> Column:
    """Words and what stands between them, in turn; joined they give the text again."""
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))


def name_grams(names: DataFrame, column: str) -> DataFrame:
    """Every run of one to three words of the names, in lower case and once."""
    words = F.regexp_extract_all(F.col(column), F.lit(WORD), F.lit(0))
    runs = F.expr(
        f"flatten(transform(sequence(1, {MOST_WORDS}), n -> CASE WHEN size(w) >= n "
        "THEN transform(sequence(0, size(w) - n), i -> array_join(slice(w, i + 1, n), ' ')) ELSE cast(array() AS array<string>) END))"
    )
    grams = names.select(words.alias("w")).select(F.explode(runs).alias("gram")).select(F.lower("gram").alias("gram"))
    return grams.where(F.col("gram").contains(" ") | (F.char_length("gram") >= LEAST_LETTERS)).distinct()


def _candidates(tokens: str) -> Column:
    """Runs of up to three words that begin with a capital: first and last token, words in lower case."""
    pair = f"{tokens}[i + 1] RLIKE j"
    return F.expr(
        f"""flatten(transform(filter(sequence(0, size({tokens}) - 1), i -> {tokens}[i] RLIKE '^\\\\p{{Lu}}'), i -> filter(array(
          named_struct('first', i, 'last', i, 'gram', lower({tokens}[i])),
          CASE WHEN i + 2 < size({tokens}) AND {pair} THEN named_struct('first', i, 'last', i + 2, 'gram', lower(concat_ws(' ', {tokens}[i], {tokens}[i + 2]))) END,
          CASE WHEN i + 4 < size({tokens}) AND {pair} AND {tokens}[i + 3] RLIKE j
            THEN named_struct('first', i, 'last', i + 4, 'gram', lower(concat_ws(' ', {tokens}[i], {tokens}[i + 2], {tokens}[i + 4]))) END), x -> x IS NOT NULL)))""".replace(
            " j", f" '{JOINT.replace(chr(39), chr(92) + chr(39))}'"
        )
    )


def redact_people(df: DataFrame, text: str, names: DataFrame, name: str, label: str = PERSON) -> DataFrame:
    """``text`` with the label in place of each name of ``names``.

    Capitalised runs of one to three words are looked up among the same runs of
    the known names, whatever their case there. All matches count: where they
    overlap or lie in one another they become one label, so the longest name
    found is blanked whole. The work is one row for each capitalised run, joined
    on the run; equal texts are judged once. Null and empty texts stay.
    """
    keyed = df.withColumn("_digest", F.sha2(text, 256))
    texts = keyed.select("_digest", tokens_of(F.col(text)).alias("_tokens")).where(F.size("_tokens") > 0)
    found = texts.select("_digest", F.inline(_candidates("_tokens"))).join(name_grams(names, name), "gram", "left_semi").select("_digest", "first", "last").distinct()
    # A text has few matches, each of them short: they are merged in the order of their first token.
    before = Window.partitionBy("_digest").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.col("first") > F.max("last").over(before), F.lit(True)).cast("int")
    upto = Window.partitionBy("_digest").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)
    runs = found.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(upto))
    runs = runs.groupBy("_digest", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    runs = runs.groupBy("_digest").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_runs"))
    joined = keyed.join(runs, "_digest", "left").withColumn("_tokens", F.when(F.col("_runs").isNotNull(), tokens_of(F.col(text))))
    kept = F.expr(
        """transform(sequence(0, size(_runs)), k -> array_join(slice(_tokens,
          CASE WHEN k = 0 THEN 1 ELSE _runs[k - 1].last + 2 END,
          CASE WHEN k = size(_runs) THEN size(_tokens) ELSE _runs[k].first END - CASE WHEN k = 0 THEN 0 ELSE _runs[k - 1].last + 1 END), ''))"""
    )
    blanked = F.when(F.col("_runs").isNull(), F.col(text)).otherwise(F.array_join(kept, label))
    return joined.withColumn(text, blanked).select(df.columns)
