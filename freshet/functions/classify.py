"""Level and department rules over titles and feed hints."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import vocab
from freshet.functions.text import WORD_END, WORD_START, fold, let, squeeze


def word_pattern(words: tuple[str, ...], start: str = WORD_START, end: str = WORD_END) -> str:
    """The words of one rule; see `vocab.DEPARTMENT_WORDS` for the word notation."""
    whole = [re.escape(w) for w in words if w[-1] not in "*>"]
    ending = [re.escape(w[:-1]) for w in words if w[-1] == ">"]
    parts = [re.escape(w[:-1]) for w in words if w[-1] == "*"]
    edged = [f"{start}(?:{'|'.join(whole)}){end}"] if whole else []
    edged += [f"(?:{'|'.join(ending)}){end}"] if ending else []
    return "|".join(edged + parts)


def names_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands in the text.

    A word part needs only a substring search, and the pattern for whole words runs only over
    texts that contain one of them at all.
    """
    parts = [text.contains(w[:-1]) for w in words if w.endswith("*")]
    strict = tuple(w for w in words if not w.endswith("*"))
    if strict:
        near = reduce(or_, [text.contains(w.rstrip(">")) for w in strict])
        parts.append(near & text.rlike(word_pattern(strict)))
    return reduce(or_, parts)


def _first_rule(text: Column, rules, fallback: str) -> Column:
    def pick(value: Column) -> Column:
        result = F.lit(fallback)
        for name, words in reversed(rules):
            result = F.when(names_any(value, words), F.lit(name)).otherwise(result)
        return result

    return let(text, pick)


def level_of(title: Column) -> Column:
    """highest level named in the title."""
    return _first_rule(fold(title), vocab.LEVEL_WORDS, "mid")


def department_of_title(title: Column) -> Column:
    """F8: first department whose words stand in the title."""
    return _first_rule(F.lower(title), vocab.DEPARTMENT_WORDS, vocab.DEPARTMENT_FALLBACK)


def department_key(name: Column) -> Column:
    """folded name without a leading cost-centre code."""
    return squeeze(F.regexp_replace(fold(name), r"^\d+\s*-\s*", ""))


def department_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(vocab.DEPARTMENT_NAMES.items()), "key string, bucket string")


def map_department(df: DataFrame, hints: str, id_col: str, dictionary: DataFrame) -> DataFrame:
    """(id, department, unmapped) from the first hint that the dictionary knows.

    A hint after the first known one is not looked at. Keys are unique in the dictionary, which Spark
    broadcasts when it is small and shuffles when it is not.
    """
    non_answers = ["", *vocab.DEPARTMENT_NON_ANSWERS]
    asked = (
        df.select(id_col, F.posexplode_outer(hints).alias("pos", "hint"))
        .withColumn("key", F.coalesce(department_key(F.col("hint")), F.lit("")))
        .join(dictionary, "key", "left")
    )
    known = F.when(F.col("bucket").isNotNull(), F.col("pos"))
    unknown = F.when(F.col("bucket").isNull() & ~F.col("key").isin(*non_answers), F.struct("pos", "key"))
    per_row = asked.groupBy(id_col).agg(
        F.min(known).alias("hit"),
        F.min_by("bucket", known).alias("department"),
        F.array_sort(F.collect_list(unknown)).alias("missed"),  # as long as one row's own hint list
    )
    before_hit = F.filter("missed", lambda m: F.col("hit").isNull() | (m["pos"] < F.col("hit")))
    return per_row.select(id_col, "department", F.transform(before_hit, lambda m: m["key"]).alias("unmapped"))
