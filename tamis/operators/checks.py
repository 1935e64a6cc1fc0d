"""A registry of rule checks over conversation turns: every check is a condition on a turn's columns, and all of them are tried."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import grams as G
from tamis.functions import text as T

#: Phrases of assistants and of their excuses, as the rules list them.
ASSISTANT_PHRASES = (
    "as an ai", "language model", "great question", "feel free to", "i'm here to help", "i am here to help", "certainly!", "happy to help", "i hope this helps",
    "as a virtual", "i'm just an ai", "i am just an ai", "artificial intelligence", "large language", "how can i assist", "is there anything else i can",
)
EXCUSES = (
    "i don't have access", "i do not have access", "i can't remember", "i cannot remember", "i don't remember", "i do not remember", "i have no memory", "i can't recall",
    "i cannot recall", "i don't retain", "i'm not able to remember", "i am not able to remember", "i don't keep track",
)
#: Patterns that Java's engine and RE2 read alike.
PATTERNS = {
    "DASH": "—|--", "DIGIT": "[0-9]", "MARKDOWN": r"(?:^|\n)(?:#{1,6} |[-*] |```)", "EMOJI": r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]",
    "THOUGHT_TAG": r"<\s*/?\s*(?:note|think)\s*>", "LOOKUP_TAG": r"<\s*/?\s*(?:lookup|result)\s*>", "ROLE_LABEL": r"(?:^|\n)\s*(?:User|Assistant|System)\s*:",
    "STAGE_DIR": r"\*[a-z][^*\n]{2,}\*", "END_TOKEN": r"(?:^|[^A-Za-z])END(?:[^A-Za-z]|$)",
}
LONE_I = r"(?:^|[^A-Za-z'])i(?:[^A-Za-z]|$)"
LEAST_WORDS, MOST_WORDS, REPEATS, COVERED = 3, 60, 3, 0.25


def has_phrase(phrases: tuple[str, ...]) -> Callable[[], Column]:
    pattern = "(?:^|[^a-z])(?:" + "|".join(phrases) + ")"
    return lambda: F.replace(F.lower("t"), F.lit("’"), F.lit("'")).rlike(pattern)


def covered_by_repeats(words: Column) -> Column:
    """Share of the words that stand in a run of one to four words which repeats the run just before it."""

    def marked(n: int) -> Column:
        at = F.when(F.size(words) >= 2 * n, F.sequence(F.lit(1), F.size(words) - (2 * n - 1))).otherwise(F.array().cast("array<int>"))
        again = F.filter(at, lambda j: F.slice(words, j, n) == F.slice(words, j + n, n))
        return F.flatten(F.transform(again, lambda j: F.sequence(j + n, j + (2 * n - 1))))

    return F.size(F.array_distinct(F.concat(*map(marked, (1, 2, 3, 4))))) / F.greatest(F.size(words), F.lit(1))


def _pattern(code: str) -> Callable[[], Column]:
    return lambda: F.col("t").rlike(PATTERNS[code])


#: Code -> condition over the columns t (text), role, w (words) and four (sorted runs of four words), in the order in which the first one counts as primary.
REGISTRY: dict[str, Callable[[], Column]] = {
    "EMPTY_TURN": lambda: F.trim("t") == "",
    **{code: _pattern(code) for code in PATTERNS},
    "LEN": lambda: ~F.size("w").between(LEAST_WORDS, MOST_WORDS),
    "REPEAT_4GRAM": lambda: G.has_repeat(F.col("four"), REPEATS),
    "CONSEC_REP": lambda: (F.size("w") >= 8) & (covered_by_repeats(F.col("w")) >= COVERED),
    "NON_ENGLISH": lambda: T.non_ascii_letter_ratio(F.col("t")) > 0,
    "NO_STOPWORD": lambda: (F.size("w") >= 8) & ~F.arrays_overlap("w", F.array(*map(F.lit, T.STOPWORDS.split()))),
    "AI_ISM": has_phrase(ASSISTANT_PHRASES),
    "DEFLECT": lambda: (F.col("role") == "assistant") & has_phrase(EXCUSES)(),
    "ASSIST_CASE": lambda: (F.col("role") == "assistant") & (F.regexp_extract("t", "[A-Za-z]", 0).rlike("^[a-z]") | F.col("t").rlike(LONE_I)),
}


def checked(turns: DataFrame, checks: dict[str, Callable[[], Column]] = REGISTRY) -> DataFrame:
    """The turns with `codes`, the checks that hold, in the registry's order. Null texts are empty turns."""
    worded = turns.withColumn("t", F.coalesce("text", F.lit(""))).withColumn("w", T.words(F.col("t")))
    ordered = worded.withColumn("four", F.array_sort(G.grams(F.col("w"), 4)))
    codes = F.array_compact(F.array(*(F.when(test(), F.lit(code)) for code, test in checks.items())))
    return ordered.withColumn("codes", codes).drop("t", "w", "four")


def code_table(coded: DataFrame) -> DataFrame:
    """(code, hits, primary_hits, only_hits) from rows with `codes`."""
    # outer: of a plain explode Spark infers a filter on the size of `codes`, and works all of it out again there
    each = coded.select(F.explode_outer("codes").alias("code"), F.try_element_at("codes", F.lit(1)).alias("first"), F.size("codes").alias("n")).where("code is not null")
    return each.groupBy("code").agg(F.count("*").alias("hits"), F.count_if(F.col("code") == F.col("first")).alias("primary_hits"), F.count_if(F.col("n") == 1).alias("only_hits"))


def rule_holds(rule: str, text: Column, argument: str = "") -> Column:
    """Whether a reply keeps a rule: caps, lowercase, first_word, word, question_end or brackets."""
    letters, small = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Lu}"))
    words, end = T.words(text), F.regexp_replace(text, r"[\s\"'*_)\]]+$", "")
    rules = {
        "caps": lambda: (letters >= 5) & (small / F.greatest(letters, F.lit(1)) >= 0.9),
        "lowercase": lambda: (letters >= 5) & (small == 0),
        "first_word": lambda: F.coalesce(F.try_element_at(words, F.lit(1)) == argument, F.lit(False)),
        "word": lambda: F.array_contains(words, argument),
        "question_end": lambda: F.endswith(end, F.lit("?")),
        "brackets": lambda: F.trim(text).rlike(r"^\[[\s\S]*\]$"),
    }
    return rules[rule]()


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
