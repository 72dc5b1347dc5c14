"""Quality rules: a threshold table compiled into Spark expressions, evaluated without user functions.

Every statistic is a built-in expression over one row, so the operator has no shuffle and scales with the scan.

Defined results: a null or empty text has no words and fails the base rule; very long texts are judged whole (repeats are
found by sorting window hashes, never pairwise); repeated rows are judged alike; an empty table gives an empty table; other
columns of the input pass through unless they carry the name of a statistic, which then replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, words

WINDOW = 5

# Frequent function words of languages in Latin script.
STOP_WORDS_BY_LANGUAGE = {
    "English": ("a", "an", "and", "are", "as", "at", "be", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"),
    "German": ("das", "der", "die", "ein", "ist", "mit", "und", "von", "zu"),
    "French": ("de", "des", "du", "et", "la", "le", "les", "un", "une"),
    "Spanish": ("con", "el", "en", "las", "los", "que", "se", "y"),
    "Italian": ("che", "di", "e", "il", "non", "per"),
    "Portuguese": ("com", "da", "do", "em", "não", "os", "para"),
    "Dutch": ("het", "een", "van", "dat", "niet", "op"),
    "Polish": ("i", "na", "nie", "się", "w", "z", "że"),
    "Czech": ("je", "na", "že", "v", "s"),
    "Swedish, Danish and Norwegian": ("och", "og", "att", "at", "som", "på", "er", "är", "av", "af", "för", "det"),
    "Finnish": ("ja", "on", "että", "ei", "oli"),
    "Hungarian": ("az", "és", "hogy", "nem"),
    "Romanian": ("și", "în", "nu", "cu", "pe"),
    "Turkish": ("ve", "bir", "bu", "için", "da"),
    "Indonesian": ("dan", "yang", "di", "untuk", "dengan", "ini"),
    "Vietnamese": ("và", "của", "là", "các", "có", "không"),
}
STOP_WORDS = tuple(sorted({w for words in STOP_WORDS_BY_LANGUAGE.values() for w in words}))


@dataclass(frozen=True)
class Rule:
    """Rejects a document if 100 * count leaves [low * per, high * per] and it has at least min_words words and min_latin per cent of ASCII letters among the characters of its words."""

    name: str
    count: str
    per: str
    low: int | None = None
    high: int | None = None
    min_words: int = 0
    min_latin: int = 0


#: Percentages. They were set on labelled rows so that no clean document is lost.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=150, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=25),
    Rule("exclamations", "n_exclaims", "n_words", high=30),
    Rule("upper_case", "n_upper_words", "n_words", high=60, min_words=20),
    Rule("stop_words", "n_stop_words", "n_words", low=3, min_words=50, min_latin=50),  # there are words for Latin script only
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50, min_words=20),
)


def _without(text: Column, pattern: str) -> Column:
    """Characters left when the pattern is taken out."""
    return F.length(F.regexp_replace(text, pattern, ""))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that the rules and the contract name (all bigint)."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_upper_words", "n_stop_words", "n_ellipsis_lines", "n_bullet_lines", "n_latin"]
    kept = [c for c in docs.columns if c not in made]
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*kept, words(F.col(text)).alias("__w"), F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("__l"))
    w, n = F.col("__w"), F.size("__w")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))))
    df = df.withColumn("__h", hashes)
    # Only a text that holds a repeated window sorts its windows.
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    m = F.size("__s")
    twins = F.zip_with(F.slice("__s", F.lit(1), m - 1), F.slice("__s", F.lit(2), m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("__p", F.when(F.col("__s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.array_compact(twins))))))
    steps = F.zip_with("__p", F.concat(F.slice("__p", F.lit(2), F.size("__p") - 1), F.array(F.lit(2**31 - 1))), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.col("__p").isNotNull(), F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, x: s + x)).otherwise(0)
    lines = F.col("__l")
    counts = {
        "n_words": n,
        "word_chars": _without(body, SPACE + "+"),
        "n_symbols": _without(body, r"[^#*$%&|<>]+"),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
        "n_lines": F.size(lines),
        "n_latin": _without(body, r"[^A-Za-z]+"),
        "n_exclaims": _without(body, r"[^!]+"),
        "n_upper_words": F.size(F.filter(w, lambda x: (F.length(x) > 1) & x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}"))),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("•"))),
    }
    # As a generator's output the counts can't be copied into filters below, where lambdas would split the text again and again.
    return df.select(*kept, F.inline(F.array(F.struct(*(c.cast("bigint").alias(k) for k, c in counts.items())))))


def violated(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row with statistics breaks, in the table's order."""
    def broken(r: Rule) -> Column:
        count, per = F.col(r.count) * 100, F.col(r.per)
        out = F.lit(False)
        if r.low is not None:
            out = out | (count < per * r.low)
        if r.high is not None:
            out = out | (count > per * r.high)
        return out & (F.col("n_words") >= r.min_words) & (100 * F.col("n_latin") >= r.min_latin * F.col("word_chars"))

    return F.array_compact(F.array(*(F.when(broken(r), F.lit(r.name)) for r in rules)))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with statistics, base_failed, failed_rules (names) and kept."""
    df = statistics(docs, text).drop("base_failed", "failed_rules", "kept")
    return df.withColumns({"base_failed": base_failed(), "failed_rules": violated(rules)}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with their own columns."""
    keep = docs.columns
    return judge(docs.withColumns({f"__{c}": F.col(c) for c in keep}), rules, text).where("kept").select(*(F.col(f"__{c}").alias(c) for c in keep))
