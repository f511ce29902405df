"""Operator 5: quality rules, a threshold table compiled into Spark projections without user functions.

Words are the runs of ``[^\\x20\\x09-\\x0D]+``. Every measure is an integer column and every rule
compares ``scale * numerator`` with ``bound * denominator``, so no rounding can move a verdict.

Edge cases: a null text counts as no words (all measures 0, base_failed, dropped); an empty text the
same; a text of any length is read whole; repeated rows give repeated results; extra columns of the
input are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
TRIM = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it on with as was are be this by or from "
    "le la les de des et en un une est que pour dans au "
    "der die das und den von zu mit ist ein dem sich nicht "
    "el los las del y es por con para una se no"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep when ``low * denominator <= scale * numerator <= high * denominator`` (None: no bound)."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None
    scale: int = 1000


#: Bounds in thousandths, but for the lengths.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2000, high=14000),
    Rule("symbol_share", "n_symbols", "n_words", high=200),
    Rule("stop_word_share", "n_stop_words", "n_words", low=20),
    Rule("dup_line_share", "n_dup_lines", "n_lines", high=300),
    Rule("bullet_line_share", "n_bullet_lines", "n_lines", high=900),
    Rule("ellipsis_line_share", "n_ellipsis_lines", "n_lines", high=300),
    Rule("alpha_word_share", "n_alpha_words", "n_words", low=700),
    Rule("shout_share", "n_shouts", "n_words", high=150),
)

_BITS = 20
_MASK = (1 << _BITS) - 1


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep + n_words and the counts that the rules compare, one row per document."""
    body = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(TRIM))
    none = F.array().cast("array<string>")
    a = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("whole"), body.alias("body"))
    # lines keep the white space around them: two lines are equal only character by character
    a = a.select(*keep, "body", F.when(F.col("body") == "", none).otherwise(F.split("body", SPACE)).alias("w"), F.filter(F.split("whole", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("w")
    w, lines = F.col("w"), F.col("lines")

    def packed(i: Column) -> Column:
        return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.cast("long"))

    stop = [*STOP_WORDS]
    b = a.select(
        *keep,
        "w",
        n.alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOLS)).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•–][\x20\x09]"))).alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("n_ellipsis_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).alias("n_stop_words"),
        F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).alias("n_alpha_words"),
        F.regexp_count("body", F.lit(r"!!")).alias("n_shouts"),
        # 44 bits of hash above 20 bits of position: one primitive sort brings equal windows together
        F.when((n >= 3) & (n <= _MASK), F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), packed))).otherwise(F.array().cast("array<bigint>")).alias("s"),
    )
    s = F.col("s")
    high = lambda x: F.shiftright(x, _BITS)
    c = b.withColumn("cand", F.filter(s, lambda x, i: (high(x) == high(F.get(s, i - 1))) | (high(x) == high(F.get(s, i + 1)))))
    cand = F.col("cand")
    at = lambda x, k: F.get(w, x.bitwiseAND(F.lit(_MASK)).cast("int") + k)
    differ = lambda x, y: (at(x, 0) != at(y, 0)) | (at(x, 1) != at(y, 1)) | (at(x, 2) != at(y, 2))
    unsure = F.exists(F.transform(cand, lambda x, i: (high(x) == high(F.get(cand, i - 1))) & differ(x, F.get(cand, i - 1))), lambda x: x)
    fast = F.transform(cand, lambda x: x.bitwiseAND(F.lit(_MASK)).cast("int"))
    d = c.withColumn("at", F.sort_array(F.when((F.col("n_words") > _MASK) | F.coalesce(unsure, F.lit(False)), _exact(w)).otherwise(fast)))
    pos = F.col("at")
    covered = F.aggregate(F.transform(pos, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(pos, i + 1) - x, F.lit(3)))), F.lit(0), lambda x, y: x + y)
    names = [c for c in d.columns if c not in (*keep, "w", "s", "cand", "at")]
    return d.select(*keep, *[F.col(x).cast("long").alias(x) for x in names], covered.cast("long").alias("n_repeat_words"))


def _exact(w: Column) -> Column:
    """Start positions of repeated 3-word windows by comparing the words themselves (any length)."""
    window = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    s = F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.struct(window(i).alias("g"), i.alias("i"))))
    same = lambda x, y: x["g"] == y["g"]
    return F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["i"])


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression; a rule with a zero denominator passes."""
    out = F.lit(True)
    for r in rules:
        left, right = F.col(r.numerator) * F.lit(r.scale), F.col(r.denominator)
        if r.low is not None:
            out &= left >= right * F.lit(r.low)
        if r.high is not None:
            out &= left <= right * F.lit(r.high)
    return out


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document with every measure, base_failed and kept."""
    m = measures(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))
