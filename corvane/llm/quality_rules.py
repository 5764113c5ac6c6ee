"""Operator 4, quality rules, by a rule bitmask ledger, natively.

Every text is measured once and every rule evaluated once. The ledger keeps the measurements and one
bit for each failed rule. A policy is a named mask over those bits, so a new version of a policy,
and what each rule alone rejects, are bitwise operations on the ledger and never touch a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition over the measurements; null counts as not failed."""

    name: str
    fails: str


#: Bit i of the ledger is rule i. New rules go to the end, so stored ledgers keep their meaning.
RULES = (
    Rule("too_few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_word_lines"),
    Rule("shouting", "2 * n_upper > word_chars"),
    Rule("odd_word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules: a document is rejected if it fails any of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, r in enumerate(RULES) if r.name in self.rules)


BASE = Policy("base", 1, ("too_few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(r.name for r in RULES))
#: For sources of code, lists and tables, where symbols, short words and repeated lines are no fault.
LENIENT = Policy("lenient", 1, ("too_few_words", "repeated_windows", "shouting"))


def words_of(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.coalesce(F.array_remove(F.split(text, SPACE + "+"), ""), F.array().cast("array<string>"))


def _repeat_words(words: Column, window: int) -> Column:
    """Words in windows that a text holds twice or more, each word once.

    Windows are compared by a 64-bit hash within one text. Only texts that repeat one are sorted.
    """
    n = F.size(words)
    hashes = F.transform(
        F.slice(words, 1, F.greatest(n - (window - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, window)]),
    )
    return F.when(n >= window + 1, hashes).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column, window: int) -> Column:
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.element_at(F.transform(F.array(at), lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))),
            F.lit(0).cast("long"), lambda acc, x: acc + x)), 1)

    repeated = F.element_at(F.transform(F.array(ordered), covered), 1)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(repeated)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Measurements of every row of ``docs``, one row each, with the whole row in ``row`` if it is to be carried."""
    text = F.col("text")
    # without a default split keeps no empty line at the end; -1 does
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    row = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *row)
    kept = ["doc_id", *["row"] * carry]
    parts = rows.select(*kept, "text", words_of(text).alias("words"), lines.alias("lines"))
    hashed = parts.select(
        *kept,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_word_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), WINDOW).alias("hashes"),
    )
    return hashed.withColumn("n_repeat_words", _covered(F.col("hashes"), WINDOW)).drop("hashes")


def ledger(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """The rule ledger: measurements and ``failed``, the bits of the rules that each row fails.

    Null and empty texts measure 0 everywhere and fail what their measurements fail. Repeated rows are
    measured each. An empty table gives an empty ledger. No shuffle, no Python.
    """
    measured = measure(docs, id_col, text_col, carry)
    bits = [F.when(F.coalesce(F.expr(r.fails), F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed.cast("long"))


def apply_policy(rows: DataFrame, policy: Policy = STANDARD, base: Policy = BASE) -> DataFrame:
    """``rows`` of a ledger with ``base_failed`` and ``kept`` under a policy."""
    base_failed = F.col("failed").bitwiseAND(F.lit(base.mask)) != 0
    return rows.withColumn("base_failed", base_failed).withColumn(
        "kept", ~base_failed & (F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)
    )


def good_documents(docs: DataFrame, policy: Policy = STANDARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their columns as they were."""
    judged = apply_policy(ledger(docs, RULES, id_col, text_col, carry=True), policy)
    # one row in, one row out: a generator's output is what a filter can't be rewritten over, and without it the
    # optimizer copies every measurement into the condition
    verdict = judged.select("row", F.explode(F.array(F.struct("kept"))).alias("verdict"))
    return verdict.where("verdict.kept").select("row.*")


def ablation(rows: DataFrame, policy: Policy = STANDARD, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule, n_failed, n_only): for each rule of a policy, rows that fail it, and rows kept without it.

    The ledger is first counted by its bits, of which there are few values, so the rest runs over those.
    """
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).count()
    of_policy = [(i, r.name) for i, r in enumerate(rules) if policy.mask >> i & 1]
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, n in of_policy]))
    each = counts.select("bits", "count", named.alias("r")).select("bits", "count", "r.*")
    zero = F.lit(0).cast("long")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count")).otherwise(zero)).alias("n_only"),
    )
