"""Operator 9: quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document's statistics. Documents are counted by their pattern of votes,
so what expectation-maximisation reads is at most 3^rules rows, whatever the corpus; it estimates how often each rule casts
each vote on good and on bad documents, and the share of good ones. A document's posterior probability of being good
follows from its votes alone; it replaces the demand that all rules pass. Only DataFrame expressions touch documents.

Windows of three words that a text repeats are found within its row: each window's hash, with its place in the low bits, is
sorted as a number, so equal windows become neighbours. The hash keeps 64 bits less those that number the words.

Defined results: null and empty texts have no words; they fail the base rules. Repeated rows each count and each get the same result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoline.llm.common import stored

# Members of regular expression classes.
SPACES = " \\x09-\\x0D"
SYMBOLS = "#*$%&|<>"


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_different, n_capitals, n_shouts (all long)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(f"[^{SPACES}]"))
    words = F.array_remove(F.split(whole, f"[{SPACES}]+"), "")
    rows = docs.withColumn("_words", words).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_word_chars", F.length(F.array_join("_words", ""))).drop("_words")
    rows = rows.withColumn("_lines", F.transform(lines, lambda line: F.xxhash64(line)))
    # The few characters that are counted, in one pass; each kind is counted in what is left.
    rows = rows.withColumn("_marks", F.regexp_replace(whole, f"[^{SYMBOLS}!?A-Z]+", ""))
    # Enough low bits to number the words.
    rows = rows.withColumn("_n", F.size("_hashes")).withColumn("_bits", F.length(F.bin("_n")))
    window = lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2))
    keyed = F.transform(
        F.slice("_hashes", 1, F.greatest(F.col("_n") - 2, F.lit(0))),
        lambda h, i: F.call_function("shiftleft", window(h, i), F.col("_bits")).bitwiseOR(i.cast("long")),
    )
    rows = rows.withColumn("_keys", F.sort_array(keyed)).withColumn("_mask", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1)
    # Neighbours that differ in no more than the place are the same window twice.
    after = F.slice("_keys", F.lit(2), F.greatest(F.size("_keys"), F.lit(1)))
    pairs = F.zip_with("_keys", after, lambda a, b: F.when(a.bitwiseXOR(b).between(0, F.col("_mask")), F.array(a, b)))
    rows = rows.withColumn("_pairs", F.filter(pairs, lambda p: p.isNotNull()))
    starts = F.transform(F.flatten("_pairs"), lambda x: x.bitwiseAND(F.col("_mask")))
    rows = rows.withColumn("_starts", F.sort_array(F.array_distinct(starts)))
    three = F.lit(3).cast("long")
    covered = F.transform("_starts", lambda s, k: F.least(three, F.coalesce(F.get("_starts", k + 1) - s, three)))
    kind = lambda pattern: F.length(F.regexp_replace("_marks", f"[^{pattern}]+", "")).cast("long")
    return rows.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": F.col("_word_chars").cast("long"),
            "n_symbols": kind(SYMBOLS),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x),
            "n_different": F.size(F.array_distinct("_hashes")).cast("long"),
            "n_capitals": kind("A-Z"),
            "n_shouts": kind("!?"),
        }
    ).drop("_hashes", "_lines", "_n", "_bits", "_keys", "_mask", "_pairs", "_starts", "_word_chars", "_marks")


def _between(value: Column, bad: Column, good: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def rule_votes() -> dict[str, Column]:
    """The rules, on the columns of `statistics`. The bounds lie apart, so that a rule abstains where it can't tell."""
    n = F.when(F.col("n_words") > 0, F.col("n_words"))
    mean = F.col("word_chars") / n
    repeats, different = F.col("n_repeat_words") / n, F.col("n_different") / n
    symbols, shouts = F.col("n_symbols") / n, F.col("n_shouts") / n
    characters = F.when(F.col("word_chars") > 0, F.col("word_chars"))
    capitals, share = F.col("n_capitals") / characters, F.col("n_symbols") / characters
    lines = F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines"))
    return {
        "v_length": _between(n, n < 50, n >= 80),
        "v_word_length": _between(mean, (mean < 3) | (mean > 12), (mean >= 3.5) & (mean <= 9)),
        "v_repeats": _between(repeats, repeats > 0.3, repeats <= 0.1),
        "v_different": _between(different, (n >= 50) & (different < 0.2), different >= 0.35),
        "v_symbols": _between(symbols, symbols > 0.1, symbols <= 0.02),
        "v_symbol_share": _between(share, share > 0.02, share <= 0.005),
        "v_shouts": _between(shouts, shouts > 0.3, shouts <= 0.1),
        "v_capitals": _between(capitals, capitals > 0.3, capitals <= 0.1),
        "v_lines": _between(lines, lines > 0.3, lines <= 0.1),
    }


# What a rule's votes (bad, abstain, good) are taken to be on good and on bad documents before any are seen: a rule seldom finds
# fault with a good document, and a bad one has few of the faults. They, and the share of good ones, weigh as much as a tenth of the documents.
BEFORE = {-1: (0.01, 0.3), 0: (0.04, 0.1), 1: (0.95, 0.6)}
BEFORE_WEIGHT = 0.1
SHARE = 0.8


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over (votes, number of documents). Gives the share of good documents and, for each rule and
    vote, its probability on good and on bad ones. It starts from doubt about documents with any vote for bad, the rarer and
    more telling kind, which fixes which class is the good one; the same belief, as a prior, keeps a class of lone faults apart.
    """
    width = len(patterns[0][0]) if patterns else 0
    total = sum(n for _, n in patterns)
    weight = [0.9 if min(v) >= 0 else 0.1 for v, _ in patterns]
    prior = BEFORE_WEIGHT * total + 1
    share, table = 0.5, []
    for _ in range(rounds):
        good = sum(w * n for w, (_, n) in zip(weight, patterns))
        new_share = (good + SHARE * prior) / (total + prior)
        table = []
        for j in range(width):
            cast = {}
            for vote in (-1, 0, 1):
                g = sum(w * n for w, (v, n) in zip(weight, patterns) if v[j] == vote)
                b = sum((1 - w) * n for w, (v, n) in zip(weight, patterns) if v[j] == vote)
                on_good, on_bad = BEFORE[vote]
                cast[vote] = ((g + on_good * prior) / (good + prior), (b + on_bad * prior) / (total - good + prior))
            table.append(cast)
        weight = [_posterior(v, new_share, table) for v, _ in patterns]
        if abs(new_share - share) < 1e-9:
            break
        share = new_share
    return new_share if patterns else 0.5, table


def _posterior(votes: tuple[int, ...], share: float, table: list[dict[int, tuple[float, float]]]) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(t[v][0] / t[v][1]) for v, t in zip(votes, table))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def judge(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The other columns of ``docs``, with the statistics, base_failed, p_good (posterior) and kept. Same names are replaced.

    The statistics, a few numbers a row, are written once and read by the estimate and by the result. Documents that fail the
    base rules are decided by them and don't enter the estimate.
    """
    rules = rule_votes()
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stored(statistics(docs, text).drop(text).withColumn("base_failed", base), "statistics").withColumns(rules)
    counted = rows.filter("NOT base_failed").groupBy(*rules).count().collect()  # at most 3^rules rows
    patterns = sorted((tuple(r[v] for v in rules), r["count"]) for r in counted)
    share, table = fit(patterns)
    odds = F.lit(math.log(share / (1 - share)))
    for name, cast in zip(rules, table):
        for vote, (g, b) in cast.items():
            odds = odds + F.when(F.col(name) == vote, math.log(g / b)).otherwise(0.0)
    out = rows.withColumn("p_good", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least)).drop(*rules)
