"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at one signal of a text and votes good, votes bad, or abstains.  How far a rule
can be trusted is not set by hand: with the true class hidden, expectation-maximisation
estimates each rule's accuracy on good and on bad texts and the share of good texts, and a
text's verdict is its posterior probability of being good.  Every rule votes both ways: a clear
good value is a good vote, and between the two bounds the rule abstains.  So several good votes can
outweigh a bad one, and bad votes of weak rules add up.

DataFrame functions only.  Equal vote patterns are counted first (at most 3 ** rules rows), so
an iteration never reads documents again.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import free_name

SPACE = r"[\x20\x09-\x0D]"
GOOD, BAD, ABSTAIN = 1, 0, -1
TOLERANCE = 1e-6
FIRST_ACCURACY = 0.9
# no outcome of a rule, and neither class, is taken for rarer than this: so one vote alone never decides against all others
FLOOR = 0.01
WINDOW = 5
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals", "n_ends", "n_alone", "n_distinct_words")


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are SQL conditions over the signals; neither true (or null): abstain."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    Rule("capitals", "n_letters >= 20 and n_capitals > 0.5 * n_letters", "n_letters >= 20 and n_capitals <= 0.15 * n_letters"),
    Rule("repeats", "n_repeat_words > 0.2 * n_words", "n_words >= 20 and n_repeat_words <= 0.05 * n_words"),
    Rule("lines", "n_lines >= 4 and n_dup_lines > 0.3 * n_lines", "n_lines >= 4 and n_dup_lines <= 0.05 * n_lines"),
    Rule("word length", "n_words >= 10 and (word_chars > 14 * n_words or word_chars < 2.5 * n_words)", "n_words >= 10 and word_chars between 3.5 * n_words and 7 * n_words"),
    Rule("sentence ends", "n_words >= 20 and n_ends > 0.5 * n_words", "n_words >= 20 and n_ends between 0.01 * n_words and 0.25 * n_words"),
    Rule("signs", "n_letters < 0.75 * word_chars", "n_words >= 10 and n_letters >= 0.9 * word_chars"),
    Rule("lone signs", "n_alone > 0.1 * n_words", "n_words >= 10 and n_alone <= 0.02 * n_words"),
    Rule("variety", "n_words >= 30 and n_distinct_words < 0.15 * n_words", "n_words >= 30 and n_distinct_words >= 0.3 * n_words"),
)


def signals(docs: DataFrame, into: str = "signals") -> DataFrame:
    """``docs`` with a struct of counts over the whole ``text`` (null: no words).

    ``n_letters`` counts digits too; ``n_alone`` counts signs that stand between spaces.  ``n_repeat_words`` counts words inside 5-word windows that occur twice or more.  Windows are
    hashed to 64 bits; only texts that hold a hash twice take the second, sorting step.
    """
    t, w, h, p, d, s = (free_name(docs, f"_{c}") for c in ("text", "words", "hashes", "pairs", "places", "lines"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.withColumn(t, text).withColumns(
        {
            w: F.filter(F.split(F.col(t), f"{SPACE}+"), lambda x: x != ""),
            s: F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    window = lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(WINDOW)])
    several = F.size(w) >= WINDOW
    hashed = base.withColumn(h, F.when(several, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), window)).otherwise(F.expr("cast(array() as array<bigint>)")))
    twice = F.size(F.array_distinct(h)) < F.size(h)
    none = F.expr("cast(array() as array<struct<h: bigint, i: int>>)")
    paired = hashed.withColumn(p, F.when(twice, F.array_sort(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(none))
    same = lambda x, k: F.coalesce(F.get(F.col(p), k)["h"] == x["h"], F.lit(False))
    placed = paired.withColumn(d, F.array_sort(F.transform(F.filter(F.col(p), lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    # a window covers five words, less where the next repeated window begins earlier
    covered = F.aggregate(F.transform(F.col(d), lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(d), k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("bigint"), lambda a, n: a + n)
    without = lambda pattern: F.length(F.regexp_replace(F.col(t), pattern, ""))
    long = lambda c: c.cast("bigint")
    found = F.struct(
        long(F.size(w)).alias("n_words"),
        long(without(f"{SPACE}+")).alias("word_chars"),
        long(F.length(t) - without(r"[#*$%&|<>]+")).alias("n_symbols"),
        long(F.size(s)).alias("n_lines"),
        long(F.size(s) - F.size(F.array_distinct(s))).alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        long(without(r"[^\p{L}\p{N}]+")).alias("n_letters"),
        long(F.length(t) - without(r"\p{Lu}+")).alias("n_capitals"),
        long(F.length(t) - without(r"[.!?]+")).alias("n_ends"),
        long(F.length(t) - without(rf"(?<={SPACE})[^\p{{L}}\p{{N}}\x20\x09-\x0D]+(?={SPACE})")).alias("n_alone"),
        long(F.size(F.array_distinct(w))).alias("n_distinct_words"),
    )
    return placed.select(*[c for c in docs.columns if c != into], found.alias(into))


def votes(found: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """One vote per rule, as an array of tinyints; ``found`` names the struct of signals."""
    bound = lambda sql: F.expr(re.sub(r"\b(" + "|".join(SIGNALS) + r")\b", rf"{found}.\1", sql))
    return F.array(*[F.when(bound(r.bad), BAD).when(bound(r.good), GOOD).otherwise(ABSTAIN).cast("tinyint") for r in rules])


@dataclass(frozen=True)
class Weights:
    """``good``: share of good texts; per rule the probabilities that its vote is bad or good, on good and on bad texts.

    How often a rule abstains (a short text gives it too little) does not depend on the class, so it says nothing.
    """

    good: float
    on_good: tuple[tuple[float, float], ...]
    on_bad: tuple[tuple[float, float], ...]

    def logs(self, vote: Column) -> tuple[Column, Column]:
        """Log probability of these votes and the class, for a good and for a bad text."""
        sides = []
        for share, rules in ((self.good, self.on_good), (1.0 - self.good, self.on_bad)):
            total = F.lit(math.log(share))
            for i, shares in enumerate(rules):
                bad, good = map(math.log, shares)
                v = F.get(vote, F.lit(i))
                total = total + F.when(v == BAD, bad).when(v == GOOD, good).otherwise(0.0)
            sides.append(total)
        return sides[0], sides[1]

    def posterior(self, vote: Column) -> Column:
        """Probability that a text with these votes is good."""
        good, bad = self.logs(vote)
        return 1.0 / (1.0 + F.exp(bad - good))


def fit(voted: DataFrame, rules: int = len(RULES), tolerance: float = TOLERANCE) -> Weights:
    """Estimate the weights from ``voted(votes)`` by expectation-maximisation.

    The first guess takes a text for bad (``FIRST_ACCURACY``) if any rule says so.  The estimate of
    every round is the likeliest one with all shares at ``FLOOR`` or more, so the likelihood never
    falls, and since it is bounded the rounds end: when a round adds less than ``tolerance`` a text.
    """
    return rounds(voted, rules, tolerance)[-1][0]


def rounds(voted: DataFrame, rules: int = len(RULES), tolerance: float = TOLERANCE) -> list[tuple[Weights, float]]:
    """Weights and mean log-likelihood of a text, round by round; without texts one round of even shares."""
    patterns = cut_lineage(voted.groupBy("votes").agg(F.count("*").cast("double").alias("n")).coalesce(1))
    suspect = F.array_contains("votes", F.lit(BAD).cast("tinyint"))
    now, _ = _maximise(patterns, F.when(suspect, 1.0 - FIRST_ACCURACY).otherwise(FIRST_ACCURACY), F.lit(0.0), rules)
    found: list[tuple[Weights, float]] = []
    while True:
        good, bad = now.logs(F.col("votes"))
        new, likelihood = _maximise(patterns, now.posterior(F.col("votes")), F.greatest(good, bad) + F.log1p(F.exp(-F.abs(good - bad))), rules)
        found.append((now, likelihood))
        if len(found) > 1 and not likelihood - found[-2][1] >= tolerance or likelihood == 0.0:
            return found
        now = new


def _maximise(patterns: DataFrame, good: Column, log: Column, rules: int) -> tuple[Weights, float]:
    """Likeliest shares when each pattern counts as good with probability ``good``; and the mean of ``log``."""
    weighed = patterns.select("votes", "n", (F.col("n") * good).alias("g"), (F.col("n") * (1.0 - good)).alias("b"), (F.col("n") * log).alias("log"))
    sums = [F.sum("n"), F.sum("log"), F.sum("g"), F.sum("b")]
    for i in range(rules):
        v = F.get(F.col("votes"), F.lit(i))
        sums += [F.sum(F.when(v == x, F.col(side))) for side in ("g", "b") for x in (BAD, GOOD)]
    row = [float(x or 0.0) for x in weighed.agg(*sums).first()]
    on_good = tuple(floored(row[4 + 4 * i : 6 + 4 * i]) for i in range(rules))
    on_bad = tuple(floored(row[6 + 4 * i : 8 + 4 * i]) for i in range(rules))
    return Weights(floored(row[2:4])[0], on_good, on_bad), row[1] / row[0] if row[0] else 0.0


def floored(counts: list[float], floor: float = FLOOR) -> tuple[float, ...]:
    """The likeliest shares for ``counts`` with every share at ``floor`` or more (even shares without counts)."""
    if sum(counts) <= 0:
        return tuple(1.0 / len(counts) for _ in counts)
    low: set[int] = set()
    while True:
        rest, total = 1.0 - floor * len(low), sum(c for i, c in enumerate(counts) if i not in low)
        more = {i for i, c in enumerate(counts) if i not in low and c * rest < floor * total}
        if not more:
            return tuple(floor if i in low else c * rest / total for i, c in enumerate(counts))
        low |= more
