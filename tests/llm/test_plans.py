"""The packing plan on histograms alone, and the weak supervision of quality on votes alone."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoweave.llm import packing, quality

SPREAD = np.random.default_rng(5)
HISTOGRAMS = {
    "even": {n: 40 for n in range(2, 2048)},
    "hot": {**{int(n): int(c) for n, c in zip(SPREAD.choice(np.arange(2, 2048), 1500, replace=False), SPREAD.integers(1, 60, 1500))}, 700: 20_000},
    "middle": {int(n): int(c) for n, c in zip(range(300, 1000, 7), SPREAD.integers(1, 1000, 100))},
    "huge counts": {n: 10**9 for n in (340, 512, 683, 684, 900, 1100)},
    "one": {2048: 7},
    "none": {},
}


def sequences(plan):
    return sum(times for _, times in plan)


def piecewise_best_fit(histogram, capacity):
    """Best fit, longest first, one piece at a time."""
    rooms = Counter()
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            room = min((r for r in rooms if r >= size), default=None)
            if room is None:
                room = capacity
            else:
                rooms[room] -= 1
                rooms += Counter()
            rooms[room - size] += 1
    return sum(rooms.values())


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_plan_holds_every_piece_and_is_never_longer_than_best_fit(name):
    histogram = HISTOGRAMS[name]
    plan = packing.plan(histogram)
    held = Counter()
    for shape, times in plan:
        assert times > 0 and sum(n * k for n, k in shape.items()) <= packing.CAPACITY
        for n, k in shape.items():
            held[n] += k * times
    assert held == Counter(histogram)
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[n] for n in sorted(histogram)], dtype=np.int64)
    assert sequences(plan) <= sum(packing.best_fit(lengths, counts, packing.CAPACITY).values())
    # equal sequences are counted, so the plan grows with the lengths only
    assert len(plan) <= 8 * len(histogram)


def test_linear_program_packs_better_than_best_fit():
    for name in ("middle", "huge counts"):
        histogram = HISTOGRAMS[name]
        lengths = np.array(sorted(histogram), dtype=np.int64)
        counts = np.array([histogram[n] for n in sorted(histogram)], dtype=np.int64)
        assert sequences(packing.plan(histogram)) < sum(packing.best_fit(lengths, counts, packing.CAPACITY).values())


def test_an_even_histogram_is_packed_full():
    assert sequences(packing.plan(HISTOGRAMS["even"])) == 40 * (1024 - 1) + 20


@pytest.mark.parametrize("seed", range(20))
def test_counted_best_fit_is_best_fit(seed):
    draw = np.random.default_rng(seed)
    lengths = np.unique(draw.integers(1, 41, 12))
    counts = draw.integers(1, 30, len(lengths))
    found = packing.best_fit(lengths, counts, 40)
    held = Counter()
    for shape, times in found.items():
        assert sum(int(lengths[at]) * k for at, k in shape) <= 40
        for at, k in shape:
            held[at] += k * times
    assert held == Counter(dict(enumerate(counts.tolist())))
    assert sum(found.values()) == piecewise_best_fit(dict(zip(lengths.tolist(), counts.tolist())), 40)


# per rule: how often its vote is bad on good texts and on bad texts; the last two are weak
BAD_SHARE = ((0.02, 0.9), (0.03, 0.85), (0.05, 0.8), (0.25, 0.6), (0.3, 0.6))
VOTES = "doc_id bigint, good int, votes array<tinyint>"


def drawn_votes(spark, n=20_000, good=0.8, voting=0.8):
    draw = np.random.default_rng(11)
    is_good = draw.random(n) < good
    bad = draw.random((n, len(BAD_SHARE))) < np.where(is_good[:, None], [g for g, _ in BAD_SHARE], [b for _, b in BAD_SHARE])
    votes = np.where(draw.random(bad.shape) < voting, np.where(bad, quality.BAD, quality.GOOD), quality.ABSTAIN)
    return is_good, votes, spark.createDataFrame([(i, int(g), v) for i, (g, v) in enumerate(zip(is_good, votes.tolist()))], VOTES)


def verdicts(spark, weights, patterns):
    frame = spark.createDataFrame([(i, 0, list(p)) for i, p in enumerate(patterns)], VOTES)
    return [r["p"] >= 0.5 for r in frame.select("doc_id", weights.posterior(F.col("votes")).alias("p")).orderBy("doc_id").collect()]


def test_accuracies_are_recovered_and_votes_outweigh_each_other(spark):
    is_good, votes, frame = drawn_votes(spark)
    found = quality.rounds(frame.select("votes"), len(BAD_SHARE))
    likelihood = [x for _, x in found]
    assert all(b >= a - 1e-9 for a, b in zip(likelihood, likelihood[1:])) and len(found) > 2
    weights = found[-1][0]
    assert abs(weights.good - is_good.mean()) < 0.03
    for (g, b), on_good, on_bad in zip(BAD_SHARE, weights.on_good, weights.on_bad):
        assert abs(on_good[0] - g) < 0.04 and abs(on_bad[0] - b) < 0.04
    # brute force by hand: Bayes' rule on the estimated shares
    held = frame.select("doc_id", weights.posterior(F.col("votes")).alias("p")).orderBy("doc_id").collect()
    for r, vote in zip(held[:500], votes):
        odds = weights.good / (1 - weights.good)
        for v, g, b in zip(vote, weights.on_good, weights.on_bad):
            if v != quality.ABSTAIN:
                odds *= g[v] / b[v]
        assert abs(r["p"] - odds / (1 + odds)) < 1e-9
    assert (np.array([r["p"] >= 0.5 for r in held]) == is_good).mean() > 0.93
    # one weak bad vote against good ones; all rules good; two strong bad ones; weak ones that only together say bad
    patterns = [(1, 1, 1, 0, 1), (1, 1, 1, 1, 1), (0, 0, 1, 1, 1), (-1, -1, -1, 0, -1), (-1, -1, -1, 0, 0), (-1, -1, -1, -1, -1)]
    assert verdicts(spark, weights, patterns) == [True, True, False, True, False, True]


def test_a_text_with_one_weak_bad_vote_is_kept(spark, small):
    """Few different words alone (a dry list, say) do not outvote seven good signs; shouted repeats do."""
    weights = quality.fit(quality.signals(spark.read.parquet(f"{small}/documents.parquet")).select(quality.votes("signals").alias("votes")))
    draw = np.random.default_rng(3)
    vocabulary = ["".join(draw.choice(list("abcdefghij"), 5)) for _ in range(40)]
    lines = [" ".join(draw.choice(vocabulary, 12)).capitalize() + "." for _ in range(200)]
    texts = [(1, "\n".join(lines)), (2, "ACT NOW!! " * 100)]
    found = quality.signals(spark.createDataFrame(texts, "doc_id bigint, text string")).select("doc_id", quality.votes("signals").alias("votes"))
    got = {r["doc_id"]: r for r in found.select("doc_id", "votes", weights.posterior(F.col("votes")).alias("p")).collect()}
    assert got[1]["votes"].count(quality.BAD) == 1 and got[1]["p"] > 0.5
    assert got[2]["votes"].count(quality.BAD) >= 2 and got[2]["p"] < 0.5


@pytest.mark.parametrize("seed", range(10))
def test_floored_shares_are_the_likeliest(seed):
    draw = np.random.default_rng(seed)
    counts = (draw.integers(0, 200, 3) * draw.integers(0, 2, 3)).tolist()
    found = quality.floored(counts, 0.05)
    assert abs(sum(found) - 1) < 1e-9 and min(found) >= 0.05 - 1e-12
    grid = [(a / 100, b / 100, 1 - (a + b) / 100) for a in range(5, 91) for b in range(5, 96 - a)]
    value = lambda shares: sum(c * np.log(s) for c, s in zip(counts, shares))
    assert value(found) >= max(map(value, grid)) - 1e-9
