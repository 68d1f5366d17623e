"""Quality rules by weak supervision.

Each rule votes good, bad or abstains. The documents are counted by their
pattern of votes (a bounded table, three values a rule); expectation
maximisation over that table estimates how often good and bad documents get
each vote, without labels; a document's posterior probability of being good
then decides, instead of every rule having to pass.

Defined results: a null or blank text has no words, gets zeros and abstaining
rules, and fails the base; repeated rows are judged alike; an empty table
gives an empty result (the model is then the prior).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import blank_words, keep, unwrapped, wrapped

VOTES = GOOD, BAD, ABSTAIN = 0, 1, 2
#: Prior probability of each vote, in the order of VOTES, by class.
GOOD_RATES = (0.78, 0.02, 0.2)
BAD_RATES = (0.5, 0.3, 0.2)


@dataclass(frozen=True)
class Rule:
    """A voter over the feature columns, as SQL conditions."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), BAD).when(F.expr(self.good), GOOD).otherwise(ABSTAIN)


DEFAULT_RULES = (
    Rule("length", "n_words < 50", "n_words >= 80"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2.5 * n_words OR word_chars > 12 * n_words)",
         "n_words > 0 AND word_chars BETWEEN 3 * n_words AND 9 * n_words"),
    Rule("symbols", "n_symbols > 0.1 * n_words AND n_words > 0", "n_words > 0 AND n_symbols <= 0.02 * n_words"),
    Rule("letters", "word_chars > 0 AND n_other > 0.2 * word_chars", "word_chars > 0 AND n_other <= 0.1 * word_chars"),
    Rule("marks", "n_words > 0 AND n_marks > 0.15 * n_words", "n_words > 0 AND n_marks <= 0.05 * n_words"),
    Rule("plain", "n_words > 0 AND n_plain < 0.6 * n_words", "n_words > 0 AND n_plain >= 0.8 * n_words"),
    Rule("capitals", "word_chars > 0 AND n_capitals > 0.3 * word_chars", "word_chars > 0 AND n_capitals <= 0.1 * word_chars"),
    Rule("shouting", "n_exclaims > 0.2 * n_words AND n_words > 0", "n_words > 0 AND n_exclaims <= 0.05 * n_words"),
    Rule("dup_lines", "n_lines >= 3 AND n_dup_lines > 0.3 * n_lines", "n_lines >= 3 AND n_dup_lines <= 0.1 * n_lines"),
    Rule("repeats", "n_words > 0 AND n_repeat_words > 0.3 * n_words", "n_words > 0 AND n_repeat_words <= 0.15 * n_words"),
    Rule("variety", "n_words >= 20 AND n_distinct < 0.2 * n_words", "n_words >= 20 AND n_distinct >= 0.35 * n_words"),
)


@dataclass(frozen=True)
class VoteModel:
    """Prior of a good document and, per rule, each vote's probability by class."""

    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]
    rounds: int = field(default=0, compare=False)

    def posterior(self, votes: Column) -> Column:
        """Probability that a row with these votes (an array) is good. The odds
        are one array literal, so every round runs the same compiled code."""
        odds = F.lit([math.log(x / y) for g, b in zip(self.good, self.bad) for x, y in zip(g, b)])
        each = F.transform(votes, lambda v, j: F.get(odds, j * len(VOTES) + v))
        logit = F.aggregate(each, F.lit(math.log(self.prior / (1 - self.prior))), lambda a, x: a + x)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules look at; everything is found in the row.
    They take the place of input columns of the same names.

    A word is repeated when it lies in a three-word window found twice or more
    in the text. Windows are compared by 64-bit hash; where some hash occurs
    twice, the hash's upper bits and the position are sorted as one number, so
    the work stays n log n for texts of any length.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    x = docs.withColumn("_w", blank_words(F.col(text)))
    x = x.withColumn("_lines", F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^ \t-\r]")))
    x = x.withColumn("_tri", F.expr(
        "CASE WHEN size(_w) < 3 THEN cast(array() AS array<bigint>) ELSE "
        "transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END"))
    x = x.withColumn("_joined", F.array_join("_w", ""))
    x = x.withColumns({
        "n_words": F.size("_w").cast("bigint"),
        "word_chars": F.length("_joined").cast("bigint"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_other": F.length(F.regexp_replace("_joined", r"[\p{L}\p{M}]+", "")).cast("bigint"),
        "n_capitals": F.length(F.regexp_replace("_joined", r"[^\p{Lu}]+", "")).cast("bigint"),
        "n_exclaims": F.length(F.regexp_replace("_joined", r"[^!]+", "")).cast("bigint"),
        # runs of two or more marks; words of letters with at most one mark after them
        "n_marks": F.regexp_count(t, F.lit(r"[^\p{L}\p{M}\p{N}\s]{2,}")).cast("bigint"),
        "n_plain": F.regexp_count(t, F.lit(r"(?<![^ \t-\r])[\p{L}\p{M}]+[.,;:?!]?(?![^ \t-\r])")).cast("bigint"),
        "n_distinct": F.size(F.array_distinct("_w")).cast("bigint"),
        "_bits": F.ceil(F.log2(F.size("_w") + F.lit(1.0))).cast("int"),
    })
    # hash and position as one sorted number, only where a window repeats
    x = x.withColumn("_sorted", F.expr(
        "CASE WHEN size(array_distinct(_tri)) = size(_tri) THEN cast(array() AS array<bigint>) ELSE "
        "sort_array(transform(_tri, (h, i) -> shiftleft(h, _bits) | i)) END"))
    x = x.withColumn("_starts", F.expr(
        "sort_array(transform(filter(transform(_sorted, (p, i) -> struct(p, "
        "  coalesce(shiftright(p, _bits) = shiftright(get(_sorted, i - 1), _bits), false) OR "
        "  coalesce(shiftright(p, _bits) = shiftright(get(_sorted, i + 1), _bits), false) AS twice)), "
        "s -> s.twice), s -> s.p & (shiftleft(1L, _bits) - 1)))"))
    x = x.withColumn("n_repeat_words", F.expr(
        "aggregate(transform(_starts, (p, i) -> coalesce(least(get(_starts, i + 1) - p, 3L), 3L)), 0L, (a, n) -> a + n)"))
    out = x.drop("_w", "_lines", "_tri", "_joined", "_bits", "_sorted", "_starts")
    # a generator of one row: a later filter is not rewritten in terms of the texts
    return out.select(F.inline(F.array(F.struct(*out.columns))))


def votes_of(rules: Sequence[Rule]) -> Column:
    """The votes of a row as an array of places in VOTES."""
    return F.array(*[r.vote() for r in rules])


def fit_votes(votes: DataFrame, rules: int, rounds: int = 100, tolerance: float = 1e-5) -> VoteModel:
    """Expectation maximisation over the table of patterns of ``votes``.

    The table has at most 3 ** rules rows whatever the input; a round is one
    aggregate over it that returns a row per rule and vote. ``GOOD_RATES`` and
    ``BAD_RATES`` are where it starts and, with the weight of one part in
    twenty of the documents, its prior: any rule rarely accuses a good
    document, while a bad one is accused by some rules and passes others. That
    also keeps the classes from changing places.
    """
    # read as one partition, so that no round needs an exchange
    patterns = keep(votes.groupBy("votes").agg(F.count(F.lit(1)).alias("_n")).coalesce(1)).coalesce(1)
    total = patterns.agg(F.sum("_n")).first()[0] or 0
    model = VoteModel(0.8, (GOOD_RATES,) * rules, (BAD_RATES,) * rules)
    if not total:
        return model
    weight = max(1.0, total / 20)
    for step in range(rounds):
        each = patterns.withColumn("_p", model.posterior(F.col("votes"))).select("_n", "_p", F.posexplode("votes").alias("_j", "_v"))
        sums = {(r["_j"], r["_v"]): (r["g"], r["b"]) for r in each.groupBy("_j", "_v").agg(
            F.sum(F.col("_n") * F.col("_p")).alias("g"), F.sum(F.col("_n") * (1 - F.col("_p"))).alias("b")).collect()}
        mass = [sum(sums.get((0, v), (0.0, 0.0))[c] for v in range(len(VOTES))) for c in (0, 1)]

        def rates(c: int, prior: tuple) -> tuple:
            return tuple(tuple((sums.get((j, v), (0.0, 0.0))[c] + weight * prior[v]) / (mass[c] + weight)
                               for v in range(len(VOTES))) for j in range(rules))

        new = VoteModel((mass[0] + 0.8 * weight) / (total + weight), rates(0, GOOD_RATES), rates(1, BAD_RATES), step + 1)
        gap = max([abs(new.prior - model.prior)] + [
            abs(x - y) for a, b in ((new.good, model.good), (new.bad, model.bad)) for s, t in zip(a, b) for x, y in zip(s, t)])
        model = new
        if gap < tolerance:
            break
    return model


def judge(featured: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, model: VoteModel | None = None,
          threshold: float = 0.5) -> DataFrame:
    """Add the votes, ``quality`` (the posterior), ``base_failed`` and ``kept``
    to rows that carry the features; the model is fitted on them unless given."""
    voted = featured.withColumn("votes", votes_of(rules))
    model = model or fit_votes(voted.select("votes"), len(rules))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (voted.withColumn("quality", model.posterior(F.col("votes"))).withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))


def filter_quality(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = DEFAULT_RULES,
                   threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with their own columns. The features are
    found twice (once to fit, once to judge) instead of shuffling the texts."""
    narrow = features(docs.select(F.col(text).alias("_text")), "_text")
    model = fit_votes(narrow.select(votes_of(rules).alias("votes")), len(rules))
    return unwrapped(judge(features(wrapped(docs, _text=F.col(text)), "_text"), rules, model, threshold).filter("kept"))
