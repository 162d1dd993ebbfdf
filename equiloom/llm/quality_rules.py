"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1) or bad (-1) or abstains (0) on a whole text. How often
each rule votes bad on good and on bad documents is estimated by expectation
maximisation over the counts of the vote patterns, at most three to the number
of rules, of all documents; the posterior probability of good replaces passing
every rule. A vote adds its log odds, an abstention nothing.

Cases: a null or empty text has no words and fails the base rules; a ratio over
no words or lines abstains; equal texts get equal verdicts; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiloom.llm.common import checkpoint

_SPACE = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_letters", "n_bare"]
#: Share of bad votes expected on bad and on good documents before any count,
#: and the documents that this expectation weighs as many as, whatever the size
#: of the corpus.
PRIOR, WEIGHT = (0.5, 0.05), 20.0
#: Probability of good that the estimation starts from, for a document with no
#: bad vote, one, and two or more.
START = (0.99, 0.8, 0.01)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of COUNTS over whole texts. The arrays pass through
    `explode` of one element so that each is made once per row."""
    text = F.col("text")
    split = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("*", F.explode(F.array(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""))).alias("w"))
    n = F.size("w")
    w = F.col("w")
    gram = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
    )
    none = F.lit(None).cast("array<struct<h:bigint,p:int>>")
    bare = F.size(F.filter(w, lambda x: x.isin(list("#*$%&|<>"))))
    sorted_ = split.select("doc_id", "text", n.alias("n"), bare.alias("b"), F.explode(F.array(F.when(n > 3, F.sort_array(gram)).otherwise(none))).alias("g"))
    g = F.col("g")
    met = F.filter(g, lambda x, i: F.coalesce(x["h"] == F.get(g, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(g, i + 1)["h"], F.lit(False)))
    places = F.sort_array(F.transform(met, lambda x: x["p"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("c"), F.lit(0).alias("e")),
        lambda a, p: F.struct((a["c"] + 3 - F.greatest(F.lit(0), a["e"] - p)).alias("c"), (p + 3).alias("e")),
        lambda a: a["c"],
    )
    line = F.filter(F.split(text, "\n", -1), lambda x: _without(x, _SPACE) > 0)
    lined = sorted_.select("doc_id", "text", "n", "b", F.coalesce(covered, F.lit(0)).alias("r"), F.explode(F.array(line)).alias("l"))
    upper = "".join(chr(c) for c in range(ord("A"), ord("Z") + 1))
    plain = upper + upper.lower()
    return lined.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        _without(text, _SPACE).cast("long").alias("word_chars"),
        (F.length(text) - _without(text, "#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.col("r").cast("long").alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        (F.length(text) - _without(text, upper)).cast("long").alias("n_upper"),
        (F.length(text) - _without(text, "!")).cast("long").alias("n_shouts"),
        (F.length(text) - _without(text, plain)).cast("long").alias("n_letters"),
        F.col("b").cast("long").alias("n_bare"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("int")


def votes() -> dict[str, Column]:
    """The rules. Comparisons over nothing are null and abstain. Each kind of
    bad text is seen by two rules at least, so that their agreement, and not the
    prior, tells how far to trust them."""
    n = F.when(F.col("n_words") > 0, F.col("n_words"))
    lines = F.when(F.col("n_lines") > 0, F.col("n_lines"))
    chars = F.when(F.col("word_chars") > 0, F.col("word_chars"))
    ratio = lambda c, of: F.col(c) / of
    mean = F.col("word_chars") / n
    return {
        "symbols": _vote(ratio("n_symbols", n) > 0.1, ratio("n_symbols", n) < 0.02),
        "dup_lines": _vote(ratio("n_dup_lines", lines) > 0.3, (F.col("n_dup_lines") == 0) & (lines > 1)),
        "repeats": _vote(ratio("n_repeat_words", n) > 0.4, ratio("n_repeat_words", n) < 0.15),
        "word_length": _vote((mean < 3) | (mean > 12), (mean >= 3.5) & (mean <= 9)),
        "letters": _vote(ratio("n_letters", chars) < 0.75, ratio("n_letters", chars) > 0.85),
        "bare_symbols": _vote(ratio("n_bare", n) > 0.1, ratio("n_bare", n) < 0.02),
        "upper": _vote(ratio("n_upper", chars) > 0.4, ratio("n_upper", chars) < 0.1),
        "shouts": _vote(ratio("n_shouts", n) > 0.1, F.col("n_shouts") == 0),
        "length": _vote(F.col("n_words") < 20, F.col("n_words") >= 100),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[tuple[float, float]]]:
    """Prior probability of good, and for each rule the probability that its
    vote is bad given a bad and a good document. The start takes two
    bad votes that agree for bad; a rule's bad votes never count for good."""
    width = len(patterns[0][0]) if patterns else 0
    post = [START[min(2, sum(v < 0 for v in p))] for p, _ in patterns]
    good, rates = 0.5, [PRIOR] * width
    for _ in range(rounds):
        before = good, rates
        mass = sum(q * c for q, (_, c) in zip(post, patterns, strict=True))
        total = sum(c for _, c in patterns)
        good = (mass + 0.5 * WEIGHT) / (total + WEIGHT)
        rates = []
        for j in range(width):
            each = []
            for prior, weigh in ((PRIOR[0], lambda q: 1 - q), (PRIOR[1], lambda q: q)):
                bad = sum(weigh(q) * c for q, (p, c) in zip(post, patterns, strict=True) if p[j] < 0)
                cast = sum(weigh(q) * c for q, (p, c) in zip(post, patterns, strict=True) if p[j])
                each.append((bad + prior * WEIGHT) / (cast + WEIGHT))
            rates.append((max(each[0], each[1]), each[1]))
        post = [posterior(p, good, rates) for p, _ in patterns]
        if (good, rates) == before:
            break
    return good, rates


def _odds(vote: int, rate: tuple[float, float]) -> float:
    bad, ok = rate
    return math.log(ok / bad) if vote < 0 else math.log((1 - ok) / (1 - bad)) if vote else 0.0


def posterior(pattern: tuple[int, ...], good: float, rates: list[tuple[float, float]]) -> float:
    x = math.log(good / (1 - good)) + sum(_odds(v, r) for v, r in zip(pattern, rates, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def quality(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, COUNTS, base_failed, each rule's vote, the
    posterior p_good, and kept."""
    rules = votes()
    counted = checkpoint(counts(docs))
    voted = counted.select("*", *[c.alias(f"vote_{k}") for k, c in rules.items()])
    names = [f"vote_{k}" for k in rules]
    patterns = voted.groupBy(*names).count().orderBy(*names).collect()  # at most 3 ** rules rows
    good, rates = fit([(tuple(r[:-1]), r[-1]) for r in patterns])
    odds = F.lit(math.log(good / (1 - good)))
    for name, rate in zip(names, rates, strict=False):
        odds = odds + F.when(F.col(name) < 0, F.lit(_odds(-1, rate))).when(F.col(name) > 0, F.lit(_odds(1, rate))).otherwise(0.0)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = voted.select("*", base.alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("p_good"))
    return scored.select("*", (~F.col("base_failed") & (F.col("p_good") >= 0.5)).alias("kept"))
