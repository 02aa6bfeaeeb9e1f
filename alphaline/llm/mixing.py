"""Mixing sources to target weights: soft membership and nonnegative document rates.

A classifier fitted on the labelled table gives every document posteriors over the domains
(quality x toxicity). Document rates r >= 0 are then fitted so that the expected tokens of
each domain, ``sum(rate * tokens * posterior)``, match target shares of the corpus's tokens,
by projected-gradient least squares in the metric of the documents' tokens. The gradient of a
document is its posteriors times four multipliers, so the path is kept as these four numbers:
``r = max(0, 1 - multipliers . posteriors)`` after every step. A step is one distributed
aggregate; its residual is whitened by the second moments of the documents whose rate is
positive, and it is shortened until the dual objective falls. A slight pull of the multipliers
to zero (``PULL``) makes the fit a least-squares problem with one answer even where targets are
out of reach of nonnegative rates: ``target_gap`` says by how much they were missed. Steps go
on until the slope is within ``TOLERANCE`` or no step lowers the objective.

The classifier's features are words that tell the domains apart (a word counts once for a
text), fitted on at most ``MAX_LABELLED`` labelled documents (lowest hashes of doc_id); at most
``MAX_EVIDENCE`` words are used and reach the tasks as arrays in the plan, so scoring is a map
without a shuffle. Each half of the sample gives a model, whose scores of the other half are
calibrated by a softmax regression that also sees the text's length; a text's posteriors are
the mean of both models'. Everything else covers all rows.

Defined results: null and empty texts have no tokens, the calibrated prior as posteriors, and
a rate like any other; texts of any length are scored whole; repeated labels of one id count
once (their maximum); labels with nulls are ignored; rows that repeat a doc_id, or are equal,
are rated one by one; ties cannot occur, as nothing is ranked; without labels all domains are
equally likely; an empty table gives an empty result; a column of the input that is named like
one of the result's is replaced by it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaline.llm.shared import cut, drop_cut

DOMAINS = ("low_clean", "low_toxic", "high_clean", "high_toxic")
#: Share of all tokens that each domain is to have.
TARGETS = {"low_clean": 0.18, "low_toxic": 0.01, "high_clean": 0.80, "high_toxic": 0.01}
MAX_LABELLED = 20_000
#: Words of the classifier, the most telling first.
MAX_EVIDENCE = 20_000
MIN_COUNT = 20
#: Documents' weight of the background in each domain's distribution.
BACKGROUND = 5.0
#: Least log-likelihood ratio (G squared) between domains for a word to count as evidence.
MIN_SURPRISE = 40.0
#: Share of some domain's labelled texts that must hold a word.
MIN_SUPPORT = 0.05
#: Largest distance of a token share from its target, where that can be met.
TOLERANCE = 1e-5
PULL = 1e-8
#: Weight of the calibration's penalty.
PENALTY = 1.0

SIZE = len(DOMAINS)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _terms(text: Column) -> Column:
    """The distinct lower-cased words of a text without the punctuation at their ends."""
    bare = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D.,;:!?]+")
    return F.array_distinct(F.array_remove(bare, ""))


def labelled_sample(labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """At most ``limit`` labelled ids, their domain's number and one of two halves."""
    clean = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    once = clean.groupBy(F.col("doc_id").alias("id")).agg((2 * F.max((F.col("quality") > 0).cast("int")) + F.max((F.col("toxic") > 0).cast("int"))).alias("domain"))
    return once.orderBy(F.xxhash64("id"), "id").limit(limit).withColumn("half", F.pmod(F.xxhash64(F.col("id"), F.lit("half")), F.lit(2)).cast("int"))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(domain, half, n, terms, weight)``: the sample's texts; copies are one text with their number.

    Copies would make all their words evidence, so texts with the same set of terms are one.
    """
    sample = cut(labelled_sample(labels), "op10-sample")
    terms = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(sample), "id").select("id", "domain", "half", F.size(_words(F.col("text"))).alias("n"), _terms(F.col("text")).alias("terms"))
    whole = F.sha2(F.concat_ws(" ", F.array_sort("terms")), 256).alias("whole")
    first = F.min_by(F.struct("half", "n", "terms"), "id").alias("t")
    texts = cut(terms.groupBy("domain", whole).agg(first, F.countDistinct("id").alias("weight")).select("domain", "t.*", "weight"), "op10-texts")
    drop_cut(sample)
    return texts


def evidence_words(texts: DataFrame) -> list[tuple[str, int, list[float]]]:
    """``(word, xxhash64, log-ratios of the domains to the background)`` of the words that count as evidence."""
    sizes = {r["domain"]: r["count"] for r in texts.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    counts = texts.select("domain", F.explode("terms").alias("word")).groupBy("word").agg(*[F.count_if(F.col("domain") == k).alias(f"c{k}") for k in range(SIZE)])
    of = [float(sizes.get(k, 0)) for k in range(SIZE)]
    every = sum(F.col(f"c{k}") for k in range(SIZE))
    share = every / F.lit(max(total, 1))
    expected = [F.lit(of[k]) * share for k in range(SIZE)]
    surprise = 2 * sum(F.when((F.col(f"c{k}") > 0) & (expected[k] > 0), F.col(f"c{k}") * F.log(F.col(f"c{k}") / expected[k])).otherwise(0.0) for k in range(SIZE))
    weights = F.array(*[F.log((F.col(f"c{k}") + BACKGROUND * share) / ((of[k] + BACKGROUND) * share)) for k in range(SIZE)])
    widespread = F.greatest(*[F.col(f"c{k}") / F.lit(max(of[k], 20.0)) for k in range(SIZE)]) >= MIN_SUPPORT
    telling = counts.where((every >= MIN_COUNT) & (surprise >= MIN_SURPRISE) & widespread).orderBy(surprise.desc(), "word").limit(MAX_EVIDENCE)
    return [(r["word"], r["h"], r["w"]) for r in telling.select("word", F.xxhash64("word").alias("h"), weights.alias("w")).collect()]


def cuckoo(hashes: list[int]) -> tuple[int, list[int]]:
    """Slots as a power of two, and for each slot an index of ``hashes`` or -1.

    A hash lies in the slot of its lowest or of its highest 32 bits, so a lookup tries two.
    """
    bits = max(4, (4 * len(hashes)).bit_length())
    while True:
        slots, mask = [-1] * (1 << bits), (1 << bits) - 1
        for at in range(len(hashes)):
            place = hashes[at] & mask
            for _ in range(64):
                at, slots[place] = slots[place], at
                if at < 0:
                    break
                low, high = hashes[at] & mask, hashes[at] >> 32 & mask
                place = high if place == low else low
            else:
                break
        else:
            return 1 << bits, slots
        bits += 1


def score(rows: DataFrame, terms: Column, evidence: list[tuple[str, int, list[float]]], width: int) -> DataFrame:
    """``rows`` with ``__s``, an array of ``width`` sums of evidence. Words hold no space."""
    count, slots = cuckoo([h for _, h, _ in evidence])
    names = F.split(F.lit(" ".join(evidence[k][0] if k >= 0 else "" for k in slots)), " ")
    ratios = [repr(float(x)) for k in slots for x in (evidence[k][2] if k >= 0 else [0.0] * width)]
    weights = F.split(F.lit(" ".join(ratios)), " ").cast("array<double>")

    def held(term: Column) -> Column:
        h = F.xxhash64(term)
        first, second = (x.bitwiseAND(F.lit(count - 1)).cast("int") for x in (h, F.shiftright(h, 32)))
        at = F.when(F.get(names, first) == term, first).when(F.get(names, second) == term, second)
        return F.slice(weights, at * width + 1, width)

    found = F.filter(F.transform(terms, held), lambda w: w.isNotNull())
    sums = F.aggregate(found, F.array(*[F.lit(0.0)] * width), lambda acc, w: F.zip_with(acc, w, lambda x, y: x + y))
    return rows.withColumn("__s", sums)


def softmax_regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients (features x domains) of a penalised softmax regression, by Newton's method."""
    d = x.shape[1]
    beta = np.zeros((d, SIZE))
    hot = np.eye(SIZE)[y]
    for _ in range(100):
        p = _softmax(x @ beta)
        slope = x.T @ (weight[:, None] * (p - hot)) + PENALTY * beta
        curve = np.zeros((d * SIZE, d * SIZE))
        for a in range(SIZE):
            for b in range(SIZE):
                w = weight * p[:, a] * ((a == b) - p[:, b])
                curve[a * d : a * d + d, b * d : b * d + d] = (x * w[:, None]).T @ x
        step = np.linalg.solve(curve + PENALTY * np.eye(d * SIZE), slope.T.ravel()).reshape(SIZE, d).T
        beta -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return beta


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, int, list[float]]], list[np.ndarray]]:
    """Both halves' evidence side by side, and their calibrations (rows: scores, log length, one)."""
    texts = labelled_texts(docs, labels)
    ratios: dict[tuple[str, int], list[float]] = {}
    calibrations = []
    for half in range(2):
        evidence = evidence_words(texts.where(F.col("half") == half))
        for word, h, w in evidence:
            ratios.setdefault((word, h), [0.0] * (2 * SIZE))[half * SIZE : half * SIZE + SIZE] = w
        held = score(texts.where(F.col("half") != half), F.col("terms"), evidence, SIZE).select("domain", "n", "weight", "__s").collect()
        x = np.array([[*r["__s"], np.log1p(r["n"]), 1.0] for r in held]).reshape(-1, SIZE + 2)
        y, weight = np.array([r["domain"] for r in held], int), np.array([float(r["weight"]) for r in held])
        calibrations.append(softmax_regression(x, y, weight))
    drop_cut(texts)
    return [(word, h, w) for (word, h), w in sorted(ratios.items())], calibrations


def posteriors(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """``docs[keep]`` with ``n_tokens`` and ``p_<domain>`` for every row; a map over ``docs``."""
    evidence, calibrations = fit(docs.select("doc_id", "text"), labels)
    kept = [k for k in keep if k not in RESULT]
    numbered = docs.select(*kept, F.col("text").alias("__text"))
    scored = score(numbered, _terms(F.col("__text")), evidence, 2 * SIZE).withColumn("n_tokens", F.size(_words(F.col("__text"))).cast("long"))

    def logits(half: int, k: int) -> Column:
        inputs = [*[F.col("__s")[half * SIZE + j] for j in range(SIZE)], F.log1p("n_tokens"), F.lit(1.0)]
        return sum(F.lit(float(calibrations[half][j, k])) * inputs[j] for j in range(SIZE + 2))

    both = [(h, k) for h in range(2) for k in range(SIZE)]
    logged = scored.select(*kept, "n_tokens", *[logits(h, k).alias(f"__l{h}{k}") for h, k in both])
    top = [F.greatest(*[F.col(f"__l{h}{k}") for k in range(SIZE)]) for h in range(2)]
    powers = logged.select(*kept, "n_tokens", *[F.exp(F.col(f"__l{h}{k}") - top[h]).alias(f"__e{h}{k}") for h, k in both])
    norm = [sum(F.col(f"__e{h}{k}") for k in range(SIZE)) for h in range(2)]
    return powers.select(*kept, "n_tokens", *[((F.col(f"__e0{k}") / norm[0] + F.col(f"__e1{k}") / norm[1]) / 2).alias(p) for k, p in enumerate(_MEMBERSHIP)])


RESULT = ("n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", "target_gap")
_MEMBERSHIP = tuple(f"p_{d}" for d in DOMAINS)


def _rate(multipliers: np.ndarray) -> Column:
    return F.greatest(F.lit(0.0), 1 - sum(F.lit(float(m)) * F.col(p) for m, p in zip(multipliers, _MEMBERSHIP, strict=True)))


def _moments(table: DataFrame, multipliers: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected shares, second moments of the rows with positive rates, and half the mean squared rate."""
    pairs = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
    tokens, rate, p = F.col("n_tokens").cast("double"), F.col("__r"), [F.col(c) for c in _MEMBERSHIP]
    active = F.when(rate > 0, tokens).otherwise(0.0)
    rated = table.select("n_tokens", *_MEMBERSHIP, _rate(multipliers).alias("__r"))
    sums = [float(x or 0) / total for x in rated.agg(*[F.sum(rate * tokens * x) for x in p], *[F.sum(active * p[i] * p[j]) for i, j in pairs], F.sum(rate * rate * tokens) / 2).first()]
    metric = np.zeros((SIZE, SIZE))
    for (i, j), value in zip(pairs, sums[SIZE:-1], strict=True):
        metric[i, j] = metric[j, i] = value
    return np.array(sums[:SIZE]), metric, sums[-1]


def fit_rates(table: DataFrame, targets: dict[str, float] = TARGETS) -> tuple[Column, float]:
    """The rate of a row of ``table(n_tokens, p_...)``, and the largest distance of a share from its target."""
    total = float(table.agg(F.sum("n_tokens")).first()[0] or 0)
    if total == 0:
        return F.lit(1.0), 0.0
    goal = np.array([targets[d] for d in DOMAINS])
    multipliers, step = np.zeros(SIZE), 1.0
    shares, metric, half = _moments(table, multipliers, total)
    value = half
    while np.abs(residual := shares - goal - PULL * multipliers).max() > TOLERANCE / 10 and step > 1e-9:
        along = np.linalg.solve(metric + PULL * np.eye(SIZE), residual)
        tried = multipliers + step * along
        found = _moments(table, tried, total)
        # the dual objective is convex, with the residual as its slope: a step must lower it
        lower = found[2] + tried @ goal + PULL / 2 * (tried @ tried)
        if lower < value - 1e-4 * step * (along @ residual):
            multipliers, (shares, metric, half), value, step = tried, found, lower, min(1.0, 4 * step)
        else:
            step /= 4
    return _rate(multipliers), float(np.abs(shares - goal).max())


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, keep: list[str] | None = None) -> DataFrame:
    """``docs[keep]`` (all columns, if not told) with tokens, domain posteriors, the fitted rate and ``target_gap``."""
    table = cut(posteriors(docs, labels, docs.columns if keep is None else keep), "op10-posteriors")
    rate, gap = fit_rates(table, targets)
    kept = [c for c in table.columns if c not in RESULT]
    return table.select(*kept, "n_tokens", *[F.round(p, 6).alias(p) for p in _MEMBERSHIP], F.round(rate, 6).alias("rate"), F.lit(round(gap, 9)).alias("target_gap"))
