"""Soft-membership mixing: posteriors of labelled domains, and document rates by projected-gradient least squares.

A classifier over hashed words, fitted on the labelled table, gives each document a probability of each domain, however many
there are. Rates r >= 0 are then fitted so that the expected tokens of domain k, the sum of r * tokens * p_k over all
documents, meet its target. Posteriors are rounded to a grid and documents added up by them first, and every
gradient, with the moments that precondition it, is one distributed sum over that table.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, tidy

WORD = r"[^\x20\x09-\x0D]+"
FEATURE = r"\p{L}+|[^\p{L}\p{N}\s]+"
BUCKETS = 1 << 18
LABELLED_MOST = 20_000  #: labelled documents on which the classifier is fitted, the same ones at every run
FOLDS = 5  #: one of them is held out, to choose how far the evidence is trusted and to measure it
LEAST_DOCUMENTS = 5
TELLING = 4.0  #: standard errors by which the log-odds of a bucket must differ from 0
POWERS, SCALES = (0.0, 0.5, 1.0), tuple(2.0**-j for j in range(-3, 7))
GRID = 64
BROADCAST_ROWS = 1_000_000  #: of two hashes and a rate
TARGETS = {"q1_t0": 0.95}
RIDGE = 1e-4
MOST_STEPS = 48
TOLERANCE = 1e-5


def _labelled(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the rows with both labels: q<quality>_t<toxic>."""
    domain = F.concat(F.lit("q"), F.col("quality"), F.lit("_t"), F.col("toxic"))
    return labels.select("doc_id", domain.alias("domain")).where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull())


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def features(text: Column) -> Column:
    """Distinct buckets of a text's letter runs and symbol runs, lower-cased."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(FEATURE), F.lit(0))
    return F.array_distinct(F.transform(F.array_distinct(runs), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def featured(docs: DataFrame, *kept: Column | str) -> DataFrame:
    """`kept` columns with `_row` (a number of its own for every row), n_tokens (words) and found (features), written: texts are read once, and the numbers stay as they are."""
    return saved(docs.select(*kept, F.monotonically_increasing_id().alias("_row"), n_words(F.col("text")).alias("n_tokens"), features(F.col("text")).alias("found")), "featured")


@dataclass(frozen=True)
class Classifier:
    """Domains, their prior log-probabilities, the log-odds of the telling buckets, and how evidence is weighed: by scale / n^power for n features.

    `odds` is a written table: b and w0, w1, ... of every bucket that tells, BUCKETS rows at most; None where there is nothing to tell apart.
    `held_out` has the log-loss and the accuracy on held-out labelled documents, and those of the prior alone.
    """

    domains: list[str]
    prior: list[float]
    odds: DataFrame | None = None
    power: float = 0.0
    scale: float = 1.0
    held_out: tuple[float, float, float, float] | None = None

    def evidence(self, rows: DataFrame, *by: str) -> DataFrame:
        """`by`, `_n` (number of features) and `_evidence`, an array by domain with the sums of the log-odds of the buckets in `found`.

        Buckets are exploded and joined with the broadcast odds, a row of zeros standing in so that no document is left out; the sums
        by row are complete within a task before they are exchanged.
        """
        w = [f"w{k}" for k in range(len(self.domains))]
        none = rows.sparkSession.range(1).select(F.lit(-1).alias("b"), *[F.lit(0.0).alias(c) for c in w])
        each = rows.select(*by, F.size("found").alias("_n"), F.explode(F.array_append("found", F.lit(-1))).alias("b"))
        met = each.join(F.broadcast(self.odds.unionByName(none)), "b")
        sums = met.groupBy(*by, "_n").agg(*[F.sum(c).alias(c) for c in w])
        return sums.select(*by, "_n", F.array(*w).alias("_evidence"))

    def weighed(self, rows: DataFrame, power: Column, scale: Column) -> DataFrame:
        """Adds p, the posteriors from `_evidence`, that of `_n` features; drops both. Step by step, so that no step is worked out twice."""
        factor = scale / F.pow(F.greatest("_n", F.lit(1)), power) * F.pow(F.lit(30.0), power)
        rows = rows.withColumn("_factor", factor).withColumn("_log", F.zip_with("_evidence", F.array(*map(F.lit, self.prior)), lambda e, p: p + F.col("_factor") * e))
        rows = rows.withColumn("_top", F.array_max("_log")).withColumn("_e", F.transform("_log", lambda x: F.exp(x - F.col("_top"))))
        rows = rows.withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)).withColumn("p", F.transform("_e", lambda x: x / F.col("_sum")))
        return rows.drop("_evidence", "_n", "_factor", "_log", "_top", "_e", "_sum")

    def of(self, rows: DataFrame, *by: str) -> DataFrame:
        """`by` and p, an array with the probability of every domain, in steps of about 1/GRID, from `rows` as featured() has them; `by` holds `_row`."""
        if self.odds is None:
            return rows.select(*by, F.array(*[F.lit(math.exp(x)) for x in self.prior]).alias("p"))
        weighed, grid = self.weighed(self.evidence(rows, *by), F.lit(self.power), F.lit(self.scale)), max(GRID, 4 * len(self.domains))
        stepped = weighed.withColumn("_steps", F.transform("p", lambda x: F.round(x * grid))).withColumn("_sum", F.aggregate("_steps", F.lit(0.0), lambda a, x: a + x))
        return stepped.withColumn("p", F.transform("_steps", lambda x: x / F.col("_sum"))).drop("_steps", "_sum")

    def posteriors(self, docs: DataFrame) -> DataFrame:
        """Adds n_tokens (words) and p to rows that have a text. A null text has no words and the prior's probabilities."""
        rows = featured(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
        return rows.join(self.of(rows, "_row"), "_row").select("_doc.*", "n_tokens", "p")


def fit_classifier(docs: DataFrame, labels: DataFrame, most: int = LABELLED_MOST) -> Classifier:
    """The telling buckets and how to weigh them, from at most `most` labelled documents, a fifth of which is held out.

    A bucket tells for or against a domain where, by the documents that have it, its log-odds differ from 0 by TELLING
    standard errors; all that do are used, and stay a table. A document labelled twice counts twice. Domains come from
    all labels; without any there is one, `all`.
    """
    known = _labelled(labels)
    domains = sorted(r.domain for r in known.select("domain").distinct().collect())
    if len(domains) < 2:
        return Classifier(domains or ["all"], [0.0])
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS))
    at = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("int") - 1
    sample = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(most).select("doc_id", at.alias("k"), (fold == 0).alias("held"))
    told = saved(docs.select("doc_id", "text").join(F.broadcast(saved(sample, "labelled-sample")), "doc_id").select("k", "held", F.monotonically_increasing_id().alias("_row"), features(F.col("text")).alias("found")), "labelled")
    learnt = told.where("not held")
    sizes = dict(learnt.groupBy("k").count().collect())
    size, whole = [sizes.get(k, 0) for k in range(len(domains))], sum(sizes.values())
    cells = learnt.select("k", F.explode("found").alias("b")).groupBy("b", "k").agg(F.count(F.lit(1)).alias("n"))
    by = cells.groupBy("b").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("of"), F.sum("n").alias("all")).where(F.col("all") >= LEAST_DOCUMENTS)

    def odds(k: Column, own: Column, n: Column) -> Column:
        inside, outside = own + 1.0, F.col("all") - own + 1.0
        value = F.log(inside / (n + 2)) - F.log(outside / (whole - n + 2))
        return F.struct(value.alias("w"), (F.abs(value) / F.sqrt(1 / inside + 1 / outside)).alias("z"))

    ks = F.sequence(F.lit(0), F.lit(len(domains) - 1))
    each = by.select("b", F.transform(ks, lambda k: odds(k, F.coalesce(F.element_at("of", k), F.lit(0)), F.get(F.array(*map(F.lit, size)), k))).alias("of"))
    telling = each.where(F.exists("of", lambda x: x["z"] >= TELLING))
    weights = [F.when(F.col("of")[k]["z"] >= TELLING, F.round(F.col("of")[k]["w"], 3)).otherwise(0.0).alias(f"w{k}") for k in range(len(domains))]
    found = saved(telling.select("b", *weights), "odds")
    return _calibrated(Classifier(domains, [math.log((n + 1) / (whole + len(domains))) for n in size], found), told.where("held"))


def _calibrated(model: Classifier, held: DataFrame) -> Classifier:
    """The model with the power and scale of the least log-loss on held-out documents, all candidates in one job."""
    tried = [(0.0, 0.0), *[(a, s) for a in POWERS for s in SCALES]]  # the first is the prior alone
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("power"), F.lit(s).alias("scale")) for i, (a, s) in enumerate(tried)]))
    rows = saved(model.evidence(held, "_row", "k"), "evidence").withColumn("try", each)
    own = F.get("p", F.col("k"))
    loss, right = F.avg(-F.log(F.greatest(own, F.lit(1e-9)))).alias("loss"), F.avg((own == F.array_max("p")).cast("double")).alias("right")
    got = {r.i: r for r in model.weighed(rows, F.col("try.power"), F.col("try.scale")).groupBy("try.i").agg(loss, right).collect()}
    if not got:
        return model
    best = min(range(1, len(tried)), key=lambda i: got[i].loss)
    return replace(model, power=tried[best][0], scale=tried[best][1], held_out=(got[best].loss, got[best].right, got[0].loss, got[0].right))


def target_tokens(domains: list[str], natural: np.ndarray, weights: Mapping[str, float]) -> np.ndarray:
    """Tokens wanted of each domain: the named weights of the total, and the rest shared as it is by nature.

    Weights of domains that do not occur are passed by; named weights are scaled to 1 where they are all there is.
    """
    named = {d: w for d, w in weights.items() if d in domains}
    rest = np.array([0.0 if d in named else n for d, n in zip(domains, natural, strict=True)])
    left = max(0.0, 1 - sum(named.values()))
    share = np.array([named.get(d, 0.0) for d in domains]) + (left * rest / rest.sum() if rest.sum() else 0)
    return natural.sum() * share / share.sum() if share.sum() else natural


def _sums(profiles: DataFrame, k: int, u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """One distributed sum at the rates of `u`: half the weighted squares of the rates, tokens of each domain, and the moments of the rows above 0."""
    above = profiles.withColumn("_r", rate_of(u)).where("_r > 0")
    pair, p = [(i, j) for i in range(k) for j in range(i, k)], lambda i: F.col("p")[i]
    row = above.agg(
        F.sum(F.col("n") * F.col("_r") * F.col("_r")),
        *[F.sum(F.col("n") * F.col("_r") * p(i)) for i in range(k)],
        *[F.sum(F.col("n") * p(i) * p(j)) for i, j in pair],
    ).first()
    got, second = np.array([x or 0.0 for x in row], float), np.zeros((k, k))
    for (i, j), m in zip(pair, got[k + 1 :], strict=True):
        second[i, j] = second[j, i] = m
    return float(got[0]) / 2, got[1 : k + 1], second


def rate_of(u: np.ndarray) -> Column:
    """max(0, 1 - p . u): the projected rate of a row by one number for each domain."""
    slope = F.aggregate(F.zip_with("p", F.array(*map(F.lit, u.tolist())), lambda p, c: p * c), F.lit(0.0), lambda a, b: a + b)
    return F.greatest(F.lit(0.0), 1 - slope)


def fit_rates(profiles: DataFrame, domains: list[str], weights: Mapping[str, float], steps: int = MOST_STEPS) -> np.ndarray:
    """u, one number for each domain: a row's rate is rate_of(u). `profiles` has n (tokens) and p.

    Minimises half the sum over domains of ((tokens - target) / all tokens)^2 plus a small ridge that holds rates near 1,
    in the norm weighted by tokens, over rates of 0 or more. Where the projected gradient of that is 0, a rate is
    max(0, 1 - p . u), so steps are taken in u: gradients preconditioned by the moments of the rows whose rates are
    above 0, and halved until they go down. Each is one distributed sum of numbers that depend on the domains alone. It ends only when no
    domain's share of the projected gradient exceeds TOLERANCE of all tokens, met or not; an error says if `steps` do not suffice.
    """
    k = len(domains)
    natural = np.array([x or 0.0 for x in profiles.select(F.sum("n"), *[F.sum(F.col("n") * F.col("p")[i]) for i in range(k)]).first()], float)
    total, natural = float(natural[0]), natural[1:]
    if not total:
        return np.zeros(k)
    target = target_tokens(domains, natural, weights)
    ridge = RIDGE * total
    value = lambda u, half: half + float(target @ u) + ridge * float(u @ u) / 2
    u = np.zeros(k)
    half, got, second = _sums(profiles, k, u)
    for _ in range(steps):
        slope = target - got + ridge * u
        if np.abs(slope).max() < TOLERANCE * total:
            break
        size = np.sqrt(np.diag(second) + ridge)
        move = -np.linalg.solve((second + ridge * np.eye(k)) / np.outer(size, size), slope / size) / size
        before, part = value(u, half), 1.0
        while True:
            half, got, second = _sums(profiles, k, u + part * move)
            if value(u + part * move, half) <= before + 1e-4 * part * float(slope @ move) + 1e-12 * abs(before) or part < 1e-6:
                break
            part /= 2
        u = u + part * move
    else:
        raise RuntimeError(f"rates have not settled after {steps} steps: tokens {got.tolist()} of the domains {domains}, targets {target.tolist()}")
    return u


def fitted(model: Classifier, scored: DataFrame, weights: Mapping[str, float]) -> np.ndarray:
    """u of rate_of() for rows with n_tokens and p, by way of the table of distinct posteriors."""
    return fit_rates(saved(scored.groupBy("p").agg(F.sum("n_tokens").alias("n")), "profiles"), model.domains, weights)


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] = TARGETS) -> tuple[Classifier, DataFrame, np.ndarray]:
    """The classifier; doc_id, n_tokens and p of all documents, written; and u, from which rate_of() has the rates."""
    model = fit_classifier(docs, labels)
    scored = saved(model.of(featured(docs, "doc_id"), "_row", "doc_id", "n_tokens").drop("_row"), "posteriors")
    return model, scored, fitted(model, scored, weights)


def copies(rate: Column, key: Column) -> Column:
    """The whole part of the rate, and one more with the chance of its fraction, fixed by the key."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit("mix")), 11)) * F.lit(2.0**-53)
    return (F.floor(rate) + F.when(unit < rate - F.floor(rate), 1).otherwise(0)).cast("long")


@tidy
def mix(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] = TARGETS) -> DataFrame:
    """Each document as often as its rate says, all columns as they were.

    Documents without words have the prior's probabilities. Repeated rows are mixed alike. An empty table stays empty.
    A text's rate is looked up by 128 bits of its hash: distinct texts' rates are broadcast where they are counted and few, else joined.
    """
    model = fit_classifier(docs, labels)
    key = [F.xxhash64("text").alias("_h"), F.xxhash64("text", F.lit("second")).alias("_g")]
    scored = saved(model.of(featured(docs, *key), "_row", "_h", "_g", "n_tokens").drop("_row"), "posteriors")
    u = fitted(model, scored, weights)
    rates = saved(scored.groupBy("_h", "_g").agg(F.first("p").alias("p")).select("_h", "_g", rate_of(u).alias("_rate")), "rates")
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_ROWS else rates
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *key).join(rates, ["_h", "_g"])
    times = copies(F.col("_rate"), F.col("_doc.doc_id")).cast("int")
    return rows.select("_doc", F.explode(F.array_repeat(F.lit(1), times)).alias("_copy")).select("_doc.*")


@tidy
def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model, scored, u = mixing_rates(docs, labels)
    rows = scored.withColumn("rate", rate_of(u))
    return rows.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)], "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))
