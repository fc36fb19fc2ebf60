"""Mixing to target weights with soft domain membership. DataFrame functions only.

A naive Bayes classifier over hashed words, fitted on a labelled table, gives every document a posterior
over domains. Every document gets a rate, how often it should be drawn: rates are nonnegative, stay as
close to one as they can (weighted by tokens), and bring the expected tokens of every domain to its
target. This is a least-squares problem in as many unknowns as there are documents; it is solved by
projected gradient steps. In a step Spark sums expected domain tokens over all documents, a vector of one
number per domain; scaled by the inverse of the domains' second moments (over documents with a rate above
zero) it is the step's direction, halved when it went too far, and each document's new rate is max(0, rate - posterior * direction). Rates are not stored between steps: they
follow from the posterior and the list of directions so far.

The classifier learns from at most ``max_labelled`` labelled documents, chosen by a hash of their ids.
Everything else covers all documents.

Defined results: a null or empty text has no tokens and the prior as posterior. Without labelled rows
there is one domain, ``all``, and every rate is one. A domain that ``targets`` leaves out has target 0. Targets are
shares of the tokens wanted; that of a domain without documents stays unfilled and is not dealt to the others.
Targets that no rates can meet are met as nearly as the steps come. ``shares`` tells what every domain of either
side gets, and whether its target is met. Labels with a null id or domain play
no part; of several labels of one document the largest counts. Repeated documents get equal rates.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstats.llm.common import others, quoted, stage

BUCKETS = 1 << 12

#: Shares of expected tokens that a mixture should have unless told otherwise.
MIXTURE = {"good": 0.93, "poor": 0.06, "toxic": 0.01}
QUALITY_DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' WHEN quality = 1 THEN 'good' END"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _total(words: Column, table: Column) -> Column:
    """Sum of the table's entries for all words."""
    return F.aggregate(words, F.lit(0.0), lambda a, b: a + F.get(table, b))


class DomainModel:
    """Log priors, and log-likelihoods of buckets relative to the first domain."""

    def __init__(self, domains: list[str], priors: list[float], lifts: list[list[float]], effective_words: int):
        self.domains, self.priors, self.lifts, self.effective_words = domains, priors, lifts, effective_words

    def logits(self, words: Column) -> list[Column]:
        """One per domain. Long texts speak for ``effective_words`` words, so that membership stays soft."""
        out = [F.lit(self.priors[0])]
        scale = self.effective_words / F.greatest(F.size(words), F.lit(self.effective_words)).cast("double")
        for prior, lift in zip(self.priors[1:], self.lifts[1:]):
            out.append(F.lit(prior) + scale * _total(words, F.lit(lift)))
        return out


def fit_domains(docs: DataFrame, labels: DataFrame, domain: str, max_labelled: int = 20_000,
                effective_words: int = 40) -> DomainModel:
    marked = (labels.select("doc_id", F.expr(domain).cast("string").alias("domain"))
              .filter(F.col("doc_id").isNotNull() & F.col("domain").isNotNull())
              .groupBy("doc_id").agg(F.max("domain").alias("domain"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    # At most max_labelled rows of an id and a name.
    known = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    counts = (known.select("domain", F.explode(F.concat(F.array(F.lit(-1)), F.transform(_words(F.col("text")), _bucket)))
                           .alias("bucket"))
              .groupBy("domain", "bucket").count().collect())  # one row per domain and bucket
    domains = sorted({r["domain"] for r in counts})
    if not domains:
        return DomainModel(["all"], [0.0], [[0.0] * BUCKETS], effective_words)
    table = {d: [0.5] * BUCKETS for d in domains}
    texts = dict.fromkeys(domains, 0)
    for r in counts:
        if r["bucket"] < 0:
            texts[r["domain"]] = r["count"]
        else:
            table[r["domain"]][r["bucket"]] += r["count"]
    total = {d: sum(table[d]) for d in domains}
    scores = {d: [log(n / total[d]) for n in table[d]] for d in domains}
    base = scores[domains[0]]
    lifts = [[a - b for a, b in zip(scores[d], base)] for d in domains]
    everything = sum(texts.values())
    return DomainModel(domains, [log(texts[d] / everything) for d in domains], lifts, effective_words)


def with_posterior(docs: DataFrame, model: DomainModel) -> DataFrame:
    """Columns of ``docs`` but its text, with tokens and the posterior of every domain."""
    rest = [quoted(c) for c in others(docs, "text", "tokens", "posterior", "domain", "rate")]
    hashed = docs.select(F.struct(*rest).alias("row"), F.transform(_words(F.col("text")), _bucket).alias("words"))
    # The words are computed once; the posterior needs them several times.
    scored = hashed.select("row", F.size("words").cast("long").alias("tokens"),
                           F.array(*model.logits(F.col("words"))).alias("logits"))
    weights = F.transform("logits", lambda x: F.exp(x - F.array_max("logits")))
    scored = scored.select("row", "tokens", weights.alias("weights"))
    whole = F.aggregate("weights", F.lit(0.0), lambda a, b: a + b)
    return scored.select("row.*", "tokens", F.transform("weights", lambda x: x / whole).alias("posterior"))


def _inverse(rows: list[list[float]]) -> list[list[float]]:
    """Inverse of a small symmetric positive matrix (one row per domain), by elimination."""
    n = len(rows)
    a = [[*r, *(1.0 if i == j else 0.0 for j in range(n))] for i, r in enumerate(rows)]
    for i in range(n):
        pivot = max(range(i, n), key=lambda k: abs(a[k][i]))
        a[i], a[pivot] = a[pivot], a[i]
        a[i] = [x / a[i][i] for x in a[i]]
        for k in range(n):
            if k != i:
                a[k] = [x - a[k][i] * y for x, y in zip(a[k], a[i])]
    return [r[n:] for r in a]


def rate_column(posterior: Column, directions: list[list[float]]) -> Column:
    if not directions:
        return F.lit(1.0)
    return F.aggregate(F.lit(directions), F.lit(1.0), lambda rate, step: F.greatest(
        F.lit(0.0), rate - F.aggregate(F.zip_with(step, posterior, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)))


def solve_rates(members: DataFrame, targets: list[float], steps: int = 30, tolerance: float = 1e-4) -> list[list[float]]:
    """Directions of the gradient steps. ``members`` has tokens and posterior."""
    k = len(targets)
    p = [F.get("posterior", F.lit(d)) for d in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    directions: list[list[float]] = []
    before = float("inf")
    for _ in range(steps):
        rated = members.select(F.col("tokens").cast("double").alias("tokens"), "posterior",
                               rate_column(F.col("posterior"), directions).alias("rate"))
        active = F.when(F.col("rate") > 0, F.col("tokens")).otherwise(0.0)
        sums = rated.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.col("rate") * x) for x in p],
                         *[F.sum(active * p[i] * p[j]) for i, j in pairs]).first()
        whole = sums[0]
        if not whole:
            break
        off = [g / whole - t for g, t in zip(sums[1:k + 1], targets)]
        size = sum(x * x for x in off) ** 0.5
        if size <= tolerance:
            break
        if size > before:  # the last step went too far
            directions[-1] = [x / 2 for x in directions[-1]]
            continue
        before = size
        second = [[0.0] * k for _ in range(k)]
        for (i, j), x in zip(pairs, sums[k + 1:]):
            second[i][j] = second[j][i] = x / whole + (1e-6 if i == j else 0.0)
        directions.append([sum(x * y for x, y in zip(row, off)) for row in _inverse(second)])
    return directions


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str = QUALITY_DOMAIN,
        max_labelled: int = 20_000, tokens_wanted: float = 1.0) -> DataFrame:
    """Columns of ``docs`` but its text, with tokens, domain (the likeliest), posterior and rate.

    ``tokens_wanted``: expected tokens of the mixture, as a share of all tokens."""
    model = fit_domains(docs, labels, domain, max_labelled)
    members = stage(with_posterior(docs, model), "mix-members")
    wanted = targets if model.domains != ["all"] else {"all": 1.0}
    if sum(wanted.get(d, 0.0) for d in model.domains) <= 0:
        raise ValueError(f"no target for any of the domains {model.domains}")
    whole = sum(wanted.values())
    directions = solve_rates(members, [tokens_wanted * wanted.get(d, 0.0) / whole for d in model.domains])
    names = F.lit(model.domains)
    likeliest = F.get(names, (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    return members.withColumn("domain", likeliest).withColumn("rate", rate_column(F.col("posterior"), directions))


def shares(mixed: DataFrame, domains: list[str], targets: dict[str, float], tokens_wanted: float = 1.0,
           tolerance: float = 1e-3) -> DataFrame:
    """domain, target, share, met: of the tokens of all documents, what each domain should get, what it gets by the
    rates of ``mix``, and whether that is within ``tolerance``. ``domains`` are those of ``fit_domains``; domains of
    ``targets`` beyond them have no documents and get nothing."""
    names = [*domains, *sorted(set(targets) - set(domains))]
    whole = sum(targets.values()) or 1.0
    of_domain = F.transform(F.lit(list(range(len(domains)))), lambda d: F.struct(d.alias("d"), (
        F.col("tokens") * F.col("rate") * F.get("posterior", d)).alias("drawn")))
    got = mixed.select(F.explode(of_domain).alias("x")).groupBy("x.d").agg(F.sum("x.drawn").alias("drawn"))
    total = mixed.agg(F.sum("tokens").alias("tokens"))
    wanted = mixed.sparkSession.createDataFrame(
        [(i, name, tokens_wanted * targets.get(name, 0.0) / whole) for i, name in enumerate(names)],
        "d int, domain string, target double")
    share = F.coalesce(F.try_divide("drawn", "tokens"), F.lit(0.0))
    # one row of totals, and a row for each domain
    return wanted.join(got, "d", "left").join(F.broadcast(total)).select(
        "domain", "target", share.alias("share"), (F.abs(share - F.col("target")) <= tolerance).alias("met"))
