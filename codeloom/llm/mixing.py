"""Mixing sources to target weights by soft domain membership.

1. Each text becomes letter counts and a token count, in one pass of string expressions.
2. A labelled table of texts with a domain gives naive Bayes letter frequencies, by one aggregation
   over all labelled rows; they predict every document's domain posteriors. The evidence of a text
   counts as ``EVIDENCE_LETTERS`` letters, so that memberships stay soft.
3. Documents get rates: nonnegative numbers, 1 at first, for which the expected tokens of each domain,
   sum(tokens * rate * posterior), meet the targets. Projected gradient minimises the squared residual
   of the domain shares, weighted by the inverse of the domains' Gram matrix over the rates that are
   positive, so that scarce domains converge as fast as others: where no rate meets its bound, the
   first step meets all targets. The
   step is scaled by each document's tokens, so a rate depends on the posterior alone, and posteriors
   are rounded to ``POSTERIOR_STEP``: iterations run over a stored table of distinct posteriors with
   their tokens. Every iteration is one aggregation of as many numbers as there are domains, by the
   same plan; it ends when all targets are met, when the residual no longer falls (targets that no
   nonnegative rates meet) or after ``ITERATIONS``, and ``Mixture.met`` says which.

A document's rate is the fold of the gradients over its posterior, so rates need no join.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, replace_columns, table, text_or_empty

#: Letters that are counted, besides characters beyond ASCII and all bytes.
LETTERS = ("e", "n", "a", "o", "u", "h", "w", "k", "z", "q", "c", "t")
EVIDENCE_LETTERS = 24.0
POSTERIOR_STEP = 0.01
ITERATIONS = 200
#: Largest residual of a domain's share that counts as met.
TOLERANCE = 1e-4
#: A mix without a budget is at most so many times larger than no domain's cut needs.
LARGEST = 4.0
#: An iteration that lowers the weighted residual by a smaller share than this is the last one.
PROGRESS = 1e-4

#: Target shares of tokens by language, and the share of the corpus that the mix amounts to.
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


@dataclass
class Mixture:
    """Naive Bayes weights and the weighted residuals of the iterations."""

    domains: list[str]
    bias: list[float]  # log prior of each domain
    weights: list[list[float]]  # log frequency by domain and feature
    gradients: list[list[float]]  # by iteration and domain
    shares: list[float]  # reached shares of the corpus's tokens
    wanted: list[float]
    met: bool  # whether every share is within TOLERANCE
    least: float = 0.0  # no rate is below this


def _count(text: Column, letter: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(letter), F.lit("")))


def counts(docs: DataFrame, text_col: str) -> DataFrame:
    """All columns but the text, with ``__tokens`` (runs without white space) and ``__counts``."""
    text = text_or_empty(text_col)
    letters = [_count(text, x) for x in LETTERS]
    beyond = F.octet_length(text) - F.char_length(text)
    rest = F.octet_length(text) - beyond
    for x in letters:
        rest = rest - x
    features = F.array(*[x.cast("double") for x in [*letters, beyond, rest]])
    return docs.withColumns({"__tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), "__counts": features}).drop(text_col)


def train(labelled: DataFrame, domains: list[str]) -> tuple[list[float], list[list[float]]]:
    """domain, __counts -> log priors and log frequencies, over all labelled rows of the domains."""
    width = len(LETTERS) + 2
    known = labelled.where(F.col("domain").isin(domains))
    sums = known.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("__counts")[i]).alias(f"c{i}") for i in range(width)])
    rows = {r["domain"]: r for r in sums.collect()}  # a row for each target domain at most
    total = sum(r["n"] for r in rows.values())
    bias, weights = [], []
    for d in domains:
        row = rows.get(d)
        c = [(row[f"c{i}"] if row else 0.0) + 1.0 for i in range(width)]
        bias.append(math.log(((row["n"] if row else 0) + 1) / (total + len(domains))))
        weights.append([math.log(x / sum(c)) for x in c])
    return bias, weights


def with_posteriors(rows: DataFrame, bias: list[float], weights: list[list[float]]) -> DataFrame:
    """``rows`` with ``__p``: the rounded posteriors of ``__counts``, as an array in the order of the domains.

    Each step is a column of its own, so no expression is repeated inside another.
    """
    bytes_ = F.aggregate("__counts", F.lit(0.0), lambda a, x: a + x)
    evidence = []
    for own in weights:
        total = F.col("__counts")[0] * own[0]
        for i, w in enumerate(own[1:], 1):
            total = total + F.col("__counts")[i] * w
        evidence.append(total)
    scaled = F.array(*[F.lit(b) + F.col("__scale") * e for b, e in zip(bias, evidence, strict=True)])

    def shares(column: str) -> Column:
        return F.transform(column, lambda x: x / F.col("__sum"))

    def sum_of(column: str) -> Column:
        return F.aggregate(column, F.lit(0.0), lambda a, x: a + x)

    return (
        rows.withColumn("__scale", F.lit(EVIDENCE_LETTERS) / F.greatest(bytes_, F.lit(EVIDENCE_LETTERS)))
        .withColumn("__p", scaled)
        .withColumn("__top", F.array_max("__p"))
        .withColumn("__p", F.transform("__p", lambda x: F.exp(x - F.col("__top"))))
        .withColumn("__sum", sum_of("__p"))
        .withColumn("__p", F.transform(shares("__p"), lambda x: F.round(x / POSTERIOR_STEP, 0) * POSTERIOR_STEP))
        .withColumn("__sum", sum_of("__p"))
        .withColumn("__p", shares("__p"))
        .drop("__scale", "__top", "__sum")
    )


def rate(mixture: Mixture, posterior: str) -> Column:
    """The rate of a row after all iterations."""
    if not mixture.gradients:
        return F.lit(1.0)
    # folded into one literal, so the plan is the same whatever the gradients are
    steps = F.array(*[F.array(*map(F.lit, g)) for g in mixture.gradients])

    def step(w: Column, g: Column) -> Column:
        for k in range(len(mixture.domains)):
            w = w - F.col(posterior)[k] * g[k]
        return F.greatest(F.lit(mixture.least), w)

    return F.aggregate(steps, F.lit(1.0), step)


def _inverse(matrix: list[list[float]]) -> list[list[float]]:
    """Gauss-Jordan elimination with pivots, for as many rows as there are domains."""
    n = len(matrix)
    rows = [[*row, *(float(i == j) for j in range(n))] for i, row in enumerate(matrix)]
    for i in range(n):
        pivot = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n):
            if k != i:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [row[n:] for row in rows]


def _times(matrix: list[list[float]], vector: list[float]) -> list[float]:
    return [sum(m * x for m, x in zip(row, vector, strict=True)) for row in matrix]


def fit(cells: DataFrame, domains: list[str], bias: list[float], weights: list[list[float]], targets: list[float], budget: float | None, least: float = 0.0) -> Mixture:
    """__p, n -> the mixture. Without a budget the mix is as large as no domain's cut needs, or larger,
    up to ``LARGEST`` times, where rates of ``least`` or more take that to meet the targets."""
    width = len(domains)
    mixture = Mixture(domains, bias, weights, [], [0.0] * width, targets, False, least)

    def reach() -> tuple[float, list[float], list[list[float]]]:
        """All tokens, the shares of the domains, and the inverse Gram matrix of the cells above the least rate, at first of all."""
        free = (F.col("__w") > least) | F.lit(not mixture.gradients)
        point = cells.withColumn("__w", rate(mixture, "__p")).withColumn("__free", F.col("n") * free.cast("double"))
        own = [F.sum(F.col("n") * F.col("__w") * F.col("__p")[i]).alias(f"s{i}") for i in range(width)]
        gram = [F.sum(F.col("__free") * F.col("__p")[i] * F.col("__p")[j]).alias(f"m{i}_{j}") for i in range(width) for j in range(i, width)]
        sums = point.agg(F.sum("n").alias("total"), *own, *gram).first()
        total = float(sums["total"] or 0)
        if not total:
            return 0.0, [], []
        # a small ridge keeps domains without tokens invertible
        matrix = [[sums[f"m{min(i, j)}_{max(i, j)}"] / total + (1e-9 if i == j else 0.0) for j in range(width)] for i in range(width)]
        return total, [sums[f"s{i}"] / total for i in range(width)], _inverse(matrix)

    total, mixture.shares, metric = reach()
    if not total:
        mixture.shares = [0.0] * width
        return mixture
    if budget is None:
        # the first step gives rates of size * p . pulls, so this is the least size at which none is too low
        pulls = _times(metric, targets)
        lowest = cells.agg(F.min(sum((F.col("__p")[k] * pulls[k] for k in range(1, width)), F.col("__p")[0] * pulls[0]))).first()[0]
        size = max(s / t for s, t in zip(mixture.shares, targets, strict=True) if t > 0)
        budget = max(size, min(least / lowest if lowest > 0 else math.inf, LARGEST * size))
    mixture.wanted = [budget * t for t in targets]
    _descend(mixture, metric, reach)
    return mixture


def _descend(mixture: Mixture, metric: list[list[float]], reach: Callable[[], tuple[float, list[float], list[list[float]]]]) -> None:
    """Add gradients to the mixture until its shares meet what is wanted or come no nearer."""
    # The Gram matrix of all cells bounds the curvature, so a step of 1 by ``metric`` never raises the loss. That of
    # the free cells fits better once rates meet their bound; where a step by it doesn't lower the loss, it is undone.
    free, shares, undone = metric, mixture.shares, False
    loss = math.inf
    for _ in range(ITERATIONS):
        residual = [s - w for s, w in zip(shares, mixture.wanted, strict=True)]
        now = sum(g * r for g, r in zip(_times(metric, residual), residual, strict=True))
        if now > loss * (1 - PROGRESS):
            if undone or not mixture.gradients:
                break
            mixture.gradients.pop()
            undone = True
            residual = [s - w for s, w in zip(mixture.shares, mixture.wanted, strict=True)]
        else:
            loss, mixture.shares, undone = now, shares, False
            mixture.met = max(map(abs, residual)) < TOLERANCE
            if mixture.met:
                break
        mixture.gradients.append(_times(metric if undone else free, residual))
        _, shares, free = reach()
    else:
        mixture.shares = shares


def mix(
    docs: DataFrame,
    targets: dict[str, float],
    labelled: DataFrame | None = None,
    domain_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: float | None = 1.0,
    carry_text: bool = True,
    least: float = 0.0,
) -> DataFrame:
    """All rows and columns of ``docs`` with domain, n_tokens, posteriors (a map), rate, copies and met.

    ``labelled`` has a text column and ``domain``; without it, ``docs`` is the labelled table by its
    ``domain_col``. Rows of other or null domains teach nothing. The mix has ``budget`` times the
    tokens of the corpus; None makes it as large as it takes for no domain to be cut. No rate is below ``least``. copies rounds
    the rate up or down by a hash of the id, so its expectation is the rate; a null id rounds like
    any other value, and rows that repeat an id round by the same number. met says, alike in all
    rows, whether the fitted rates meet every target. A null or empty text has no tokens
    and the prior as posterior. Targets are scaled to sum to 1. Ties of posteriors go to the domain
    first in the alphabet. Input columns named like an output are replaced. Without ``carry_text``
    the text is left out and read once only.
    """
    outputs = ["domain", "n_tokens", "posteriors", "rate", "copies", "met"]
    scratch = Scratch(docs.sparkSession)
    label = F.col(domain_col).cast("string") if labelled is None else F.lit(None).cast("string")
    source = docs.withColumn("__domain", label)
    docs = replace_columns(docs, outputs)
    kept = [c for c in docs.columns if c != text_col]
    domains = sorted(targets)
    total = sum(targets.values())
    wanted = [targets[d] / total for d in domains]
    columns = [] if carry_text else [c for c in kept if c != "__domain"]
    known = scratch.put("counts", counts(source.select(*columns, "__domain", text_col), text_col))
    taught = known.withColumnRenamed("__domain", "domain") if labelled is None else counts(labelled.select(text_col, "domain"), text_col)
    bias, weights = train(taught.select("domain", "__counts"), domains)
    cells = scratch.put("cells", with_posteriors(known.select("__tokens", "__counts"), bias, weights).groupBy("__p").agg(F.sum("__tokens").alias("n")))
    mixture = fit(cells, domains, bias, weights, wanted, budget, least)
    scratch.drop("cells")
    if carry_text:
        scratch.drop("counts")
    counted = known if not carry_text else counts(docs.withColumn("__kept", F.col(text_col)), text_col).withColumnRenamed("__kept", text_col)
    scored = with_posteriors(counted, bias, weights)
    names = F.array(*[F.lit(d) for d in domains])
    uniform = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (
        scored.withColumn("rate", F.round(rate(mixture, "__p"), 9))
        .withColumns(
            {
                "domain": F.element_at(names, F.array_position("__p", F.array_max("__p")).cast("int")),
                "n_tokens": F.col("__tokens"),
                "posteriors": F.map_from_arrays(names, F.col("__p")),
                "copies": F.floor(F.col("rate") + uniform).cast("bigint"),
                "met": F.lit(mixture.met),
            }
        )
        .select(*(docs.columns if carry_text else kept), *outputs)
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rate and copies of every document, for equal shares of three languages and twice
    as much of the fourth; the labelled table is the documents of known language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    mixed = mix(docs, TARGETS, carry_text=False)
    shares = [F.element_at("posteriors", d).alias(f"p_{d}") for d in sorted(TARGETS)]
    return mixed.select("doc_id", "domain", "n_tokens", *shares, "rate", "copies", "met")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_mixing": op2_mixing}
ORACLES: dict[str, str] = {}
