"""Quality by hierarchical empirical Bayes: document evidence, shrunk host and path posteriors.

Evidence of a document: log-likelihood ratios of its features' bins, whose edges are quantiles of the labelled documents
and whose ratios are learned by grouped counts over them, calibrated in the sum. Host and path posteriors: means of the
documents' evidence posteriors, other documents only, shrunk to the level above (path to host, host to the global prior)
with a strength estimated from the spread between groups, so that sparse sites lean on the prior. The score is the path
posterior updated by the document's evidence.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import cut

FEATURES = ("f_word", "f_symbol", "f_unique", "f_upper", "f_digit", "f_stop", "f_line")
#: Bins of a feature at most, with equal shares of the labelled documents.
BINS = 16


@dataclass(frozen=True)
class Model:
    """edges[feature]: upper ends of its bins but the last. ratios[feature][bin]: ln P(bin | good) / P(bin | bad). A curve
    with slope and intercept over their sum, and the share of good documents."""

    edges: list[list[float]]
    ratios: list[list[float]]
    slope: float
    intercept: float
    prior: float


def site_of(url: Column) -> tuple[Column, Column]:
    """(host, path): the host of a URL in lower case, and the first segment of its path; null where there is none."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return host, F.nullif(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), "^/+([^/]+)/", 1), F.lit(""))


def features(text: Column) -> dict[str, Column]:
    """Shares and means of a whole text; of an empty one all are zero. JVM-side only."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    # one pass maps each class of characters to one of them; single characters are then counted by replacement
    classes = {"A": "BCDEFGHIJKLMNOPQRSTUVWXYZ", "0": "123456789", ".": ",;:?", "%": "*$&#|@!{}<>^~=_\\", " ": "\t\n\r"}
    marked = F.translate(t, "".join(classes.values()), "".join(c * len(chars) for c, chars in classes.items()))
    count = lambda c: F.length(marked) - F.length(F.replace(marked, F.lit(c), F.lit("")))
    words = F.array_remove(F.split(F.lower(F.replace(F.replace(F.replace(t, F.lit("\t"), F.lit(" ")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))), " ", -1), "")
    lines = F.split(t, "\n", -1)
    return {
        "f_word": (F.length(t) - count(" ")) / F.greatest(F.size(words), F.lit(1)),
        "f_symbol": count("%") / n,
        "f_unique": F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)),
        "f_upper": count("A") / n,
        "f_digit": count("0") / n,
        "f_stop": count(".") / n,
        "f_line": F.size(F.array_distinct(lines)) / F.size(lines),
    }


def featured(docs: DataFrame, key: str = "doc_id", host: str = "source", path: str = "lang", text: str = "text") -> DataFrame:
    """(key, host, path, values): one small row a document, values in the order of FEATURES. Null hosts and paths are a
    group of their own."""
    f = features(F.col(text))
    site = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((host, "host"), (path, "path"))]
    return docs.select(F.col(key).alias("key"), *site, F.array(*[f[k].cast("double") for k in FEATURES]).alias("values"))


def bins(edges: list[list[float]]) -> Column:
    """The bin of each feature: how many edges its value is beyond."""
    beyond = lambda i, ends: sum(((F.element_at("values", i + 1) > e).cast("int") for e in ends), F.lit(0))
    return F.array(*[beyond(i, ends) for i, ends in enumerate(edges)])


def learn(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    """The model of labelled rows (label `quality` 0 or 1).

    Quantiles and counts are of fixed size (features x bins x labels); so are the sums of the calibration, three numbers a
    step. Null labels and keys do not take part; a document with labels of both kinds counts as good.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max("quality").alias("y"))
    known = cut(rows.join(marked, "key").select("values", "y"))
    steps = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found = known.agg(*[F.percentile_approx(F.element_at("values", i + 1), steps, F.lit(10_000)).alias(k) for i, k in enumerate(FEATURES)]).first()
    edges = [sorted(set(x or [])) for x in found]
    known = cut(known.select("y", bins(edges).alias("bins")))
    counts = known.select("y", F.posexplode("bins").alias("f", "b")).groupBy("f", "b", "y").count().collect()
    total = {y: sum(r["count"] for r in counts if r["y"] == y and r["f"] == 0) for y in (0, 1)}
    ratios = []
    for f, ends in enumerate(edges):
        n = {(r["b"], r["y"]): r["count"] for r in counts if r["f"] == f}
        size = len(ends) + 1
        share = lambda b, y: (n.get((b, y), 0) + 0.5) / (total[y] + 0.5 * size)  # noqa: B023, E731
        ratios.append([math.log(share(b, 1) / share(b, 0)) for b in range(size)])
    prior = (total[1] + 1) / (total[0] + total[1] + 2)
    # the features are not independent: a logistic curve over their sum says what it is worth
    slope, intercept = 1.0, 0.0
    if total[0] and total[1]:
        s = known.select("y", evidence(ratios).alias("s")).groupBy(F.round("s", 1).alias("s")).agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()
        slope, intercept = _logistic([(r["s"], r["y"], r["n"]) for r in s], prior)
    return Model(edges, ratios, slope, intercept, prior)


def _logistic(points: list[tuple[float, int, int]], prior: float) -> tuple[float, float]:
    """Slope and intercept of ln odds = logit(prior) + intercept + slope * s, by ridge Newton steps."""
    s, y, n = (np.array(x, float) for x in zip(*points, strict=True))
    base, w = np.log(prior / (1 - prior)), np.array([1.0, 0.0])
    x = np.c_[s, np.ones(len(s))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(base + x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag([1.0, 1.0])
        w += np.clip(np.linalg.solve(h, x.T @ (y - n * p) - (w - [1, 0])), -1, 1)
    return float(w[0]), float(w[1])


def evidence(ratios: list[list[float]]) -> Column:
    parts = [F.element_at(F.array(*map(F.lit, r)), F.element_at("bins", f + 1) + 1) for f, r in enumerate(ratios)]
    return sum(parts[1:], parts[0])


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(groups: DataFrame, prior: str, least: float = 1.0, most: float = 1000.0) -> float:
    """How many documents the level above is worth, by the method of moments: within-group over between-group variance
    of the posterior means. No spread between groups, or a single one, gives `most`."""
    mean = F.col("s") / F.col("n")
    r = groups.where("n > 1").agg(
        F.sum(F.col("q") - F.col("n") * mean * mean).alias("within"), F.sum(F.col("n") - 1).alias("df"),
        F.sum(F.col("n") * (mean - F.col(prior)) ** 2).alias("between"), F.sum("n").alias("n"), F.count("*").alias("k"),
    ).first()
    if not r["k"] or not r["df"]:
        return most
    within = max(r["within"] / r["df"], 1e-9)
    between = (r["between"] - r["k"] * within) / r["n"]
    return most if between <= 0 else min(most, max(least, within / between))


def score(docs: DataFrame, model: Model, key: str = "doc_id", host: str = "source", path: str = "lang", text: str = "text") -> DataFrame:
    """(key, evidence, host_posterior, path_posterior, score, predicted) of each row of docs.

    Site sums are grouped aggregates with partial sums, so a host with a third of all rows costs one row a task before
    the shuffle; the join back has only small rows on its large side and a written table on the other, which adaptive
    execution broadcasts or splits by its size. Null or empty texts have zero features; null hosts and paths are a group
    of their own; repeated rows count each. An empty table gives an empty result.
    """
    return _score(featured(docs, key, host, path, text), model, key)


def _score(rows: DataFrame, model: Model, key: str) -> DataFrame:
    prior, base = model.prior, float(math.log(model.prior / (1 - model.prior)))
    rows = rows.withColumn("bins", bins(model.edges)).withColumn("e", evidence(model.ratios) * model.slope + model.intercept)
    rows = cut(rows.select("key", "host", "path", "e", (1 / (1 + F.exp(-(F.col("e") + base)))).alias("p")))
    paths = cut(rows.groupBy("host", "path").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"), F.count("*").cast("double").alias("n")))
    hosts = cut(paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n")).withColumn("up", F.lit(prior)))
    k_host = strength(hosts, "up")
    shrunk = hosts.select("host", F.col("s").alias("host_s"), F.col("n").alias("host_n"), ((F.col("s") + k_host * prior) / (F.col("n") + k_host)).alias("up"))
    sites = cut(paths.join(shrunk, "host"))
    k_path = strength(sites, "up")
    own = F.col("p")
    host_post = (F.col("host_s") - own + k_host * prior) / (F.col("host_n") - 1 + k_host)
    clip = lambda c: F.greatest(F.lit(0.001), F.least(F.lit(0.999), c))
    out = rows.join(sites.select("host", "path", "s", "n", "host_s", "host_n"), ["host", "path"])
    out = out.withColumn("host_posterior", clip(host_post)).withColumn("path_posterior", clip((F.col("s") - own + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)))
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("e") + _logit(F.col("path_posterior"))))))
    return out.select(F.col("key").alias(key), F.round("e", 6).alias("evidence"), F.round("host_posterior", 6).alias("host_posterior"), F.round("path_posterior", 6).alias("path_posterior"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", host: str = "source", path: str = "lang", text: str = "text") -> DataFrame:
    """Learn from the labelled rows among docs, then `score` all: the features of a text are computed once.

    Returns the columns that `score` names and no others of docs, so none can clash. Null and empty texts have zero
    features; null hosts and paths are a group of their own; null keys are scored and learn nothing; repeated rows come
    back each and count each; a label of a repeated key counts for each of its rows. Ties in a feature share a bin. Whole
    texts of any length are read. Without labels every document has the evidence of none; an empty table gives an empty
    result."""
    rows = cut(featured(docs, key, host, path, text))
    return _score(rows, learn(rows, labels, key), key)
