"""URL filter: rules first, then gradient-boosted trees on lexical features of the URL.

Rules name a host and a path prefix; a rule fits its host and all subdomains if the path starts with the rule's path, and
the longest fitting rule decides. Other URLs are judged by boosted trees trained from labelled URLs: lengths, depth, digit
ratio, entropy of characters, counts of parameters, dots, hyphens and other marks, and statistics of the host's suffix
(how often it occurs among labelled URLs, and its smoothed share of blocked ones).

Features are column expressions. Suffix statistics are counted over all labelled URLs and kept in a table, which is joined:
broadcast if it has at most ``most_broadcast`` rows (they are counted), by a shuffle on the suffix otherwise. A URL that the
trees are fitted on has those of the other folds only (folds go by a hash of the URL), as shares of what these folds hold, so no label
tells of itself and shares have the same scale in fit and scoring. A suffix without labelled URLs is a case of its own: it has the share of all, and
one in ``HIDDEN`` of the URLs fitted on is shown so, from which the trees learn to go by the other features then. Trees
are fitted on at most about ``most_rows`` distinct labelled URLs, taken by a hash of the URL whose share follows from the
number of distinct ones, and weighted by how often they come: so the fit grows neither with the corpus nor with repeated
rows. Scoring reads the url column only and is narrow while the statistics are broadcast.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule and is judged by the trees on its
zero features. Without labelled URLs, or with one label only, the verdict without a rule is that label, or allow. Repeated
rows are judged each for itself. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import ascii_lower, written

#: Fixed values of the registered query.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty without a scheme."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule, or null. Of equally long ones, the first in alphabetical order."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        at, slash, rest = r.partition("/")
        at = at.lower()
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(r)).otherwise(found)
    return found


def _count(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)


def _entropy(text: Column) -> Column:
    """Of the distribution of characters, in bits."""
    n = F.length(text)
    sizes = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0.0).otherwise((n - F.length(F.replace(text, c, F.lit("")))).cast("double") / n))
    return F.when(n == 0, 0.0).otherwise(F.aggregate(sizes, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)))


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    n = F.greatest(F.length(u), F.lit(1))
    digits = F.length(F.regexp_replace(u, "[^0-9]", ""))
    return {
        "length": F.length(u),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": _count(path, "/"),
        "digit_ratio": digits / n,
        "path_digits": F.length(F.regexp_replace(path, "[^0-9]", "")),
        "entropy": _entropy(u),
        "host_entropy": _entropy(host),
        "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "query_length": F.length(query),
        "labels": _count(host, ".") + 1,
        "hyphens": _count(host, "-"),
        "percents": _count(u, "%"),
        "fragment": F.contains(u, F.lit("#")).cast("int"),
        "secure": u.startswith("https://").cast("int"),
        "trailing_slash": path.endswith("/").cast("int"),
        "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"),
    }


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


FOLDS = 5
#: One in so many of the URLs that the trees are fitted on has its suffix hidden.
HIDDEN = 3


@dataclass
class UrlModel:
    """trees: None if there was nothing to tell apart; then ``only`` is the verdict. suffixes: suffix, seen, bad (counts) and so for each fold."""

    trees: PipelineModel | None
    only: str = "allow"
    suffixes: DataFrame | None = None
    broadcast: bool = True
    total: int = 0
    bad: int = 0
    total_in: list[int] | None = None


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), F.col("url")), F.lit(FOLDS)).cast("int")


def _with_features(urls: DataFrame, m: UrlModel, others_only: bool = False) -> DataFrame:
    """Adds f_ columns; urls has url, host, path. ``others_only``: suffix statistics leave out the URL's own fold."""
    out = urls.withColumns({f"f_{k}": v.cast("double") for k, v in features(F.col("url"), F.col("host"), F.col("path")).items()})
    stats = F.broadcast(m.suffixes) if m.broadcast else m.suffixes
    out = out.withColumn("__suffix", suffix_of(F.col("host"))).join(stats.withColumnRenamed("suffix", "__s"), F.col("__suffix") == F.col("__s"), "left")
    own = lambda listed: F.get(listed, _fold()) if others_only else F.lit(0)
    listed = lambda values: F.array(*map(F.lit, values))
    of = lambda c: F.coalesce(F.col(c) - own(F.col(f"{c}_in")), F.lit(0))
    total, share = F.greatest(F.lit(m.total) - own(listed(m.total_in)), F.lit(1)), m.bad / m.total  # of all folds, or it would tell of the own one
    hidden = F.pmod(F.xxhash64(F.lit("hidden"), F.col("url")), F.lit(HIDDEN)) == 0 if others_only else F.lit(False)
    known = (of("seen") > 0) & ~hidden
    out = out.withColumns({"f_suffix_known": known.cast("double"), "f_suffix_seen": F.when(known, of("seen") / total).otherwise(0.0), "f_suffix_blocked": F.when(known, (of("bad") + 10 * share) / (of("seen") + 10)).otherwise(share)})
    return out.drop("__suffix", "__s", "seen", "bad", "seen_in", "bad_in")


def train(labelled: DataFrame, most_rows: int = 20_000, most_broadcast: int = 50_000, rounds: int = 15, depth: int = 3) -> UrlModel:
    """From url, host, path and blocked (0 or 1; null: not labelled)."""
    rows = labelled.where("blocked is not null").select("url", "host", "path", F.col("blocked").cast("int").alias("blocked"))
    in_fold = lambda k: F.when(_fold() == k, 1).otherwise(0)
    per = rows.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(
        F.count("*").alias("seen"), F.sum("blocked").alias("bad"),
        F.array(*[F.sum(in_fold(k)) for k in range(FOLDS)]).alias("seen_in"), F.array(*[F.sum(in_fold(k) * F.col("blocked")) for k in range(FOLDS)]).alias("bad_in"),
    )
    per = written(per, "suffixes")
    in_folds = [F.sum(F.get("seen_in", k)) for k in range(FOLDS)]
    known, n, bad, *of_folds = per.agg(F.count("*"), F.sum("seen"), F.sum("bad"), *in_folds).first()
    if not n or bad in (0, n):
        return UrlModel(None, "block" if n and bad == n else "allow")
    m = UrlModel(None, "allow", per, known <= most_broadcast, n, bad, of_folds)
    span = 1 << 30
    distinct = rows.agg(F.approx_count_distinct("url", 0.01)).first()[0] + 1
    taken = rows.where(F.pmod(F.xxhash64("url"), F.lit(span)) < min(span, most_rows * span // distinct))
    sample = taken.groupBy("url", "host", "path", "blocked").agg(F.count("*").cast("double").alias("weight"))
    ready = _with_features(sample, m, others_only=True).withColumn("label", F.col("blocked").cast("double"))
    names = [c for c in ready.columns if c.startswith("f_")]
    ready = written(ready.select("label", "weight", *names), "url-sample")  # each round reads the bounded sample, not all URLs
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=1, stepSize=0.2, weightCol="weight").fit(assembler.transform(ready).select("features", "label", "weight"))
    m.trees = PipelineModel([assembler, trees])
    return m


def scored(urls: DataFrame, m: UrlModel) -> DataFrame:
    """Adds ``p``, the trees' probability of block, to url, host and path."""
    from pyspark.ml.functions import vector_to_array

    return m.trees.transform(_with_features(urls, m)).withColumn("p", F.get(vector_to_array("probability"), 1))


def with_parts(df: DataFrame) -> DataFrame:
    """Adds host and path of the column url."""
    host, path = parts(F.col("url"))
    return df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def judge(pages: DataFrame, rules: dict[str, str] | None = None, labels: DataFrame | None = None, key: str = "page_id", url: str = "url", **parameters) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability of block, null where a rule decides).

    labels: url and blocked. Without it, URLs that a rule decides are the labelled ones.
    """
    rules = RULES if rules is None else rules
    said = F.element_at(F.create_map(*[F.lit(x) for r, v in rules.items() for x in (r, v)]), F.col("rule")) if rules else F.lit(None).cast("string")
    urls = with_parts(pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("ruled", said)
    if labels is None:
        labelled = urls.select("url", "host", "path", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0).alias("blocked"))
    else:
        labelled = with_parts(labels.select("url", F.col("blocked").cast("int").alias("blocked")))
    m = train(labelled, **parameters)
    if m.trees is None:
        return urls.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(m.only)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    done = scored(urls, m)
    verdict = F.coalesce("ruled", F.when(F.col("p") >= 0.5, "block").otherwise("allow"))
    return done.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("ruled").isNull(), F.round("p", 6)).alias("score"))
