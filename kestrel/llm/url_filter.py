"""URL filter by the ratio of two character language models (operator 6).
DataFrame functions only.

Rules decide the urls they fit. The rest is judged by two variable-order Markov
models over the characters of host and path, one of the accepted and one of the
rejected urls. A model mixes contexts of 0 to ``ORDER`` characters: a context
seen often leaves little to the shorter ones, an unseen one leaves all
(Witten-Bell smoothing). The difference of the log-likelihoods, divided by the
number of characters, is compared with a threshold calibrated on labelled urls
that the models have not seen (one in ``FOLDS``): the one with the best mean of
the two classes' shares of right verdicts (ties: nearest 0).

Labels are the rules' own verdicts. Counts cover all labelled urls outside the
calibration fold. Likelihood differences are computed once per distinct
character sequence of ``ORDER`` + 1, a table bounded by the alphabet, and then
joined to the positions of the urls; frequent sequences are a skewed join that
Spark splits, and sums are partial before they are shuffled.

Defined results: a url that is null or has no ``://`` has an empty host and
path, fits no rule, and has score 0. Where one class has no labelled url, every
score is 0 and the method allows. Repeated urls are counted as often as they
occur and judged alike. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import bucket_count, cut, table

ORDER = 3
TASK_TEXTS = 4_000     # urls whose n-grams one task makes
FOLDS = 5
STEP = 0.01   # of the thresholds tried
START, END = "\u0002", "\u0003"
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(length, host length, rule, verdict) of the longest rule that fits, else null."""
    fits = []
    for verdict, rule in rules:
        domain, slash, start = rule.partition("/")
        inside = (host == domain) | F.endswith(host, F.lit("." + domain))
        fits.append(F.when(inside & F.startswith(path, F.lit(slash + start)), F.struct(
            F.lit(len(rule)).alias("length"), F.lit(len(domain)).alias("host_length"),
            F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*fits, F.lit(None).cast("struct<length:int,host_length:int,rule:string,verdict:string>"))


def _grams(text: Column) -> Column:
    padded = F.concat(F.lit(START * ORDER), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def gram_scores(seen: DataFrame) -> DataFrame:
    """``seen(gram, accepted, rejected)`` counts -> (gram, gain): the difference of
    the log-probabilities of the last character after the ones before it."""
    classes = ("accepted", "rejected")
    last = seen.groupBy(F.substring("gram", ORDER + 1, 1).alias("c")).agg(*[F.sum(k).alias(k) for k in classes])
    sums = last.agg(F.count("*").alias("alphabet"), *[F.sum(k).alias(k) for k in classes]).head()
    if not sums["accepted"] or not sums["rejected"]:
        return seen.select("gram", F.lit(0.0).alias("gain"))
    out = seen.withColumn("c", F.substring("gram", ORDER + 1, 1)).join(
        last.select("c", *[((F.col(k) + 1.0) / F.lit(float(sums[k] + sums["alphabet"] + 1))).alias(f"p_{k}") for k in classes]), "c") \
        .select("gram", *[f"p_{k}" for k in classes])
    for n in range(1, ORDER + 1):
        key, context = F.substring("gram", ORDER + 1 - n, n + 1), F.substring("key", 1, n)
        together = seen.groupBy(key.alias("key")).agg(*[F.sum(k).alias(f"n_{k}") for k in classes])
        before = together.groupBy(context.alias("context")).agg(
            *[F.sum(f"n_{k}").alias(f"all_{k}") for k in classes],
            *[F.count_if(F.col(f"n_{k}") > 0).alias(f"kinds_{k}") for k in classes])
        known = together.withColumn("context", context).join(before, "context").drop("context")
        out = out.withColumn("key", key).join(known, "key")
        for k in classes:
            mixed = (F.col(f"n_{k}") + F.col(f"kinds_{k}") * F.col(f"p_{k}")) / (F.col(f"all_{k}") + F.col(f"kinds_{k}"))
            out = out.withColumn(f"p_{k}", F.when(F.col(f"all_{k}") > 0, mixed).otherwise(F.col(f"p_{k}")))
        out = out.select("gram", *[f"p_{k}" for k in classes])
    return out.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("gain"))


def likelihood_ratios(urls: DataFrame) -> DataFrame:
    """``urls(text, label, n)`` with distinct texts; label true (accepted), false
    (rejected) or null, n how often -> (text_id, score), scores by models of the
    labelled urls outside the calibration fold."""
    learned = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(FOLDS)) != 0
    place = urls.withColumn("gram", F.explode(_grams(F.col("text"))))
    seen = cut(place.groupBy("gram").agg(
        F.coalesce(F.sum(F.when(learned & F.col("label"), F.col("n"))), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum(F.when(learned & ~F.col("label"), F.col("n"))), F.lit(0)).alias("rejected")))
    gains = cut(gram_scores(seen))
    return place.select("text_id", "gram").join(gains, "gram").groupBy("text_id") \
        .agg(F.round(F.sum("gain") / F.count("*"), 6).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """``scored(label, score, n)`` of held-out urls -> the threshold. Only counts
    per step of the score reach the driver (a few thousand numbers)."""
    steps = scored.groupBy(F.floor(F.col("score") / STEP).cast("bigint").alias("k"), "label") \
        .agg(F.sum("n").alias("n")).collect()
    good = {r["k"]: r["n"] for r in steps if r["label"]}
    bad = {r["k"]: r["n"] for r in steps if not r["label"]}
    if not good or not bad:
        return 0.0
    best = (-1.0, 0.0, 0)
    above, below, all_good, all_bad = sum(good.values()), 0, sum(good.values()), sum(bad.values())
    for k in range(min([*good, *bad]), max([*good, *bad]) + 2):
        share = above / all_good + below / all_bad   # threshold k * STEP: accepted from there on
        best = max(best, (round(share, 12), -abs(k * STEP), k))
        above, below = above - good.get(k, 0), below + bad.get(k, 0)
    return best[2] * STEP


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score, threshold."""
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url")) \
        .select("page_id", host.alias("host"), path.alias("path")) \
        .withColumn("fit", best_rule(F.col("host"), F.col("path"), rules)) \
        .withColumn("text", F.concat("host", "path"))
    texts = rows.where("text <> ''").groupBy("host", "path").agg(F.count("*").alias("n"), F.first("fit.verdict").alias("v")) \
        .withColumn("text", F.concat("host", "path")) \
        .withColumn("text_id", F.xxhash64("host", "path")).withColumn("label", F.col("v") == "allow") \
        .select("text_id", "text", "label", "n")
    texts = cut(texts)
    # the shuffle above may end in few partitions, and each text becomes many n-grams
    texts = cut(texts.repartition(bucket_count(texts.count(), TASK_TEXTS), "text_id"))
    scores = cut(likelihood_ratios(texts))
    held_out = texts.where(F.col("label").isNotNull() & (F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(FOLDS)) == 0))
    threshold = calibrate(held_out.join(scores, "text_id").select("label", "score", "n"))
    judged = rows.withColumn("text_id", F.xxhash64("host", "path")).join(scores, "text_id", "left")
    score = F.coalesce("score", F.lit(0.0))
    method = F.when((score >= threshold) | (F.col("text") == ""), "allow").otherwise("block")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                         F.coalesce(F.col("fit.verdict"), method).alias("verdict"),
                         score.alias("score"), F.lit(threshold).alias("threshold"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
