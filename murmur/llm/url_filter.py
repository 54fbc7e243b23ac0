"""URL verdicts by rules and, where none fits, by a logistic regression, in built-in functions only.

The regression knows hashed character trigrams of host and path. It is trained
from a small labelled table by gradient steps, each one aggregate; the table is
bounded by ``MOST_LABELLED`` rows, the model by ``BUCKETS`` weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.arrow import staged
from murmur.llm.sampling import least_hashed

#: (host, path, verdict): fits the host and its subdomains where the path begins so.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
BUCKETS, GRAM = 4096, 3
MOST_LABELLED = 2_000
STEPS, RATE, DECAY = 15, 0.6, 1e-3
#: Bias of a model that saw no label: it scores every url alike, under 0.5, and so allows it.
UNTRAINED = -1.0


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; without ``://`` both are empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    found = [
        F.when(
            ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path)),
            F.struct(F.lit(len(rule_host + rule_path)).alias("size"), F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for rule_host, rule_path, verdict in rules
    ]
    return F.greatest(*found) if len(found) > 1 else found[0]


def grams(host: Column, path: Column) -> Column:
    """Buckets of the distinct trigrams of host and path, ends marked."""

    def of(text: Column, side: str) -> Column:
        found = F.regexp_extract_all(F.concat(F.lit("\x02"), text, F.lit("\x03")), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1)
        return F.transform(found, lambda g: F.pmod(F.xxhash64(F.lit(side), g), F.lit(BUCKETS)).cast("int"))

    return F.array_distinct(F.concat(of(host, "host"), of(path, "path")))


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights by bucket and bias from rows (url, blocked), by adaptive gradient steps.

    Of more than ``MOST_LABELLED`` rows those with the least hash of the url are
    taken. Null labels are left out; with no row at all every weight is 0 and the
    bias ``UNTRAINED``, as a model that learned nothing must not block.
    """
    host, path = parts(F.col("url"))
    rows = labelled.where("blocked is not null").select("url", F.col("blocked").cast("double").alias("blocked"))
    rows = least_hashed(rows.groupBy("url").agg(F.max("blocked").alias("blocked")), F.xxhash64("url"), "url", MOST_LABELLED)
    rows = staged(rows.select("blocked", grams(host, path).alias("grams")), "labelled")
    count, share = rows.agg(F.count(F.lit(1)), F.avg("blocked")).first()
    if not count:
        return [0.0] * BUCKETS, UNTRAINED
    w, squares = [0.0] * (BUCKETS + 1), [0.0] * (BUCKETS + 1)  # the last is the bias
    for _ in range(STEPS):
        off = rows.select("grams", (_probability(F.col("grams"), w) - F.col("blocked")).alias("off"))
        seen = off.select("off", F.explode(F.array_append("grams", F.lit(BUCKETS))).alias("bucket"))
        slopes = seen.groupBy("bucket").agg(F.sum("off").alias("slope")).collect()  # at most BUCKETS + 1 rows
        for bucket, slope in slopes:
            slope = slope / count + DECAY * w[bucket]
            squares[bucket] += slope * slope
            w[bucket] -= RATE * slope / (squares[bucket] ** 0.5 + 1e-8)
        w = [round(x, 9) for x in w]  # sums differ in their last digits with the order of the rows
    return w[:-1], w[-1]


def _probability(found: Column, weights: list[float]) -> Column:
    """What a model says of a text with these buckets; the weights fold into one constant."""
    model = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")
    margin = F.aggregate(found, F.lit(float(weights[-1])), lambda sum_, g: sum_ + F.get(model, g))
    return 1 / (1 + F.exp(-margin))


def url_filter(
    pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    The longest fitting rule decides, of equally long ones the last by code
    point; ``rule`` is null where the regression does: it blocks from a score of
    0.5 on, and never if it had no label to learn from. A null url, or one without ``://``, has an empty host and path.
    Repeated rows are judged each; other columns are not looked at.
    """
    weights, bias = train(labelled)
    host, path = parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("score", _probability(grams(F.col("host"), F.col("path")), [*weights, bias]))
    verdict = F.coalesce("found.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "score")


def labelled_by_rules(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """A small labelled table (url, blocked): urls that a rule decides, bounded by ``MOST_LABELLED``."""
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select("url", rule_of(host, path, rules)["verdict"].alias("verdict")).where("verdict is not null")
    rows = rows.select("url", F.when(F.col("verdict") == "block", 1).otherwise(0).alias("blocked"))
    return least_hashed(rows.distinct(), F.xxhash64("url"), "url", MOST_LABELLED)
