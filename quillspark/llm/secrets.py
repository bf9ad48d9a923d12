"""Secret scans: fixed patterns, and a battery of randomness tests (DataFrame functions only).

A token's encoding is inferred from its characters. Three tests ask whether it could be drawn evenly from that
alphabet: chi-squared over alphabet ranges, runs above and below the middle, and serial correlation; Fisher's
method combines them. How often words strung together to such a length look as random, by a fixed table, gives a
token's p-value; a step-up rule over the tokens of one range of lengths and one encoding keeps the expected share of
words among those reported under ``FALSE_SHARE``, however many words the corpus holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rest, stage

#: Fixed patterns, and the kinds in the order in which spans of one start are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
TOKEN, SHORTEST = r"[A-Za-z0-9+/_=-]{20,}", 20
#: Of the tokens reported, the share that may be words, as expected; tokens of one range of lengths and one encoding are judged together.
FALSE_SHARE = 0.05
LENGTHS = (20, 22, 24, 28, 32, 40, 48, 64)
TAILS = (0.05, 0.02, 0.01, 0.005, 0.002, 0.001, 0.0005, 0.0002)
#: By length from which it holds: the scores that the shares ``TAILS`` of strings of joined words exceed, of letters of one case and of others
#: (capitals at word starts, which look the most random of them). ``secret_levels`` fits them, here on the documents of sf0.1.
LEVELS: dict[int, tuple[tuple[float, ...], tuple[float, ...]]] = {
    20: ((0.78597, 0.88954, 0.93461, 0.96441, 0.9851, 0.99076, 0.99481, 0.99794), (0.40412, 0.53061, 0.63137, 0.7015, 0.78548, 0.83777, 0.86681, 0.9183)),
    22: ((0.74954, 0.87143, 0.92251, 0.95582, 0.97869, 0.98555, 0.9917, 0.99686), (0.32544, 0.45578, 0.54803, 0.64177, 0.72602, 0.78468, 0.83331, 0.87555)),
    24: ((0.71099, 0.84102, 0.90566, 0.94204, 0.97192, 0.98511, 0.99111, 0.99516), (0.25973, 0.38447, 0.47553, 0.56133, 0.66681, 0.73586, 0.79701, 0.87733)),
    28: ((0.63702, 0.78398, 0.85744, 0.91113, 0.95723, 0.97396, 0.9883, 0.99237), (0.15367, 0.24658, 0.32304, 0.41229, 0.51345, 0.57988, 0.64985, 0.72622)),
    32: ((0.55616, 0.72061, 0.81224, 0.87525, 0.9334, 0.9617, 0.97909, 0.98946), (0.0892, 0.15555, 0.21129, 0.27692, 0.37969, 0.44435, 0.49873, 0.57722)),
    40: ((0.41923, 0.59462, 0.70025, 0.79651, 0.87568, 0.91192, 0.95655, 0.97392), (0.02468, 0.05083, 0.07914, 0.11359, 0.17074, 0.21213, 0.25785, 0.3344)),
    48: ((0.1762, 0.30465, 0.40644, 0.49621, 0.61986, 0.70281, 0.77142, 0.80885), (0.00583, 0.01343, 0.02268, 0.03509, 0.05568, 0.06991, 0.10871, 0.13724)),
    64: ((0.04554, 0.10264, 0.16209, 0.23568, 0.33114, 0.41562, 0.48471, 0.56366), (0.00018, 0.00054, 0.00105, 0.00179, 0.00349, 0.00577, 0.00808, 0.01384)),
}
#: Alphabets of the encodings, tried in this order.
ENCODINGS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36_upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def spans(text: Column, pattern: str, maybe: Column) -> Column:
    """Array of (start, end, match) of all matches, in code points; only texts where ``maybe`` holds are searched.

    The pieces between the matches and the matches themselves take turns, so their lengths give the offsets.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.coalesce(F.length(x["hit"]), F.lit(0))
        own = F.array(F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end"), x["hit"].alias("hit")))
        return F.struct(b.cast("bigint").alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], own)).alias("out"))

    return F.when(maybe, F.aggregate(pairs, start, step)["out"]).otherwise(empty)


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 by a rational approximation (absolute error under 2e-7)."""
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def _two_sided(z: Column) -> Column:
    return _erfc(F.abs(z) / math.sqrt(2))


def _even_chi_tail(x: Column, dof: int) -> Column:
    """P(chi-squared > x) for an even number of degrees of freedom."""
    h, term, total = x / 2, F.lit(1.0), F.lit(1.0)
    for j in range(1, dof // 2):
        term = term * h / j
        total = total + term
    return F.exp(-h) * total


def battery(tokens: DataFrame) -> DataFrame:
    """``tokens`` (token) with encoding, p_uniform, p_runs, p_serial and score (Fisher's p: high looks random)."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("token", "=+$", ""), "-", "+"), "_", "/")
    rows = tokens.withColumn("_body", body)
    name, alphabet = F.lit("base64"), F.lit(ENCODINGS[-1][1])
    for n, letters in reversed(ENCODINGS[:-1]):
        fits = F.col("_body").rlike(f"^[{letters}]+$")
        name, alphabet = F.when(fits, F.lit(n)).otherwise(name), F.when(fits, F.lit(letters)).otherwise(alphabet)
    rows = rows.withColumns({"encoding": name, "_abc": alphabet})
    rows = rows.withColumn("_v", F.transform(F.split("_body", ""), lambda c: (F.instr(F.col("_abc"), c) - 1).cast("double")))
    rows = rows.withColumn("_v", F.filter("_v", lambda v: v >= 0))
    rows = rows.withColumns({"_n": F.size("_v").cast("double"), "_a": F.length("_abc").cast("double")})
    n, a = F.col("_n"), F.col("_a")

    def uniform(bins: int) -> Column:
        def part(b: Column) -> Column:
            share = (F.floor((b + 1) * a / bins) - F.floor(b * a / bins)) / a
            seen = F.size(F.filter("_v", lambda v: (v >= F.floor(b * a / bins)) & (v < F.floor((b + 1) * a / bins))))
            return (seen - n * share) * (seen - n * share) / (n * share)

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), part), F.lit(0.0), lambda s, x: s + x)

    high = F.transform("_v", lambda v: v >= a / 2)
    rows = rows.withColumns({"_chi5": uniform(5), "_chi9": uniform(9), "_high": high, "_mean": F.aggregate("_v", F.lit(0.0), lambda s, x: s + x) / n})
    n1 = F.size(F.filter("_high", lambda h: h)).cast("double")
    changes = F.size(F.filter(F.zip_with(F.slice("_high", 2, F.greatest(F.size("_high") - 1, F.lit(0))), F.slice("_high", 1, F.greatest(F.size("_high") - 1, F.lit(0))), lambda x, y: x != y), lambda x: x))
    off = F.transform("_v", lambda v: v - F.col("_mean"))
    rows = rows.withColumns({"_n1": n1, "_runs": (changes + 1).cast("double"), "_off": off})
    lagged = F.zip_with(F.slice("_off", 2, F.greatest(F.size("_off") - 1, F.lit(0))), F.slice("_off", 1, F.greatest(F.size("_off") - 1, F.lit(0))), lambda x, y: x * y)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumns({"_mu": 2 * F.col("_n1") * (n - F.col("_n1")) / n + 1, "_cov": total(lagged), "_var": total(F.transform("_off", lambda x: x * x))})
    mu = F.col("_mu")
    var = (mu - 1) * (mu - 2) / (n - 1)
    rows = rows.withColumns(
        {
            "p_uniform": F.when(n < 45, _even_chi_tail(F.col("_chi5"), 4)).otherwise(_even_chi_tail(F.col("_chi9"), 8)),
            "p_runs": F.when(var > 0, _two_sided((F.col("_runs") - mu) / F.sqrt(var))).otherwise(F.lit(0.0)),
            "p_serial": F.when(F.col("_var") > 0, _two_sided((F.col("_cov") / F.col("_var") + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0)),
        }
    )
    logs = sum((F.log(F.greatest(F.col(p), F.lit(1e-300))) for p in ("p_uniform", "p_runs", "p_serial")), F.lit(0.0))
    score = F.coalesce(_even_chi_tail(-2 * logs, 6), F.lit(0.0))
    return rows.withColumn("score", score).select(*tokens.columns, "encoding", "p_uniform", "p_runs", "p_serial", "score")


def with_chances(scored: DataFrame) -> DataFrame:
    """``scored`` (token, encoding, score) with range (of lengths) and p: the least of ``TAILS`` that says how often words joined to such a length look as random; 1 if more often than all of them."""
    p, range_ = F.lit(1.0), F.lit(0)
    single = F.col("encoding").isin("lower", "upper")

    def among(levels: tuple[float, ...]) -> Column:
        out = F.lit(1.0)
        for tail, level in zip(TAILS, levels, strict=True):
            out = F.when(F.col("score") >= level, tail).otherwise(out)
        return out

    for start, (letters, others) in LEVELS.items():
        long = F.length("token") >= start
        p, range_ = F.when(long, F.when(single, among(letters)).otherwise(among(others))).otherwise(p), F.when(long, start).otherwise(range_)
    return scored.withColumns({"p": p, "range": range_})


def discoveries(tokens: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """Of ``tokens`` (token, encoding, range, p) those that are reported, by an adaptive step-up rule (Benjamini and Hochberg's as Storey, Taylor and Siegmund have it) over the different tokens of each range and encoding.

    Words give 1 - TAILS[0] of their tokens a larger p than TAILS[0], so those that have one tell how many words, w, there are at most.
    Of these w * p are expected at or under p. The largest p with w * p <= share * r, for r tokens at or under it, bounds what is reported.
    """
    family = ["encoding", "range"]
    counts = tokens.select(*family, "p", F.xxhash64("token").alias("_t")).distinct().groupBy(*family, "p").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.partitionBy(*family).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.withColumns({"_r": F.sum("_n").over(so_far), "_w": (F.sum(F.when(F.col("p") > TAILS[0], F.col("_n")).otherwise(0)).over(Window.partitionBy(*family)) + 1) / (1 - TAILS[0])})  # a row for each of TAILS, at most
    bounds = steps.filter((F.col("p") < 1) & (F.col("_w") * F.col("p") <= F.col("_r") * share)).groupBy(*family).agg(F.max("p").alias("_bound"))
    return tokens.join(F.broadcast(bounds), family).filter(F.col("p") <= F.col("_bound")).drop("_bound")


def scan_secrets(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All columns of ``docs``, or those in ``keep``, with base and all: arrays of (start, end, kind) in code points, by start and kind.

    ``base`` holds the pattern matches, ``all`` also tokens that pass the battery and the step-up rule (see ``discoveries``) and touch none of them. Null
    and empty texts have none; an empty table gives an empty result; columns named like an output are replaced.
    """
    own = [c for c in rest(docs, "base", "all") if keep is None or c in keep]
    held = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0).alias("none"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kind = lambda number, found, keep: F.transform(F.filter(found, keep), lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end")))
    assign = spans(text, ASSIGN, text.rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""))
    access = spans(text, ACCESS, F.contains(text, F.lit("AKIA")))
    runs = spans(text, r"[0-9a-f]{24,}", text.rlike(r"[0-9a-f]{24}"))  # the same runs as HEX's of 24 and more
    rows = docs.select(
        held.alias("_own"),
        F.monotonically_increasing_id().alias("_row"),
        *(column.alias(name) for name, column in {
            "_a": kind(0, assign, lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6),
            "_b": kind(1, access, lambda x: F.length(x["hit"]) >= 20),
            "_c": kind(2, runs, lambda x: F.length(x["hit"]) >= 24),
            "_tokens": spans(text, TOKEN, text.rlike(TOKEN)),
        }.items()),
    )
    rows = rows.withColumn("base", F.array_sort(F.concat("_a", "_b", "_c"))).drop("_a", "_b", "_c")
    rows = stage(rows, "secret_spans")
    free = F.filter("_tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    tokens = rows.select("_row", F.explode(free).alias("t")).select("_row", "t.start", "t.end", F.col("t.hit").alias("token"))
    scored = stage(battery(tokens), "secret_scores")
    extra = discoveries(with_chances(scored)).groupBy("_row").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("_more"))
    joined = rows.join(extra, "_row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("_more", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))))
    return joined.select(*[F.col(f"_own.`{c}`") for c in own], "base", every.alias("all"))


def listed(spans_: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
