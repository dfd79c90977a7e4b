"""Mixing of sources to target weights (operator 8); DataFrame functions only.

Token shares of the sources are raised to one exponent between 0 and 1 and normalised. The exponent is found by
bisection: the entropy of the weights falls with it, and so does the most that any source is repeated. Each source is
then dealt in blocks of about equal token numbers; blocks and documents inside them are permuted by hashes, and whole
and partial passes over this permutation fill the source's budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Steps of the bisection; the exponent is then rounded to 6 digits.
STEPS = 22
#: Tokens of a block, on average, and documents; blocks of a source at most (they then grow with it).
BLOCK_TOKENS, BLOCK_ROWS, MAX_BLOCKS = 200_000, 20_000, 100_000
#: Exponents that one pass over the sources tries.
AT_ONCE = 64
#: Bytes of UTF-8 that count as a token where no token numbers are given.
TOKEN_BYTES = 4


def token_estimate(text: str = "text") -> Column:
    """Tokens of a text by its bytes, for any script and without a tokenizer; 0 for null."""
    return F.coalesce(F.ceil(F.octet_length(F.col(text)) / TOKEN_BYTES), F.lit(0)).cast("long")


def _bisect(below) -> tuple[float, float]:
    """The ends of an interval of length 2^-STEPS in [0, 1] at whose lower end ``below`` holds, and not at its upper end."""
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) else (low, middle)
    return low, high


def _entropies(sources: DataFrame, total: int, exponents: list[float]) -> list[float]:
    """Entropy in nats of the weights at each exponent; one pass over the sources."""
    share, out = F.col("tokens") / F.lit(float(total)), []
    for x in exponents:
        raised = F.pow(share, F.lit(x))
        out.append(F.log(F.sum(raised)) - F.sum(raised * F.log(raised)) / F.sum(raised))
    return sources.agg(F.array(*out).alias("e")).first().e


def _exponent(sources: DataFrame, totals, target_entropy: float | None, max_repeat: float | None) -> float:
    """The largest exponent whose weights reach the entropy, or else the smallest that keeps to the repetition limit."""
    if not totals.sources:
        return 1.0
    if target_entropy is None:
        # The most repeated source is the one with the fewest tokens, the least repeated one that with the most.
        spread = lambda x: (totals.most / totals.least) ** (1 - x)
        return round(_bisect(lambda x: spread(x) > max_repeat)[1], 6) if spread(0.0) > max_repeat else 0.0
    low, high = 0.0, 1.0
    if _entropies(sources, totals.tokens, [1.0])[0] >= target_entropy:
        return 1.0
    while high - low > 2.0**-STEPS:  # a bisection of several steps at a time
        tried = [low + (high - low) * k / AT_ONCE for k in range(1, AT_ONCE)]
        reach = [x for x, e in zip(tried, _entropies(sources, totals.tokens, tried)) if e >= target_entropy]
        low, high = (reach[-1], reach[-1] + (high - low) / AT_ONCE) if reach else (low, tried[0])
    return round(low, 6)


def source_weights(docs: DataFrame, scratch: Scratch, target_entropy: float | None = None, max_repeat: float | None = 4.0, budget: int | None = None) -> DataFrame:
    """For each source with tokens: tokens, rows, weight, target (tokens to deal), passes (whole), rest (tokens of a partial pass).

    ``docs(source, n_tokens, ...)`` may have a column n_rows, the rows that each one stands for. The exponent is
    the largest whose weights reach ``target_entropy`` (in nats; 0 if none does), or else the smallest that repeats no
    source more than ``max_repeat`` times as often as another. Without a budget, the budget is the one at which the
    least repeated source is dealt exactly once, so that every document is used.
    """
    rows = F.col("n_rows") if "n_rows" in docs.columns else F.lit(1)
    sources = docs.groupBy("source").agg(F.sum(F.col("n_tokens") * rows).alias("tokens"), F.sum(rows).cast("long").alias("rows")).where("tokens > 0")
    sources = scratch.save(sources, "sources")
    totals = sources.agg(F.count("*").alias("sources"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    exponent = _exponent(sources, totals, target_entropy, max_repeat)
    raised = sources.withColumn("raised", F.pow(F.col("tokens") / F.lit(float(totals.tokens or 1)), F.lit(exponent)))
    sums = raised.agg(F.sum("raised").alias("all"), F.max(F.col("tokens") / F.col("raised")).alias("scale")).first()
    weight = F.col("raised") / F.lit(sums["all"] or 1.0)
    most = F.lit(sums.scale or 0.0) * F.lit(sums["all"] or 1.0) if budget is None else F.lit(float(budget))
    target = F.floor(weight * most + 1e-6).cast("long")
    return raised.withColumn("target", target).select("source", "tokens", "rows", F.round(weight, 9).alias("weight"), "target", F.floor(F.col("target") / F.col("tokens")).cast("long").alias("passes"), (F.col("target") % F.col("tokens")).alias("rest"))


def plan_mix(
    docs: DataFrame, target_entropy: float | None = None, max_repeat: float | None = 4.0, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 17, tokens: str | Column = "n_tokens", prefix: str = ""
) -> DataFrame:
    """All columns of ``docs(doc_id, source, [text], ...)`` with block, place and copies for every row.

    ``tokens`` is the column that says how many tokens a row has (null and negative: none). ``copies`` is how often the row
    is dealt: the source's whole passes, and one more where the permuted order of the source reaches the row's last
    token within the rest. ``block`` numbers the blocks of a source in permuted order; ``place`` is the number of the
    source's tokens before the row in that order. A null source is a source like any other; rows of sources without any
    tokens are dealt once. Null ids are fine. Rows that are equal in doc_id, tokens and text count as one document of so
    many rows: they share a place and are dealt alike; rows that share a doc_id only are documents of their own. Names
    that begin with ``_mix_`` are reserved, and input columns named as the three new ones (after ``prefix``) are left out.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    n = F.greatest(F.lit(0), F.coalesce(F.col(tokens) if isinstance(tokens, str) else tokens, F.lit(0))).cast("long")
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))) if "text" in docs.columns else F.lit("")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), n.cast("string"), text))
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    named = docs.withColumns({"_mix_source": source, "_mix_key": key, "_mix_n": n})
    groups = scratch.save(named.groupBy("_mix_source", "_mix_key").agg(F.max("_mix_n").alias("_mix_n"), F.count("*").alias("_mix_m")), "groups")
    slim = groups.select(F.col("_mix_source").alias("source"), F.col("_mix_n").alias("n_tokens"), F.col("_mix_m").alias("n_rows"))
    weights = scratch.save(source_weights(slim, scratch, target_entropy, max_repeat, budget), "weights")
    blocks = F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens), F.ceil(F.col("rows") / BLOCK_ROWS))).cast("long")
    sized = weights.select(F.col("source").alias("_mix_source"), F.col("passes").alias("_mix_passes"), F.col("rest").alias("_mix_rest"), blocks.alias("_mix_blocks"))
    # A block's number is a hash already, so their order is a permutation of the blocks; keys are one of the documents.
    dealt = F.conv(F.substring("_mix_key", 1, 8), 16, 10).cast("long") % F.coalesce("_mix_blocks", F.lit(1))
    blocked = groups.join(sized, "_mix_source", "left").withColumn("_mix_block", dealt).withColumn("_mix_all", F.col("_mix_n") * F.col("_mix_m"))
    totals = blocked.groupBy("_mix_source", "_mix_block").agg(F.sum("_mix_all").alias("_mix_tokens"))
    by_source = Window.partitionBy("_mix_source").orderBy("_mix_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.save(totals.withColumn("_mix_start", F.coalesce(F.sum("_mix_tokens").over(by_source), F.lit(0))).drop("_mix_tokens"), "starts")
    in_block = Window.partitionBy("_mix_source", "_mix_block").orderBy("_mix_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = blocked.withColumn("_mix_end", F.sum("_mix_all").over(in_block)).join(starts, ["_mix_source", "_mix_block"])
    end = F.col("_mix_start") + F.col("_mix_end")
    copies = F.coalesce(F.col("_mix_passes") + (end <= F.col("_mix_rest")).cast("long"), F.lit(1)).cast("long")
    found = {"block": F.col("_mix_block"), "place": (end - F.col("_mix_all")).cast("long"), "copies": copies}
    placed = scratch.save(placed.select("_mix_source", "_mix_key", *(c.alias(f"_mix_out_{k}") for k, c in found.items())), "placed")
    out = named.join(placed, ["_mix_source", "_mix_key"])
    new = {prefix + k: F.col(f"_mix_out_{k}") for k in found}
    return out.select(*(out[c] for c in docs.columns if c not in new), *(c.alias(k) for k, c in new.items()))


def deal(docs: DataFrame, tokens: str | Column | None = None, **how) -> DataFrame:
    """Every row of ``docs(doc_id, source, text, ...)`` as often as the plan says, with the same columns.

    Without ``tokens`` they are estimated by the bytes of the text. Any other columns are fine.
    """
    planned = plan_mix(docs, tokens=token_estimate() if tokens is None else tokens, prefix="_mix_", **how)
    times = F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))
    dealt = planned.where("_mix_copies > 0").withColumn("_mix_time", F.explode(times))
    return dealt.select(*docs.columns)
