"""Mixing sources to target weights, in SQL functions only.

A source's weight is its token share to the power of an exponent, normalised: 1 keeps the shares, 0 makes
all sources equal. The exponent is found by bisection, STEPS grid points to a pass over the sources' totals: the
largest at which the weights' entropy reaches the target, then raised, if need be, to the smallest at which no source
is repeated more than `repeats` times. A source's quota is its weight times the budget, in whole tokens.

Each source's documents are dealt by hash into blocks, a power of two of them, of about BLOCK_TOKENS tokens. Every epoch
permutes a source's blocks (a bijection on their numbers, computed, not stored) and the documents within them; a document's place in an epoch
is a 63-bit number, the block's place first. A quota is so many whole epochs, and of one more epoch all documents before a cut: the first
that the quota has no room for. So each source gets its quota to within a document. `mix_at`, the share of the source's quota that lies before
the document if tokens are spread evenly over places, interleaves the sources when sorted by.

One pass over the texts writes a narrow table (source, hash, tokens). On that, the cuts of all sources are found together by histograms: tokens by
(source, bin of places), at most BINS rows a source; the bin that holds the cut is cut into bins again, until it has one
document. The plan is one row a source, whatever its size: a hot source is never gathered in one task. Documents meet the plan by their source, by
broadcast where Spark finds the written plan small, else in a join whose skewed partitions are split (adaptive execution).

Defined results: a null source is a source of its own; null texts have no tokens and null ids hash like any value; very long texts count as
a whole; rows without tokens come along with their place; rows that repeat an id and a text have one place and are taken together, so a cut may
leave the quota short by all of them; sources without tokens get weight 0 and no row; an empty table gives no rows. Columns named __* or mix_* are dropped
from the input. Without a target (evenness and repeats both None) all weights are equal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, materialize

BLOCK_TOKENS, STEPS, PASSES, BINS = 1 << 16, 64, 5, 1 << 12
SEED, PLACES, MOST_BLOCK_BITS = 20_011, 63, 30


def token_count(text: Column) -> Column:
    """Runs of non-space characters."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D ]+", " "))
    # no branch: Spark computes flat once only where it is needed for sure
    return (F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + (flat != "").cast("int")).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({
        "__source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")),
        "__hash": F.xxhash64(F.lit(SEED), "doc_id", "text"),
    })


def _shift(direction: str, x: Column, n: Column) -> Column:
    return F.call_function(f"shift{direction}", x, n.cast("int"))


def block_of(hashed: Column, bits: Column) -> Column:
    return hashed.bitwiseAND(_shift("left", F.lit(1).cast("long"), bits) - 1)


def place_of(hashed: Column, bits: Column, epoch: Column) -> Column:
    """The document's place in an epoch of its source, from 0 to 2**63 - 1: its block's place, then its own within the block."""
    low = _shift("left", F.lit(1).cast("long"), bits) - 1
    odd = lambda k: F.xxhash64(F.lit(SEED), F.lit(k), epoch).bitwiseAND(F.lit((1 << 31) - 1)).bitwiseOR(F.lit(1))
    # odd factors, sums and an exclusive or with the own upper half are bijections on numbers of so many bits
    b = (block_of(hashed, bits) * odd(1).cast("long") + odd(2).cast("long")).bitwiseAND(low)
    b = b.bitwiseXOR(_shift("right", b, F.floor((bits + 1) / 2)))
    b = (b * odd(3).cast("long")).bitwiseAND(low)
    own = F.call_function("shiftrightunsigned", F.xxhash64(F.lit(SEED), hashed, epoch), (bits + 1).cast("int"))
    return _shift("left", b, PLACES - bits).bitwiseOR(own)


def _measure(sources: DataFrame, alphas: list[float], budget: float) -> list:
    """Entropy and most repeats of the weights at each exponent."""
    power = F.pow("share", F.col("alpha"))
    at = sources.select("share", "tokens", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    z = at.groupBy("alpha").agg(F.sum(power).alias("z"), F.sum(power * F.log(power)).alias("s"), F.max(power / F.col("tokens")).alias("r"))
    return z.select("alpha", (F.log("z") - F.col("s") / F.col("z")).alias("entropy"), (F.lit(budget) * F.col("r") / F.col("z")).alias("repeats")).orderBy("alpha").collect()


def exponent(sources: DataFrame, budget: float, entropy: float | None, repeats: float | None) -> float:
    """sources: share, tokens. Entropy falls and repetition falls as the exponent grows from 0 to 1."""
    found = 0.0
    for ok, from_above in (
        (None if entropy is None else lambda r: r["entropy"] >= entropy - 1e-12, False),
        (None if repeats is None else lambda r: r["repeats"] <= repeats + 1e-9, True),
    ):
        if ok is None:
            continue
        lo, hi = (found, 1.0) if from_above else (0.0, 1.0)
        for _ in range(PASSES):
            grid = [lo + (hi - lo) * i / STEPS for i in range(STEPS + 1)]
            good = [ok(r) for r in _measure(sources, sorted(set(grid)), budget)]
            if from_above:  # the smallest that is good, else 1
                i = next((i for i, g in enumerate(good) if g), len(good) - 1)
                lo, hi = grid[max(0, i - 1)], grid[i]
                found = hi
            else:  # the largest that is good, else 0
                i = max((i for i, g in enumerate(good) if g), default=0)
                lo, hi = grid[i], grid[min(len(good) - 1, i + 1)]
                found = lo
            if lo == hi:
                break
        if from_above and found > 1 - 1e-6:
            found = 1.0  # the end itself, which repeats no more: the sources' own shares, without what the last pass leaves open
    return found


def _cuts(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with __cut: the first place in epoch __epochs that the rest of the quota has no room for. narrow: __source, __hash, tokens."""
    state = materialize(plan.filter("__rest > 0").select("__source", "__bits", "__epochs", "__rest", F.lit(0).cast("long").alias("__low"), F.lit(0).cast("long").alias("__before")), "mixing-cuts")
    width = PLACES
    while width > 0 and not state.isEmpty():
        step = max(0, width - (BINS.bit_length() - 1))
        now = state.drop("__n")
        at = narrow.join(now, "__source").withColumn("__place", place_of(F.col("__hash"), F.col("__bits"), F.col("__epochs")))
        # both sides are at most 2**63 - 1: the difference of places does not overflow
        inside = (F.col("__place") >= F.col("__low")) & (F.shiftright(F.col("__place") - F.col("__low"), width) == 0)
        bins = at.filter(inside).groupBy("__source", F.shiftright(F.col("__place") - F.col("__low"), step).alias("__bin")).agg(F.sum("tokens").alias("__t"), F.count(F.lit(1)).alias("__n"))
        up = Window.partitionBy("__source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most BINS rows a source
        upto = bins.withColumn("__upto", F.sum("__t").over(up)).join(now, "__source")
        crossing = upto.filter(F.col("__before") + F.col("__upto") > F.col("__rest")).groupBy("__source").agg(F.min_by(F.struct("__bin", "__n", (F.col("__upto") - F.col("__t")).alias("__t")), "__bin").alias("__x"))
        # a bin crosses in every pass, for an epoch has more tokens than the rest
        moved = now.join(crossing, "__source").select(
            "__source", "__bits", "__epochs", "__rest",
            (F.col("__low") + F.shiftleft("__x.__bin", step)).alias("__low"),
            (F.col("__before") + F.col("__x.__t")).alias("__before"), F.col("__x.__n").alias("__n"),
        )
        old, state, width = state, materialize(moved, "mixing-cuts"), step
        discard(old)
        if state.agg(F.max("__n")).first()[0] <= 1 and step > 0:
            # the one document of a bin: its own place is the cut
            single = narrow.join(state, "__source").withColumn("__place", place_of(F.col("__hash"), F.col("__bits"), F.col("__epochs")))
            inside = (F.col("__place") >= F.col("__low")) & (F.shiftright(F.col("__place") - F.col("__low"), step) == 0)
            cut = single.filter(inside).groupBy("__source").agg(F.min("__place").alias("__cut"))
            return plan.join(cut, "__source", "left")
    return plan.join(state.select("__source", F.col("__low").alias("__cut")), "__source", "left")


def mix(docs: DataFrame, evenness: float | None = 0.95, repeats: float | None = 4.0, budget: float | None = None) -> DataFrame:
    """docs' rows as often as the mix takes them, with mix_epoch, mix_block, mix_at, mix_weight.

    evenness: the target entropy as a share of the most, log(number of sources); budget: tokens, all by default."""
    docs = docs.drop(*[c for c in docs.columns if c.startswith(("__", "mix_"))])
    narrow = materialize(_keyed(docs).select("__source", "__hash", token_count(F.col("text")).alias("tokens")), "mixing-narrow")
    totals = narrow.groupBy("__source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    all_tokens = totals.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    total, n = float(all_tokens["t"] or 0), all_tokens["n"]
    budget = total if budget is None else float(budget)
    sources = materialize(totals.withColumn("share", F.col("tokens") / F.lit(max(total, 1.0))), "mixing-sources")
    alpha = exponent(sources, budget, None if evenness is None else evenness * math.log(max(n, 1)), repeats) if n else 1.0
    z = sources.agg(F.sum(F.pow("share", F.lit(alpha))).alias("z")).first()["z"] or 1.0
    weight = F.pow("share", F.lit(alpha)) / F.lit(float(z))
    bits = F.least(F.lit(MOST_BLOCK_BITS), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("tokens") / F.lit(float(BLOCK_TOKENS))))).cast("int"))
    quotas = sources.select("__source", F.col("tokens").alias("__all"), weight.alias("mix_weight"), bits.alias("__bits"), F.round(weight * F.lit(budget)).cast("long").alias("__quota"))
    epochs = F.call_function("div", F.col("__quota"), F.col("__all"))
    plan = quotas.withColumns({"__epochs": epochs, "__rest": F.col("__quota") - epochs * F.col("__all")})
    plan = materialize(plan.filter("__quota > 0"), "mixing-quotas")
    plan, quotas = materialize(_cuts(narrow, plan), "mixing-plan"), plan
    discard(narrow, sources, quotas)
    dealt = _keyed(docs).join(plan, "__source").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__epochs"))))
    dealt = dealt.withColumn("__place", place_of(F.col("__hash"), F.col("__bits"), F.col("mix_epoch")))
    taken = dealt.filter((F.col("mix_epoch") < F.col("__epochs")) | (F.col("__place") < F.col("__cut")))
    at = F.least(F.lit(1.0), (F.col("mix_epoch") + F.col("__place") / F.lit(2.0**PLACES)) * F.col("__all") / F.col("__quota"))
    return taken.select(*docs.columns, F.col("mix_epoch").cast("int").alias("mix_epoch"), block_of(F.col("__hash"), F.col("__bits")).cast("int").alias("mix_block"), at.alias("mix_at"), "mix_weight")
