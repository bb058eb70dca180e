"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent: w ~ p^alpha.  alpha = 1 is the natural
mix, 0 the even one.  The largest alpha in [0, 1], in steps of 2^-20, is found that meets a
target entropy or a limit of repetition, by narrowing an interval over sums of the source table.
Each source then gets ``w * budget`` tokens: whole passes over its blocks, every pass a
permutation of its own, and of one more pass as many blocks as the rest of the budget holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialframe.llm.common import WORD, store

STEPS = 1 << 20
FAN = 32


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _values(sources: DataFrame, alphas: list[float], budget: float | None) -> list[float]:
    """Normalised entropy, or the largest repetition, at each exponent: two passes over sources."""
    log_p = F.log(F.col("tokens") / F.col("total"))
    terms = [F.sum(F.exp(a * log_p)).alias(f"z{i}") for i, a in enumerate(alphas)]
    z = sources.agg(*terms).first()
    out = []
    for i, a in enumerate(alphas):
        log_w = a * log_p - F.log(F.lit(float(z[i])))
        if budget is None:
            out.append(F.sum(-F.exp(log_w) * log_w).alias(f"v{i}"))
        else:
            out.append(F.max(F.exp(log_w) * budget / F.col("tokens")).alias(f"v{i}"))
    return [float(x) for x in sources.agg(*out).first()]


def find_exponent(
    sources: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None,
    budget: float | None = None,
) -> float:
    """The largest exponent k / 2^20 with entropy >= target (a share of the log of the number of
    sources) or with no source repeated more often than ``max_repeat`` under ``budget`` tokens.

    Entropy falls as the exponent grows.  The largest repetition grows as the exponent falls, so
    for a limit the *smallest* exponent is taken that respects it: the evenest mix allowed.
    If none does, 0 for an entropy, 1 for a limit.
    """
    n = sources.count()
    if n == 0:
        return 1.0
    import math

    goal = target_entropy * math.log(n) if target_entropy is not None else None

    def good(value: float) -> bool:
        return value >= goal - 1e-12 if goal is not None else value <= max_repeat + 1e-12

    lo, hi = 0, STEPS
    budget = None if goal is not None else float(budget)
    ends = _values(sources, [0.0, 1.0], budget)
    if goal is not None:  # good at lo, not at hi
        if good(ends[1]):
            return 1.0
    elif good(ends[0]):
        return 0.0
    while hi - lo > 1:
        step = max(1, -(-(hi - lo) // FAN))
        grid = list(range(lo + step, hi, step))
        values = _values(sources, [k / STEPS for k in grid], budget)
        met = [k for k, v in zip(grid, values) if good(v)]
        if goal is not None:
            lo = max(met, default=lo)
            hi = min([k for k in grid if k > lo], default=hi)
        else:
            hi = min(met, default=hi)
            lo = max([k for k in grid if k < hi], default=lo)
    return (lo if goal is not None else hi) / STEPS


def mix_sources(
    docs: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None,
    budget: float | None = None, keep_all: bool = False, blocks: int = 1024,
    tokens: Column | None = None, source_col: str = "source", id_col: str = "doc_id",
    seed: str = "mix",
) -> DataFrame:
    """All columns of ``docs``, once per copy taken, plus epoch, block and block_rank.

    Exactly one of ``target_entropy`` and ``max_repeat`` is given.  ``budget`` is the number of
    tokens of the mix (default: that of the input).  ``keep_all`` scales the weights so that the
    least repeated source is passed once in full, and ``max_repeat`` then limits the others:
    nothing is left out.  A null source is a source of its own.  A document's block is a hash of
    its id (null ids: of 'null'), so equal ids stay together; documents without tokens come in
    every epoch of their block.  ``block_rank`` is the block's place in the epoch's permutation:
    order by (epoch, block_rank) to realise the mix.  At most ``blocks`` rows per source and
    epoch describe the plan, which bounds every window; a hot source is spread over its blocks.
    An empty table gives an empty result; columns named epoch, block or block_rank are replaced.
    """
    if (target_entropy is None) == (max_repeat is None):
        raise ValueError("give either target_entropy or max_repeat")
    own = [c for c in docs.columns if c not in ("epoch", "block", "block_rank")]
    text_tokens = word_count(F.col("text")) if tokens is None else tokens
    source = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("null"))
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    block = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), name)), 1, 8), 16, 10) \
        .cast("long") % blocks
    marked = docs.select(*[F.col(f"`{c}`") for c in own], source.alias("__source"), block.alias("block"))
    sizes = store(
        docs.select(source.alias("source"), block.alias("block"), text_tokens.alias("tokens"))
        .groupBy("source", "block").agg(F.sum("tokens").alias("tokens")),
        "blocks",
    )
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    sources = store(
        sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
        .withColumn("total", F.lit(float(total))),
        "sources",
    )
    log_p = F.log(F.col("tokens") / F.col("total"))
    if keep_all:
        # Repetitions relative to the least repeated source: (p_max / p)^(1 - alpha).
        ratio = sources.agg(F.max("tokens") / F.min("tokens")).first()[0] or 1.0
        import math

        alpha = 1.0 if ratio <= 1 else max(0.0, 1 - math.log(max_repeat) / math.log(ratio))
        alpha = -(-alpha * STEPS // 1) / STEPS
        largest = sources.agg(F.max("tokens")).first()[0] or 1
        repeat = F.exp((alpha - 1) * (F.log(F.col("tokens").cast("double")) - F.log(F.lit(float(largest)))))
    else:
        spend = float(total if budget is None else budget)
        alpha = find_exponent(sources, target_entropy, max_repeat, spend)
        z = sources.agg(F.sum(F.exp(alpha * log_p))).first()[0] or 1.0
        repeat = F.exp(alpha * log_p) / z * spend / F.col("tokens")
    # Rounding to 9 digits keeps whole numbers of passes whole.
    quota = sources.select("source", F.round(repeat, 9).alias("repeat"),
                           F.col("tokens").alias("source_tokens"))
    epochs = sizes.join(quota, "source", "left").select(
        "source", "block", "tokens", F.coalesce("repeat", F.lit(1.0)).alias("repeat"),
        F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
    ).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil("repeat").cast("int")))) \
        .where("epoch < repeat")
    order = F.md5(F.concat_ws("|", F.lit(seed), "source", F.col("epoch").cast("string"),
                              F.col("block").cast("string")))
    in_epoch = Window.partitionBy("source", "epoch").orderBy("__order", "block")
    room = F.least(F.lit(1.0), F.col("repeat") - F.col("epoch")) * F.col("source_tokens")
    plan = epochs.withColumn("__order", order).select(
        F.col("source").alias("__source"), "block", "epoch", room.alias("__room"),
        F.row_number().over(in_epoch).alias("block_rank"),
        F.sum("tokens").over(in_epoch.rowsBetween(Window.unboundedPreceding, 0)).alias("__sum"),
    ).where(F.col("__sum") <= F.col("__room") + 1e-6).drop("__room", "__sum")
    return marked.join(plan, ["__source", "block"]).select(
        *[F.col(f"`{c}`") for c in own], "epoch", "block", "block_rank")
