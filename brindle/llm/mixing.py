"""Mixing sources to target weights by hierarchical budgeting.

Sources form a tree domain - language - source. A token budget is handed down
from the root. At each node the children share their parent's budget by their
weights; a child that can't use its share (its tokens times the allowed epochs)
is filled, and what it leaves goes to its siblings. As the capacity of an inner
node is the sum of its leaves', a shortage reaches the parent's siblings only
once all children are full. The division is a water level, found with window
functions over the children sorted by capacity per weight.

A leaf's budget is a prefix of its token stream: epoch 0 in an order seeded by
the epoch, then epoch 1, and so on. The document at the border is cut.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
#: Rows that one bucket of a leaf's order holds on average.
BUCKET_ROWS = 4_000
#: Bits of the order key.
KEY_BITS = 60


def default_domain(source: Column) -> Column:
    """Domain d0 to d3 by the number a source's name ends in; d0 without one."""
    return F.concat(F.lit("d"), F.coalesce(F.expr("try_cast(regexp_extract(_source, '([0-9]{1,9})$', 1) AS int)"), F.lit(0)) % 4)


def _share(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds `share`: the part of the row's `budget` (equal among siblings) that the child gets.

    Children are filled in the order of capacity per weight. At child i the
    level would be (budget - capacities before i) / (weights from i on); those
    whose ratio is at most the level are full, and the first that isn't sets
    the level for itself and all after it.
    """
    order = Window.partitionBy(*parent).orderBy("ratio", child)
    whole = Window.partitionBy(*parent)
    return (
        children.withColumn("ratio", F.col("capacity") / F.col("weight"))
        .withColumns({
            "n": F.row_number().over(order),
            "before": F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "rest": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        })
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("rest"))
        .withColumn("water", F.min_by(F.col("level"), F.when(F.col("ratio") > F.col("level"), F.col("n"))).over(whole))
        .withColumn("share", F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("capacity").cast("double")).otherwise(F.col("weight") * F.col("water")))
    )


def _weight(level: int, weights: Mapping[tuple[str, ...], float], alpha: float) -> Column:
    default = F.pow(F.col("tokens").cast("double"), F.lit(alpha))
    chosen = [F.when(F.struct(*LEVELS[: level + 1]) == F.struct(*map(F.lit, path)), F.lit(float(w))) for path, w in weights.items() if len(path) == level + 1]
    return F.coalesce(*chosen, default)


def leaf_budgets(leaves: DataFrame, budget_ratio: float, max_epochs: int, alpha: float, weights: Mapping[tuple[str, ...], float]) -> DataFrame:
    """From one row per leaf (domain, lang, source, tokens, docs): the same with `budget` in tokens.

    Leaves without tokens have no capacity and get a budget of 0.
    """
    leaves = leaves.filter("tokens > 0")
    total = leaves.agg(F.sum("tokens").alias("all_tokens"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("domain").agg(F.sum("tokens").alias("tokens"))

    def level(frame: DataFrame, k: int, above: DataFrame | None) -> DataFrame:
        frame = frame.withColumns({"weight": _weight(k, weights, alpha), "capacity": F.col("tokens") * max_epochs})
        if above is None:
            return _share(frame.crossJoin(F.broadcast(total)).withColumn("budget", F.least(F.floor(F.col("all_tokens") * budget_ratio).cast("double"), F.col("all_tokens").cast("double") * max_epochs)).withColumn("root", F.lit(0)), ["root"], LEVELS[k])
        up = above.select(*LEVELS[:k], F.col("share").alias("budget"))
        return _share(frame.join(up, list(LEVELS[:k])), list(LEVELS[:k]), LEVELS[k])

    done = level(leaves, 2, level(langs, 1, level(domains, 0, None)))
    return done.select(*LEVELS, "tokens", "docs", F.floor(F.col("share") + 1e-6).cast("long").alias("budget"))


def mix(
    docs: DataFrame,
    budget_ratio: float = 1.0,
    max_epochs: int = 4,
    alpha: float = 0.7,
    weights: Mapping[tuple[str, ...], float] | None = None,
    seed: int = 17,
    domain=default_domain,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The selected documents, one row for each epoch that a document is part of.

    Returns doc_id, domain, lang, source, epoch int, doc_tokens, used_tokens
    (less than doc_tokens only where a leaf's prefix ends inside a document)
    and the columns named in `keep`. Tokens are words. `weights` sets the
    weight of chosen nodes by path, (domain,), (domain, lang) or (domain, lang,
    source); other nodes weigh their tokens to the power `alpha`. The root's
    budget is `budget_ratio` times all tokens.

    A null language or source is the label '' of its own. Texts without words
    use no tokens: they come with each whole epoch of their leaf, and never
    with the last, partial one. Ties in the order (repeated rows) fall in any
    order, which gives equal rows. An empty table gives an empty result.
    """
    marked = (
        docs.withColumn("_source", F.coalesce(F.col("source").cast("string"), F.lit("")))
        .withColumns({
            "_domain": domain(F.col("_source")),
            "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
            "_tokens": F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"),
            "_text_md5": F.md5(F.coalesce(F.col("text"), F.lit(""))),
        })
    )
    rows = marked.select(F.col("doc_id"), F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("doc_tokens"), F.col("_text_md5").alias("text_md5"), *keep)
    leaves = rows.groupBy(*LEVELS).agg(F.sum("doc_tokens").alias("tokens"), F.count("*").alias("docs"))
    budgets = materialise(leaf_budgets(leaves, budget_ratio, max_epochs, alpha, weights or {}), "leaf-budgets")
    epochs = budgets.select(*LEVELS, "docs", F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("full"), (F.col("budget") % F.col("tokens")).alias("rest"))
    # a leaf's order is cut into buckets of about BUCKET_ROWS, so that no task sums up a whole leaf
    bits = F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.col("docs") / BUCKET_ROWS)).cast("int")))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_md5"))), 1, KEY_BITS // 4), 16, 10).cast("long")
    ordered = rows.join(epochs, list(LEVELS)).withColumn("key", key).withColumn("bucket", F.floor(F.col("key") / F.pow(F.lit(2.0), KEY_BITS - bits)).cast("long"))
    sums = ordered.groupBy(*LEVELS, "bucket").agg(F.sum("doc_tokens").alias("bucket_tokens"))
    before = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*LEVELS, "bucket", F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy(*LEVELS, "bucket").orderBy("key", "text_md5").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ordered.join(starts, [*LEVELS, "bucket"]).withColumn("start", F.col("bucket_start") + F.sum("doc_tokens").over(inside) - F.col("doc_tokens"))
    part = placed.withColumn("part", F.greatest(F.lit(0), F.least(F.col("doc_tokens"), F.col("rest") - F.col("start"))))
    parts = part.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full")))).withColumn("used_tokens", F.when(F.col("epoch") < F.col("full"), F.col("doc_tokens")).otherwise(F.col("part")))
    return parts.filter("epoch < full OR used_tokens > 0").select("doc_id", *LEVELS, "epoch", "doc_tokens", "used_tokens", *keep)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space before it unchanged."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^ \t-\r])(?=[ \t-\r])"), F.lit(1), n), "")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """`docs` mixed: selected rows with their columns, once for each epoch, texts cut to the used tokens."""
    packed = docs.select("doc_id", "text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    mixed = mix(packed, keep=("row",), **options)
    cut, row = F.col("used_tokens") < F.col("doc_tokens"), F.col("row")
    short = first_words(row["text"], F.col("used_tokens").cast("int"))
    shorter = row.withField("text", short)
    if "n_chars" in docs.columns:
        shorter = shorter.withField("n_chars", F.length(short).cast(docs.schema["n_chars"].dataType))
    return mixed.select(F.when(cut, shorter).otherwise(row).alias("row")).select("row.*")
