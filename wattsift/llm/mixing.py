"""Mixing sources to target weights by budgets that flow down a domain-language-source tree.

DataFrame functions only. A node's capacity is what its leaves can give in ``max_epochs`` epochs. The budget of a
node goes to its children by weight; a child that cannot take its part is filled up and the rest goes to its
siblings. As no node gets more than its leaves hold, a shortage leaves a subtree only when all of it is full.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattsift.llm.frames import NON_BLANK, without
from wattsift.session import written

SALTS = 16
LEVELS = ["domain", "lang", "source"]
#: An order key behind all others, which are hexadecimal digits.
WHOLE_EPOCH = "g"


def token_count(text: Column) -> Column:
    """Words between blanks; none in a NULL text."""
    return F.coalesce(F.regexp_count(text, F.lit(NON_BLANK)), F.lit(0)).cast("bigint")


def fill(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Add ``given``: each parent's ``budget`` dealt by ``weight`` among its children, none above its ``cap``.

    Children in order of cap / weight are full as long as everyone after them could reach that level too; the
    others share the rest by weight, cut to whole tokens. A child without a positive weight gets nothing.
    """
    order = Window.partitionBy(*parent).orderBy("level", child)
    before, all_of = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    zero = F.lit(0).cast("bigint")
    live = children.withColumn("weight", F.greatest(F.coalesce("weight", zero), zero)).withColumn(
        "room", F.when(F.col("weight") > 0, F.col("cap")).otherwise(zero)
    )
    live = live.withColumn("level", F.when(F.col("weight") > 0, F.col("room").cast("double") / F.col("weight")).otherwise(F.lit(0.0)))
    summed = (
        live.withColumn("filled_before", F.coalesce(F.sum("room").over(before), zero))
        .withColumn("weight_left", F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("is_full", F.col("filled_before") + F.col("level") * F.col("weight_left") <= F.col("budget"))
    )
    full = lambda c: F.sum(F.when(F.col("is_full"), F.col(c)).otherwise(zero)).over(all_of)
    share = (F.col("budget") - full("room")).cast("double") / (F.sum("weight").over(all_of) - full("weight")) * F.col("weight")
    given = F.when(F.col("is_full"), F.col("room")).otherwise(F.least(F.col("room"), F.floor(share)))
    return summed.withColumn("given", given.cast("bigint")).drop("room", "level", "filled_before", "weight_left", "is_full", "budget")


def leaf_budgets(leaves: DataFrame, weights: dict[str, Column], budget: int, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, given) for leaves (domain, lang, source, tokens): one row per source, no texts."""
    tree = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    top = tree.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", weights["domain"].cast("bigint"))
    top = fill(top.withColumn("budget", F.lit(budget).cast("bigint")), [], "domain")
    mid = tree.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    mid = mid.join(top.select("domain", F.col("given").alias("budget")), "domain").withColumn("weight", weights["lang"].cast("bigint"))
    mid = fill(mid, ["domain"], "lang")
    low = tree.join(mid.select("domain", "lang", F.col("given").alias("budget")), ["domain", "lang"])
    low = fill(low.withColumn("weight", weights["source"].cast("bigint")), ["domain", "lang"], "source")
    return low.select(*LEVELS, "tokens", "given")


def _seeded(seed: int, epoch: Column, id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id.cast("string"), F.lit(""))))


def _planned(rows: DataFrame, plan: DataFrame, id: str) -> DataFrame:
    """Join a leaf's plan to its rows on the leaf and a salt, so that a large leaf is many keys."""
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(id), F.lit(SALTS)).cast("int")).join(salted, [*LEVELS, "salt"], "left").drop("salt")


def leaf_plan(
    rows: DataFrame, weights: dict[str, Column], share: tuple[int, int], max_epochs: int, seed: int, bucket_rows: int
) -> DataFrame:
    """(domain, lang, source, full_epochs, cut): whole epochs of each leaf, and the last order key of the one begun.

    ``rows`` is (id, domain, lang, source, n_tokens). The prefix of the begun epoch is found in two steps: sums by leaf
    and leading digits of the order key, then the rows of the one digit group of each leaf where the budget ends.
    """
    leaves = written(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows")), "leaves")
    total, n_rows = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    given = leaf_budgets(leaves.drop("n_rows"), weights, total * share[0] // share[1], max_epochs)
    plan = written(
        given.withColumn("full_epochs", F.when(F.col("tokens") > 0, F.expr("given DIV tokens")).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("rest", F.col("given") - F.col("full_epochs") * F.col("tokens"))
        .drop("tokens", "given"),
        "plan",
    )
    digits = 1
    while n_rows > bucket_rows * 16**digits:
        digits += 1
    keyed = _planned(rows, plan, "id").withColumn("key", _seeded(seed, F.col("full_epochs"), F.col("id")))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, digits))
    sums = keyed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("tokens"))
    running = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    over = sums.withColumn("upto", running).where(F.col("upto") > F.col("rest"))
    ends = over.groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"))).alias("end"))
    ends = written(ends.select(*LEVELS, "end.bucket", "end.before"), "ends")
    inside = keyed.join(ends, [*LEVELS, "bucket"]).groupBy(*LEVELS, "before", "rest", "key").agg(F.sum("n_tokens").alias("tokens"))
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("key"))
    last = inside.withColumn("upto", upto).where(F.col("upto") <= F.col("rest")).groupBy(*LEVELS).agg(F.max("key").alias("last"))
    cuts = ends.join(last, LEVELS, "left").select(*LEVELS, F.coalesce("last", "bucket").alias("cut"))
    cut = F.when(F.col("full_epochs") >= max_epochs, F.lit("")).otherwise(F.coalesce("cut", F.lit(WHOLE_EPOCH)))
    return written(plan.join(cuts, LEVELS, "left").select(*LEVELS, "full_epochs", cut.alias("cut")), "cuts")


def mix(
    docs: DataFrame, domain: Column, weights: dict[str, Column], share: tuple[int, int] = (1, 1), max_epochs: int = 3,
    seed: int = 7, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", bucket_rows: int = 4096,
) -> DataFrame:
    """Each document with its leaf (mix_domain, mix_lang, mix_source) and ``copies``, how often the mix takes it.

    The budget is ``share`` (a fraction) of all tokens. Weights are whole numbers, given as columns of domain, lang and
    source. A leaf whose budget exceeds its tokens is read in several epochs; each epoch has an order of its own, by a
    hash of seed, epoch and id, and the last is cut at the budget: the longest run of documents in that order that
    fits. So a leaf never exceeds its budget, and whole-token rounding may leave some tokens undealt.

    NULL domain, language and source count as the empty name. A text without words has no tokens and goes with its
    place in the order. Rows that repeat an id go together. Columns named like the added ones are replaced.
    """
    base = without(docs, "mix_domain", "mix_lang", "mix_source", "copies")
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    leaf = [blank(domain).alias("domain"), blank(F.col(lang)).alias("lang"), blank(F.col(source)).alias("source")]
    rows = written(docs.select(F.col(id).alias("id"), *leaf, token_count(F.col(text)).alias("n_tokens")), "tokens")
    plan = leaf_plan(rows, weights, share, max_epochs, seed, bucket_rows)
    plan = plan.select(*[F.col(c).alias(f"mix_{c}") for c in LEVELS], "full_epochs", "cut")
    salted = plan.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = base.withColumns(dict(zip([f"mix_{c}" for c in LEVELS], [blank(domain), blank(F.col(lang)), blank(F.col(source))])))
    named = named.withColumn("mix_salt", F.pmod(F.xxhash64(id), F.lit(SALTS)).cast("int"))
    joined = named.join(salted, [*[f"mix_{c}" for c in LEVELS], "mix_salt"], "left")
    begun = (_seeded(seed, F.col("full_epochs"), F.col(id)) <= F.col("cut")).cast("bigint")
    return joined.withColumn("copies", F.col("full_epochs") + begun).select(*base.columns, *[f"mix_{c}" for c in LEVELS], "copies")


def taken(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    repeated = mixed.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return repeated.drop("copy", "copies", "mix_domain", "mix_lang", "mix_source")
