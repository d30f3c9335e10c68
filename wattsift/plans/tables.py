"""Execution, score, power and prompt tables derived from the given parquet tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattsift.operators.enrich import with_metrics, with_throttled
from wattsift.operators.ordered import DAY, running, time_chunk
from wattsift.operators.power import SAMPLE_ORDER

F16, Q4 = "F16", "Q4_K_M"
PRECISIONS = [F16, Q4]


def props_k() -> Column:
    """The number in ``{"k": number}``."""
    return F.btrim(F.col("props"), F.lit('{"k: }')).cast("bigint")


def runs_of(events: DataFrame) -> DataFrame:
    """One model execution per event; works on a batch or a stream of events."""
    e = events.select("event_id", "user_id", "event_type", "ts", "value", props_k().alias("k"))
    event, k, value, slot = F.col("event_id"), F.col("k"), F.col("value"), F.col("user_id") % 5
    return e.select(
        event.alias("run_id"),
        F.expr("event_id div 2").alias("prompt_id"),
        F.expr("event_id div 18").alias("item_id"),
        F.when(event % 2 == 0, F16).otherwise(Q4).alias("precision"),
        slot.alias("platform"),
        F.when(F.col("user_id") % 2 == 0, "cache_on").otherwise("cache_off").alias("regime"),
        F.col("event_type").alias("category"),
        F.when(event % 3 == 0, F.concat(F.lit(" "), F.upper("event_type")))
        .otherwise(F.col("event_type"))
        .alias("category_raw"),
        F.col("user_id").alias("device"),
        F.col("ts").alias("started_at"),
        F.when(k == 0, 0.0).otherwise(value / 5.0).alias("latency_s"),
        (value * k / 10.0).alias("gross_energy_j"),
        (F.lit(2.1) + slot * 3.0).alias("idle_w"),
        F.when(event % 11 != 0, (1 + (event * 7 + k) % 10).cast("double")).alias("q_ped"),
        (k * 3).alias("generated_tokens"),
        F.least(k * 3, F.lit(200)).alias("output_tokens"),
        F.when(k % 10 != 0, 1800.0 + k * 8).alias("cpu_freq_mhz"),
    )


def _rater_kind(rater: Column) -> Column:
    return F.when(rater < 10, "human").otherwise("ai")


def _vote_order() -> Column:
    """Date, order, price, line and quantity as one number, in places wide enough for each (orders below 2 ** 40)."""
    when = F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint") * (1 << 40) + F.col("l_orderkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    parts = F.round(F.col("l_quantity") * 100).cast("bigint")
    within = cents * 10_000_000 + F.col("l_linenumber") * 100_000 + parts
    return (when.cast("decimal(18,0)") * F.expr("cast('10000000000000000000' AS decimal(20,0))") + within).cast("decimal(38,0)")


def metered(raw_runs: DataFrame) -> DataFrame:
    return raw_runs.transform(with_metrics).transform(with_throttled)


class Tables:
    """Views over one folder of the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def raw_runs(self) -> DataFrame:
        return runs_of(self.read("events"))

    def runs(self) -> DataFrame:
        return metered(self.raw_runs())

    def votes(self) -> DataFrame:
        """Every rating given, later ones replacing earlier ones of the same rater."""
        dims = F.array(*map(F.lit, ["CA", "CC", "SQ", "LA"]))
        rater = (F.col("l_suppkey") + F.col("l_partkey")) % 13
        return self.read("lineitem").select(
            F.expr("l_partkey div 4").alias("item_id"),
            F.when(F.col("l_orderkey") % 2 == 0, F16).otherwise(Q4).alias("precision"),
            rater.alias("rater_id"),
            _rater_kind(rater).alias("rater_kind"),
            F.element_at(dims, F.col("l_linenumber") % 4 + 1).alias("dim"),
            (1 + F.col("l_quantity").cast("bigint") % 10).alias("score"),
            _vote_order().alias("vote_order"),
        )

    def scores(self) -> DataFrame:
        """The last vote of each rater: a hash aggregate, as value and order have fixed widths."""
        last = self.votes().groupBy("item_id", "precision", "rater_id", "dim").agg(F.max_by("score", "vote_order").alias("score"))
        return last.select("item_id", "precision", "rater_id", "dim", _rater_kind(F.col("rater_id")).alias("rater_kind"), "score")

    def turns(self) -> DataFrame:
        talk = self.read("conversations")
        asked = talk.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
        answers = talk.filter(F.col("role") == "assistant").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
        )
        return asked.join(answers, ["conv_id", "turn"], "left")

    def samples(self) -> DataFrame:
        return self.read("events").select(
            F.col("user_id").alias("device"), F.col("event_id").alias("sample_id"), "ts", F.col("value").alias("watts")
        )

    def power(self) -> DataFrame:
        """Samples with a cumulative counter, kept in whole hundredths so it adds up exactly."""
        step = F.round(F.col("watts") * 100).cast("bigint")
        rows = running(self.samples(), ["device"], SAMPLE_ORDER, {"counted": step}, time_chunk("ts", DAY))
        return rows.withColumn("counter_kwh", F.col("counted") / F.lit(1e8)).drop("counted")

    def executions(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("run_id"),
            F.col("user_id").alias("device"),
            F.col("ts").alias("t0"),
            (F.col("ts") + F.expr("INTERVAL 12 HOUR")).alias("t1"),
        )

    def replies(self) -> DataFrame:
        """Good and bad judge replies."""
        kind, k = F.col("event_id") % 6, F.col("k")
        score = (1 + k % 10).cast("string")
        return self.read("events").select("event_id", props_k().alias("k")).select(
            F.col("event_id").alias("run_id"),
            F.when(kind == 0, F.concat(F.lit('{"score": '), score, F.lit(', "reason": "ok"}')))
            .when(kind == 1, F.concat(F.lit('{"score": '), score, F.lit("}")))
            .when(kind == 2, 'Sure! {"score": 8}')
            .when(kind == 3, '{"reason": "no score"}')
            .when(kind == 4, F.concat(F.lit('{"score": '), k.cast("string"), F.lit(', "reason": "range"} ')))
            .otherwise(F.concat(F.lit('{"CA": '), score, F.lit(', "CC": 7, "SQ": 6, "LA": 8}')))
            .alias("reply"),
        )

    def platforms(self) -> DataFrame:
        size = F.col("r_regionkey") + 1
        return self.read("region").select(
            F.col("r_regionkey").cast("bigint").alias("platform"),
            F.col("r_name").alias("platform_name"),
            (25.6 * size).alias("mem_bw_gbs"),
            (4.0 * size).alias("ram_gb"),
        )

    def models(self) -> DataFrame:
        label = F.when(F.col("p_partkey") % 2 == 0, F16).otherwise(Q4)
        return self.read("part").select(
            F.col("p_partkey").alias("model_id"),
            F.concat("p_name", F.lit(" "), label).alias("model_label"),
            (F.col("p_size") / 2.0).alias("ram_needed_gb"),
        )

    def prompts(self) -> DataFrame:
        return self.read("documents").select(
            F.col("doc_id").alias("prompt_id"),
            F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("corpus"),
            F.col("lang").alias("category"),
            F.col("text").alias("prompt"),
        )

    def corpus(self, name: str) -> DataFrame:
        return self.prompts().filter(F.col("corpus") == name).drop("corpus")
