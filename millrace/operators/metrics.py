"""Labelled counters, gauges, histograms, summaries, heartbeats and activity sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import ordering

# Histogram bounds in seconds by kind of metric, and the age at which a worker counts as lost.
DEFAULT_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
PIPELINE_BOUNDS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0)
DATABASE_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
OFFLINE_SECONDS = 30

# The metric families of the platform as (name, kind, help, labels).
FAMILIES = (
    ("pipeline_count", "counter", "Total number of pipelines", ("pipeline_id", "status")),
    ("pipeline_running", "gauge", "Current number of running pipelines", ("pipeline_id",)),
    ("pipeline_completed", "counter", "Total number of completed pipelines", ("pipeline_id", "status")),
    ("pipeline_failed", "counter", "Total number of failed pipelines", ("pipeline_id", "error_type")),
    ("pipeline_duration_seconds", "histogram", "Pipeline execution duration in seconds", ("pipeline_id", "status")),
    ("function_execution_count", "counter", "Total number of function executions", ("function_name", "pipeline_id", "node_id")),
    ("function_success_rate", "gauge", "Function success rate", ("function_name", "pipeline_id")),
    ("function_failure_rate", "gauge", "Function failure rate", ("function_name", "pipeline_id")),
    ("function_avg_duration_seconds", "gauge", "Average function execution duration", ("function_name", "pipeline_id")),
    ("function_throughput", "counter", "Function throughput (items processed)", ("function_name", "pipeline_id", "node_id")),
    ("node_status", "gauge", "Node status (1=active, 0=inactive)", ("node_id", "pipeline_id")),
    ("node_tasks_running", "gauge", "Number of tasks running on node", ("node_id", "pipeline_id")),
    ("db_connections", "gauge", "Number of database connections", ("db_name", "state")),
    ("db_query_duration_seconds", "histogram", "Database query duration in seconds", ("db_name", "query_type")),
    ("db_query_total", "counter", "Total number of database queries", ("db_name", "query_type", "status")),
)


def exact_sum(value: Column) -> Column:
    """Sum that does not depend on the order of the rows."""
    return F.sum(value.cast("decimal(28,6)")).cast("double")


def counter(samples: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Added-up value and number of increments per label tuple."""
    return samples.groupBy("metric", *labels).agg(
        exact_sum(F.col("value")).alias("value"), F.count(F.lit(1)).alias("increments")
    )


def gauge(samples: DataFrame, labels: Sequence[str], order_by: Sequence[str], slice_by: Column) -> DataFrame:
    """Current value per label tuple: the last set value plus the steps after it.

    ``samples`` has ``op`` (``set``, ``inc`` or ``dec``) and ``value``; ``slice_by`` grows with the order.
    One pass finds the last set and the sum of the steps of every slice; of a label tuple only slices meet in a task.
    A second pass looks at the rows of the last set's slice.
    """
    keys = ["metric", *labels]
    is_set = F.col("op") == "set"
    placed = samples.withColumns({"__at": F.struct(*order_by), "__slice": slice_by})
    step = F.when(F.col("op") == "dec", -F.col("value")).otherwise(F.col("value")).cast("decimal(28,6)")
    slices = placed.groupBy(*keys, "__slice").agg(
        F.max(F.when(is_set, F.struct("__at", "value"))).alias("__set"), F.sum(F.when(~is_set, step)).alias("__step")
    )
    set_in = F.when(F.col("__set").isNotNull(), F.struct(F.col("__slice").alias("slice"), "__set"))
    last = F.max(set_in).over(Window.partitionBy(*keys))
    later = F.col("__last").isNull() | (F.col("__slice") > F.col("__last.slice"))
    totals = (
        slices.withColumn("__last", last)
        .groupBy(*keys)
        .agg(F.max("__last").alias("__last"), F.sum(F.when(later, F.col("__step"))).alias("__later"))
    )
    at_last = totals.where("__last IS NOT NULL").select(
        *keys, F.col("__last.slice").alias("__slice"), F.col("__last.__set.__at").alias("__set_at")
    )
    steps = placed.where(~is_set).select(*keys, "__at", "__slice", step.alias("__step"))
    same = steps.join(at_last, [*keys, "__slice"]).where(F.col("__at") > F.col("__set_at"))
    within = same.groupBy(*keys).agg(F.sum("__step").alias("__same"))
    nothing = F.lit(0).cast("decimal(38,6)")
    moved = (F.coalesce(F.col("__later"), nothing) + F.coalesce(F.col("__same"), nothing)).cast("double")
    value = F.coalesce(F.col("__last.__set.value"), F.lit(0.0)) + moved
    return totals.join(within, keys, "left").select(*keys, value.alias("value"))


def histogram(samples: DataFrame, labels: Sequence[str], bounds: Sequence[float] = DEFAULT_BOUNDS) -> DataFrame:
    """Count, sum and cumulative bucket counts per label tuple, one row per bound."""
    buckets = [F.count_if(F.col("value") <= b).alias(f"__b{i}") for i, b in enumerate(bounds)]
    totals = samples.groupBy("metric", *labels).agg(
        F.count(F.lit(1)).alias("n"), exact_sum(F.col("value")).alias("total"), *buckets
    )
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"__b{i}").alias("bucket")) for i, b in enumerate(bounds)])
    return totals.select("metric", *labels, "n", "total", F.explode(rows).alias("__row")).select(
        "metric", *labels, "n", "total", "__row.*"
    )


def sketched(samples: DataFrame, labels: Sequence[str], width: str, k: int = 1024) -> DataFrame:
    """One KLL sketch per label tuple and window: ``metric``, labels, ``window_start``, ``sketch``.

    Sketches of a few kilobytes are merged in the map tasks, so a hot label costs no more than another. Ranks are
    within about 2.3 / k^0.9 of the true ones. Null values are left out.
    """
    window = F.window(F.col("timestamp"), width)["start"].alias("window_start")
    return samples.where(F.col("value").isNotNull()).groupBy("metric", *labels, window).agg(F.kll_sketch_agg_double(F.col("value").cast("double"), F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: Sequence[Column | str], quantiles: Sequence[float]) -> DataFrame:
    """Quantiles of ``keys`` from their sketches alone: keys, ``n``, ``quantile``, ``value``."""
    whole = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    names = [c for c in whole.columns if c != "sketch"]
    ranks = F.array(*[F.lit(float(q)) for q in quantiles])
    pairs = F.arrays_zip(ranks.alias("quantile"), F.kll_sketch_get_quantile_double("sketch", ranks).alias("value"))
    return whole.select(*names, F.kll_sketch_get_n_double("sketch").alias("n"), F.inline(pairs).alias("quantile", "value"))


def summary(samples: DataFrame, labels: Sequence[str], quantiles: Sequence[float], slice_width: float = 1.0) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per label tuple and quantile.

    Equal values are counted together first. Counts per slice of values tell in which slices the wanted
    ranks lie; only these slices are sorted, each by itself.
    """
    keys = ["metric", *labels]
    counts = samples.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    rows = ordering.sliced(counts, keys, F.floor(F.col("value") / F.lit(slice_width)))
    sizes = rows.groupBy(ordering.KEY, *keys).agg(F.sum("n").alias("size"))
    upto = F.sum("size").over(ordering.across(keys).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("size").over(ordering.across(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    slices = sizes.withColumns({"upto": upto, "total": total})

    exact = (F.col("total") - 1) * F.col("quantile")
    ends = F.array(F.floor("exact"), F.ceil("exact"))
    wanted = (
        slices.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
        .withColumn("exact", exact)
        .withColumn("rank", F.explode(F.array_distinct(ends)))
        .where((F.col("upto") - F.col("size") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
        .select(ordering.KEY, "quantile", "exact", "rank", (F.col("rank") - F.col("upto") + F.col("size")).alias("offset"))
    )
    so_far = ordering.within([F.col("value")]).rowsBetween(Window.unboundedPreceding, 0)
    needed = rows.join(wanted.select(ordering.KEY).distinct(), ordering.KEY, "left_semi")
    placed = needed.withColumn("reached", F.sum("n").over(so_far))
    hits = placed.join(wanted, ordering.KEY).where(
        (F.col("reached") - F.col("n") <= F.col("offset")) & (F.col("offset") < F.col("reached"))
    )
    picked = hits.groupBy(*keys, "quantile", "exact").agg(
        F.min_by("value", "rank").alias("low"), F.max_by("value", "rank").alias("high")
    )
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("exact") - F.floor("exact"))
    return picked.select(*keys, "quantile", value.alias("value"))


def summary_approx(samples: DataFrame, labels: Sequence[str], quantiles: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Approximate quantiles from mergeable sketches: one pass and a small shuffle."""
    wanted = [float(q) for q in quantiles]
    return samples.groupBy("metric", *labels).agg(F.percentile_approx("value", wanted, accuracy).alias("values"))


def summary_accuracy(
    samples: DataFrame, labels: Sequence[str], quantiles: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """Approximate quantiles with their exact ranks, one row per label tuple and quantile.

    ``within`` tells whether the ranks of the value, from ``below`` to ``upto`` of ``n``, come as near to the
    wanted rank as ``accuracy`` promises: within ``n / accuracy``, and one for rounding.
    """
    keys = ["metric", *labels]
    met = samples.select(*keys, "value").join(summary_approx(samples, labels, quantiles, accuracy), keys)
    counts = []
    for i in range(len(quantiles)):
        picked = F.get("values", F.lit(i))
        counts += [
            F.first(picked).alias(f"__value{i}"),
            F.count_if(F.col("value") < picked).alias(f"__below{i}"),
            F.count_if(F.col("value") <= picked).alias(f"__upto{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(float(q)).alias("quantile"),
                F.col(f"__value{i}").alias("value"),
                F.col(f"__below{i}").alias("below"),
                F.col(f"__upto{i}").alias("upto"),
            )
            for i, q in enumerate(quantiles)
        ]
    )
    placed = met.groupBy(*keys).agg(F.count("value").alias("n"), *counts).select(*keys, "n", F.explode(rows).alias("__row"))
    rank, slack = F.col("quantile") * F.col("n"), F.col("n") / F.lit(accuracy) + 1
    within = (F.col("below") - slack <= rank) & (rank <= F.col("upto") + slack)
    return placed.select(*keys, "n", "__row.*").withColumn("within", within)


def function_totals(tasks: DataFrame, executions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tasks, outcomes, time and items added up per function, pipeline and the columns ``by`` of the tasks."""
    pipelines = executions.select(F.col("id").alias("execution_id"), "pipeline_id")
    joined = tasks.select("execution_id", "function_id", *by, "status", "start_time", "end_time", "items").join(
        pipelines, "execution_id"
    )
    micros = F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))
    return joined.groupBy("function_id", "pipeline_id", *by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(micros).alias("micros"),
        F.count(micros).alias("timed"),
        F.sum("items").alias("items"),
    )


def function_rates(
    tasks: DataFrame, executions: DataFrame, functions: DataFrame, per_node: bool = False
) -> DataFrame:
    """Executions, success and failure rate, mean duration and items per function type and pipeline.

    With ``per_node`` per node as well. Tasks are added up per function before they meet the functions, so a
    function that most tasks use brings few rows to its type.
    """
    node = ["node_id"] if per_node else []
    counted = function_totals(tasks, executions, node)
    typed = counted.join(functions.select(F.col("id").alias("function_id"), "type"), "function_id")
    return typed.groupBy("type", "pipeline_id", *node).agg(
        F.sum("n").alias("executions"),
        (F.sum("completed") / F.sum("n")).alias("success_rate"),
        (F.sum("failed") / F.sum("n")).alias("failure_rate"),
        (F.sum("micros") / F.sum("timed") / F.lit(1_000_000)).alias("mean_seconds"),
        F.sum("items").alias("throughput"),
    )


def function_families(tasks: DataFrame, executions: DataFrame, functions: DataFrame) -> DataFrame:
    """Samples of the function families ``(metric, function_name, pipeline_id, node_id, value)``.

    Counters are per node; the three rates are per pipeline and have a null node. Without a finished task there is no
    mean duration and no sample of it. Tasks are read and shuffled once, the rates come from the nodes' totals.
    """
    sums = ("n", "completed", "failed", "micros", "timed", "items")
    named = function_totals(tasks, executions, ["node_id"]).join(
        functions.select(F.col("id").alias("function_id"), F.col("name").alias("function_name")), "function_id"
    )
    nodes = named.groupBy("function_name", "pipeline_id", "node_id").agg(*[F.sum(c).alias(c) for c in sums])

    def samples(totals: DataFrame, node: Column, values: dict[str, Column]) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()])
        exploded = totals.select("function_name", "pipeline_id", node.alias("node_id"), F.explode(rows).alias("__row"))
        return exploded.select("__row.metric", "function_name", "pipeline_id", "node_id", "__row.value").where("value IS NOT NULL")

    counters = samples(
        nodes, F.col("node_id"), {"function_execution_count": F.col("n"), "function_throughput": F.col("items")}
    )
    pipelines = nodes.groupBy("function_name", "pipeline_id").agg(*[F.sum(c).alias(c) for c in sums])
    rates = {
        "function_success_rate": F.col("completed") / F.col("n"),
        "function_failure_rate": F.col("failed") / F.col("n"),
        "function_avg_duration_seconds": F.try_divide("micros", "timed") / F.lit(1_000_000),
    }
    return counters.unionByName(samples(pipelines, F.lit(None).cast(nodes.schema["node_id"].dataType), rates))


def node_families(tasks: DataFrame, executions: DataFrame) -> DataFrame:
    """Samples of the node families ``(metric, node_id, pipeline_id, value)``: running tasks, and 1 for a node that has any."""
    pipelines = executions.select(F.col("id").alias("execution_id"), "pipeline_id")
    running = tasks.select("execution_id", "node_id", "status").join(pipelines, "execution_id").groupBy("node_id", "pipeline_id").agg(
        F.count_if(F.col("status") == "running").cast("double").alias("running")
    )
    status = F.when(F.col("running") > 0, 1.0).otherwise(0.0)
    rows = F.array(
        F.struct(F.lit("node_tasks_running").alias("metric"), F.col("running").alias("value")),
        F.struct(F.lit("node_status").alias("metric"), status.alias("value")),
    )
    return running.select("node_id", "pipeline_id", F.explode(rows).alias("__row")).select("__row.metric", "node_id", "pipeline_id", "__row.value")


def pipeline_families(executions: DataFrame) -> DataFrame:
    """Samples of the pipeline families ``(metric, pipeline_id, status, value)`` from executions, one shuffle."""
    counts = executions.groupBy("pipeline_id", "status").agg(F.count(F.lit(1)).cast("double").alias("value"))

    def family(name: str, wanted: Column) -> Column:
        return F.when(wanted, F.lit(name))

    status = F.col("status")
    names = F.array(
        F.lit("pipeline_count"),
        family("pipeline_running", status == "running"),
        family("pipeline_completed", status == "completed"),
        family("pipeline_failed", status == "failed"),
    )
    return counts.select(F.explode(names).alias("metric"), "pipeline_id", "status", "value").where(
        F.col("metric").isNotNull()
    )


def windowed(samples: DataFrame, labels: Sequence[str], width: str, slide: str | None = None) -> DataFrame:
    """Count and sum per time window and label tuple; with ``slide`` the windows overlap."""
    window = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    return (
        samples.groupBy(window.alias("w"), "metric", *labels)
        .agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col("value")).alias("total"), F.max("value").alias("peak"))
        .select(F.col("w.start").alias("window_start"), "metric", *labels, "n", "total", "peak")
    )


def latest_beats(beats: DataFrame) -> DataFrame:
    """Last heartbeat of every worker."""
    columns = ["worker_id", "timestamp", "beat_id", "status", "tasks_running"]
    return ordering.latest(beats.select(*columns), ["worker_id"], ["timestamp", "beat_id"])


def liveness(beats: DataFrame, as_of: str, offline_seconds: float = OFFLINE_SECONDS) -> DataFrame:
    """1 for a live worker, 0 for one that is silent too long or said it is inactive or lost."""
    now = F.lit(as_of).cast("timestamp")
    age = (F.unix_micros(now) - F.unix_micros(F.col("timestamp").cast("timestamp"))) / F.lit(1_000_000)
    alive = F.when((age > offline_seconds) | F.col("status").isin("inactive", "lost"), 0).otherwise(1)
    return latest_beats(beats).select("worker_id", alive.alias("alive"), "tasks_running", age.alias("age_seconds"))


def available(beats: DataFrame, online: str = "online", load_limit: int = 100) -> DataFrame:
    """Workers that are online and not fully loaded."""
    return latest_beats(beats).where((F.col("status") == online) & (F.col("tasks_running") < load_limit))


def activity_slots(beats: DataFrame, gap_seconds: int = OFFLINE_SECONDS) -> DataFrame:
    """First and last beat and number of beats per worker and slot of the gap's length.

    Beats of one slot always belong together, so counting them per slot loses nothing. Runs on tables and,
    with a watermark on ``timestamp``, on streams.
    """
    slot = F.window("timestamp", f"{gap_seconds} seconds")
    return (
        beats.groupBy("worker_id", slot.alias("w"))
        .agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("beats"))
        .select("worker_id", F.col("w.start").alias("slot"), "first", "last", "beats")
    )


def join_slots(slots: DataFrame, gap_seconds: int = OFFLINE_SECONDS) -> DataFrame:
    """Sessions from slots. What a worker brings here is bounded by time, not by its number of beats."""
    first, last = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("first", "last"))
    by_time = Window.partitionBy("worker_id").orderBy("slot")
    opens = F.coalesce(first - F.lag(last).over(by_time) > gap_seconds * 1_000_000, F.lit(True))
    marked = slots.withColumn("opens", opens.cast("int"))
    numbered = marked.withColumn("session", F.sum("opens").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("worker_id", "session").agg(
        F.min("first").alias("session_start"), F.max("last").alias("session_end"), F.sum("beats").alias("beats")
    )


def activity_sessions(beats: DataFrame, gap_seconds: int = OFFLINE_SECONDS) -> DataFrame:
    """Stretches of heartbeats per worker without a silence longer than the gap."""
    return join_slots(activity_slots(beats, gap_seconds), gap_seconds)


def metric_help(metric: Column, default: str) -> Column:
    """Help text of a known family, otherwise the default."""
    pairs = [F.lit(x) for name, _, text, _ in FAMILIES for x in (name, text)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), metric), F.lit(default))


def escaped(value: Column) -> Column:
    """Label value as it stands between quotes: backslash, quote and line feed escaped; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def exposition(
    labels: Sequence[str],
    help_text: str,
    counters: DataFrame | None = None,
    gauges: DataFrame | None = None,
    histograms: DataFrame | None = None,
) -> DataFrame:
    """Metrics as sorted text lines: help, type and one line per sample, with all ``labels``.

    ``help_text`` describes metrics outside the known families. Columns ``metric, ord, line``: lines of one
    label tuple stand together in ``ord`` order. Every frame is read once: its rows give the headings too,
    of which one is kept.
    """
    metric = F.col("metric")
    key = F.concat(F.lit("2/"), F.concat_ws("/", *[escaped(F.col(c)) for c in labels]))
    tags = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), escaped(F.col(c)), F.lit('"')) for c in labels])

    def line(order: Column, text: Column) -> Column:
        return F.struct(order.alias("ord"), text.alias("line"))

    def sample(suffix: str, inside: Column, number: Column) -> Column:
        return F.concat(metric, F.lit(f"{suffix}{{"), inside, F.lit("} "), number)

    def written(df: DataFrame, kind: str, *samples: Column) -> DataFrame:
        heading = [
            line(F.lit("0"), F.concat(F.lit("# HELP "), metric, F.lit(" "), metric_help(metric, help_text))),
            line(F.lit("1"), F.concat(F.lit("# TYPE "), metric, F.lit(f" {kind}"))),
        ]
        rows = F.explode(F.array(*heading, *samples))
        return df.select("metric", rows.alias("__row")).select("metric", "__row.*").distinct()

    value = line(key, sample("", tags, F.format_string("%f", "value")))
    bound = F.format_string("%f", "le")
    bucket = sample("_bucket", F.concat(tags, F.lit(',le="'), bound, F.lit('"')), F.col("bucket").cast("string"))
    parts = []
    if counters is not None:
        parts.append(written(counters, "counter", value))
    if gauges is not None:
        parts.append(written(gauges, "gauge", value))
    if histograms is not None:
        sums = line(F.concat(key, F.lit("/sum")), sample("_sum", tags, F.format_string("%f", "total")))
        counts = line(F.concat(key, F.lit("/count")), sample("_count", tags, F.col("n").cast("string")))
        buckets = line(F.concat(key, F.lit("/bucket/"), F.lpad(bound, 20, "0")), bucket)
        parts.append(written(histograms, "histogram", sums, counts, buckets))
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines.orderBy("metric", "ord")
