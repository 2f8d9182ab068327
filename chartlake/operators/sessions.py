"""Consultation logs: sessions, uploads, spend, admission and message history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartlake.operators.scan import running
from chartlake.sources.staging import staged

USD_IN, USD_OUT = 3.0, 15.0
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
#: Numbers kept per sketch level, and the rank error it gives (normalised, one-sided).
SKETCH_K, SKETCH_ERROR = 2000, 0.002


def _ordered(*by: str, ts: str = "ts"):
    return Window.partitionBy(*by).orderBy(ts)


def sessionize(events: DataFrame, ttl: str = "1 hour", key: str = "user_id") -> DataFrame:
    """session_no per key: a new session after an idle time strictly longer than the ttl."""
    w = _ordered(key)
    gap = F.col("ts") > F.lag("ts").over(w) + F.expr(f"interval {ttl}")
    return events.withColumn("_new", F.coalesce(gap.cast("int"), F.lit(1))).withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def session_table(events: DataFrame, ttl: str = "1 hour", key: str = "user_id") -> DataFrame:
    return sessionize(events, ttl, key).groupBy(key, "session_no").agg(F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count("*").alias("n_events"))


def live_sessions(sessions: DataFrame, ttl: str = "1 hour", ceiling: int = 200) -> DataFrame:
    """Sessions alive when each one starts, and whether the ceiling is passed: a sweep over starts and ends."""
    ends = F.col("last_seen") + F.expr(f"interval {ttl}")
    # an end at the very time of a start comes after it: a session lives through its last second
    ev = sessions.select("user_id", "session_no", F.col("started").alias("ts"), F.lit(1).alias("d")).union(sessions.select("user_id", "session_no", ends.alias("ts"), F.lit(-1).alias("d")))
    swept = running(ev, {"live": "d"}, ["ts", F.desc("d"), "user_id", "session_no"])
    return swept.where("d = 1").select("user_id", "session_no", F.col("ts").alias("started"), "live", (F.col("live") > ceiling).alias("over_ceiling"))


def rollover(uploads: DataFrame, most: int = 2, adopt: bool = True) -> DataFrame:
    """consultation and notice per upload of a session: upload most + 1 opens a new consultation, later ones in it carry a notice.

    Without adopt (a client that keeps the full id) every further upload opens its own consultation.
    """
    n = F.row_number().over(_ordered("user_id", "session_no")) - 1
    u = uploads.withColumn("n", n)
    number = F.floor(F.col("n") / most) if adopt else F.greatest(F.col("n") - most + 1, F.lit(0))
    place = F.col("n") % most if adopt else F.when(F.col("n") < most, F.col("n")).otherwise(0)
    return u.select("user_id", "session_no", "ts", number.cast("long").alias("consultation"), (place > 0).alias("notice"))


def ground_turns(turns: DataFrame, analyses: DataFrame, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Every turn with the latest analysis at or before it (an as-of join by one sorted pass)."""
    both = turns.select(*keys, "ts", "event_id", F.lit(None).cast("long").alias("a"), F.lit(1).alias("k")).union(analyses.select(*keys, "ts", F.lit(None).cast("long"), F.col("analysis_id").cast("long"), F.lit(0)))
    w = Window.partitionBy(*keys).orderBy("ts", "k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("analysis_id", F.last("a", ignorenulls=True).over(w)).where("k = 1").select(*keys, "event_id", "ts", "analysis_id", F.col("analysis_id").isNotNull().alias("grounded"))


def spend_totals(turns: DataFrame, key: str = "user_id") -> DataFrame:
    """Tokens and turns per key and overall (key null); a failed turn adds tokens but no turn."""
    return turns.rollup(key).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count_if(~F.col("failed")).alias("turns"))


def estimated_usd(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1e6 * USD_IN + tokens_out / 1e6 * USD_OUT


def budget_admission(turns: DataFrame, session_cap: int, process_cap: int, max_turns: int, key: str = "user_id") -> DataFrame:
    """reason per turn: process, turns, tokens or null (admitted).

    turns: key, ts, event_id, tokens, failed. Session caps look at the sums before a turn in its session; the process cap at the sum before it
    over all turns that sessions admit. Both are running sums over range partitions, so neither a busy session nor a busy day is one task.
    """
    order = ["ts", "event_id"]
    t = running(turns.select(key, *order, "tokens", "failed"), {"prior_tokens": "tokens", "prior_turns": (~F.col("failed")).cast("int")}, order, (key,), inclusive=False)
    own = F.when(F.col("prior_turns") >= max_turns, "turns").when(F.col("prior_tokens") >= session_cap, "tokens")
    t = t.withColumn("own", own).withColumn("spent", F.when(F.col("own").isNull(), F.col("tokens")).otherwise(0))
    t = running(t, {"run": "spent"}, order, inclusive=False)
    return t.select(key, "event_id", F.when(F.col("run") >= process_cap, "process").otherwise(F.col("own")).alias("reason"))


def usage_report(calls: DataFrame, by: list[str], window: str = "1 hour") -> DataFrame:
    """Calls, tokens, cache-read share and latency per group and tumbling window."""
    agg = calls.groupBy(F.window("ts", window).alias("w"), *by).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cache_read").alias("cache_read"), F.max("took").alias("max_took"))
    share = F.when(F.col("tokens_in") + F.col("cache_read") > 0, F.col("cache_read") / (F.col("tokens_in") + F.col("cache_read"))).otherwise(0.0)
    return agg.select(F.col("w.start").alias("window_start"), *by, "calls", "tokens_in", "tokens_out", F.round(share, 6).alias("cache_share"), "max_took")


def latency_sketches(calls: DataFrame, by: list[str], window: str = "1 hour", k: int = SKETCH_K) -> DataFrame:
    """Calls and a mergeable quantile sketch of their latency per group and tumbling window; windows without a latency have none.

    Aggregated before the shuffle: what moves is a sketch of some 3 * k numbers at most per task, group and window. Null latencies count
    as calls only.
    """
    agg = calls.groupBy(F.window("ts", window).alias("w"), *by).agg(F.count("*").alias("calls"), F.kll_sketch_agg_double(F.col("took").cast("double"), F.lit(k)).alias("sketch"))
    return agg.select(F.col("w.start").alias("window_start"), *by, "calls", "sketch")


def latency_rollup(sketches: DataFrame, by: list[str], k: int = SKETCH_K) -> DataFrame:
    """Sketches of windows merged into one per group; calls are added up."""
    return sketches.groupBy(*by).agg(F.sum("calls").alias("calls"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def latency_quantiles(sketches: DataFrame) -> DataFrame:
    """The sketch replaced by p50, p95 and p99: the least latency that so many of all are at or below.

    Exact while a sketch has met at most k latencies; beyond, the rank of the answer is off by at most SKETCH_ERROR with 99 % confidence.
    Null for a group without a latency.
    """
    known = F.kll_sketch_get_n_double("sketch") > 0
    return sketches.withColumns({name: F.when(known, F.kll_sketch_get_quantile_double("sketch", F.lit(q))) for name, q in QUANTILES.items()}).drop("sketch")


def latency_counts(calls: DataFrame, by: list[str], window: str = "1 hour") -> DataFrame:
    """Calls per latency, group and tumbling window: what exact quantiles need, and mergeable as sketches are, but a row per different latency."""
    return calls.groupBy(F.window("ts", window).alias("w"), *by, F.col("took").cast("double").alias("took")).agg(F.count("*").alias("calls")).select(F.col("w.start").alias("window_start"), *by, "took", "calls")


def exact_quantiles(counts: DataFrame, by: list[str]) -> DataFrame:
    """Calls, p50, p95 and p99 per group of counted latencies (by, took, calls): the least latency that so many of all are at or below.

    The counts are added up over range partitions, so no task holds a group. Null for a group without a latency.
    """
    per = counts.groupBy(*by, "took").agg(F.sum("calls").alias("calls"))
    run = running(per.withColumn("known", F.when(F.col("took").isNotNull(), F.col("calls")).otherwise(0)), {"upto": "known"}, ["took"], tuple(by))
    run = staged(run, "latencies")
    totals = run.groupBy(*by).agg(F.sum("calls").alias("all_calls"), F.sum("known").alias("all_known")).select(*[F.col(c).alias(f"_{c}") for c in by], "all_calls", "all_known")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    rank = lambda q: F.ceil(F.round(F.lit(q) * F.col("all_known"), 7))
    least = {n: F.min(F.when((F.col("known") > 0) & (F.col("upto") >= rank(q)), F.col("took"))).alias(n) for n, q in QUANTILES.items()}
    return run.join(totals, same).groupBy(*by).agg(F.first("all_calls").alias("calls"), *least.values())


def prune_tool_results(messages: DataFrame, keep: int = 1, stub: str = "[pruned]") -> DataFrame:
    """Texts of all but the newest `keep` tool results of a conversation are blanked; ids stay."""
    w = Window.partitionBy("conv_id", "is_result").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(w)).withColumn("text", F.when(F.col("is_result") & (F.col("_n") > keep), stub).otherwise(F.col("text"))).drop("_n")


def history_cost(messages: DataFrame) -> DataFrame:
    """Tokens sent again up to every turn, and their sum over the conversation (columns conv_id, turn, tokens)."""
    w = _ordered("conv_id", ts="turn").rowsBetween(Window.unboundedPreceding, 0)
    run = messages.withColumn("sent", F.sum("tokens").over(w))
    return run.groupBy("conv_id").agg(F.sum("sent").alias("total_sent"), F.max("sent").alias("last_sent"))


def history_by_turn(messages: DataFrame, keep: int = 1, stub_tokens: int = 2) -> DataFrame:
    """Tokens of the history that a turn sends, whole and with pruned tool results (conv_id, turn, full_sent, pruned_sent).

    messages: conv_id, turn, tokens, is_result; the rows of one turn are one message, null tokens count 0. A message is sent from its turn to
    the last one: at full size, or, once ``keep`` later messages with tool results are there, with a stub in place of each of its results. Each is
    thus two steps of a difference array over turns, and what a turn sends is their running sum, over range partitions: no task holds a
    conversation. With keep 0 a result is a stub from its own turn on.
    """
    n = F.coalesce("tokens", F.lit(0))
    result = F.coalesce("is_result", F.lit(False))
    per = messages.groupBy("conv_id", "turn").agg(F.sum(n).alias("tokens"), F.sum(F.when(result, stub_tokens - n).otherwise(0)).alias("cut"), F.max(result.cast("int")).alias("has"))
    per = running(per, {"no": "has"}, ["turn"], ("conv_id",))
    stubs = per.where("has = 1")
    later = stubs.select(F.col("conv_id").alias("_c"), F.col("no").alias("_n"), F.col("turn").alias("_t"))
    steps = stubs.join(later, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("no") + keep == F.col("_n"))).select("conv_id", F.col("_t").alias("turn"), F.lit(0).alias("tokens"), "cut")
    both = per.select("conv_id", "turn", "tokens", F.lit(0).alias("cut")).unionAll(steps).groupBy("conv_id", "turn").agg(F.sum("tokens").alias("tokens"), F.sum("cut").alias("cut"))
    out = running(both, {"full_sent": "tokens", "saved": "cut"}, ["turn"], ("conv_id",))
    return out.select("conv_id", "turn", "full_sent", (F.col("full_sent") + F.col("saved")).alias("pruned_sent"))


def history_totals(by_turn: DataFrame) -> DataFrame:
    """What a conversation sends in all its turns, whole and pruned."""
    return by_turn.groupBy("conv_id").agg(F.sum("full_sent").alias("full_sent"), F.sum("pruned_sent").alias("pruned_sent"))


def tool_pairing(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Tool uses without exactly one result in the next message, and results without a use (conv_id, tool_id, turn)."""
    r = results.groupBy("conv_id", "tool_id").agg(F.count("*").alias("n"), F.min("turn").alias("result_turn"))
    j = uses.select("conv_id", "tool_id", F.col("turn").alias("use_turn")).join(r, ["conv_id", "tool_id"], "full")
    problem = F.when(F.col("n").isNull(), "no_result").when(F.col("use_turn").isNull(), "no_use").when(F.col("n") > 1, "several").when(F.col("result_turn") != F.col("use_turn") + 1, "late")
    return j.withColumn("problem", problem).where("problem is not null").select("conv_id", "tool_id", "problem")


def tool_usage(calls: DataFrame) -> DataFrame:
    """Calls, mean result count and share of empty results per tool."""
    return calls.groupBy("tool").agg(F.count("*").alias("calls"), F.round(F.avg("result_count"), 6).alias("mean_results"), F.round(F.count_if(F.col("result_count") == 0) / F.count("*"), 6).alias("zero_rate"))


def grounded_by_tool(answers: DataFrame, calls: DataFrame, keys: tuple[str, ...] = ("conv_id", "exchange")) -> DataFrame:
    """Per tool the exchanges with an answer and a call of that tool, and those in which such a call returned something.

    answers: keys; calls: keys, tool, result_count. An exchange counts once, however many answers or calls it has; calls without an
    answer do not count. Null keys meet nothing.
    """
    per = calls.groupBy(*keys, "tool").agg(F.max(F.coalesce("result_count", F.lit(0))).alias("most"))
    return per.join(answers.select(*keys), list(keys), "left_semi").groupBy("tool").agg(F.count("*").alias("answered"), F.count_if(F.col("most") > 0).alias("grounded"))


def unconverged_turns(responses: DataFrame, rounds: int = 2) -> DataFrame:
    """Turns whose last allowed response still asks for a tool (conv_id, exchange, round, stop_reason)."""
    last = responses.where(F.col("round") <= rounds).groupBy("conv_id", "exchange").agg(F.max_by("stop_reason", "round").alias("stop_reason"), F.max("round").alias("n_rounds"))
    return last.where((F.col("stop_reason") == "tool_use") & (F.col("n_rounds") == rounds)).select("conv_id", "exchange")


def transcript(messages: DataFrame) -> DataFrame:
    """Ordered messages after the last reset (role system) of each conversation."""
    m = messages.withColumn("_reset", F.max(F.when(F.col("role") == "system", F.col("turn"))).over(Window.partitionBy("conv_id")))
    live = m.where(F.col("_reset").isNull() | (F.col("turn") > F.col("_reset")))
    return live.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t")))), lambda x: x["t"]).alias("messages"))


def validate_messages(messages: DataFrame, most: int = 8000) -> DataFrame:
    n = F.char_length(F.coalesce("text", F.lit("")))
    return messages.withColumn("problem", F.when(n < 1, "empty").when(n > most, "too_long"))
