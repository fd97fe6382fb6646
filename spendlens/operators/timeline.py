"""Per-user timelines that do not need a user's whole history in one task.

``Window.partitionBy("user_id")`` sends all rows of a user to one task, which fails when one user owns a large share
of the data. Here the rows are first rolled up to one row per (user, second), with map-side combining, and windows
run over pieces of known size:

* a trailing range is a window per (user, piece of days). The last seconds of a piece are copied into the next one,
  so a range never reaches outside its piece;
* a running total is a window per (user, piece) plus the totals of the earlier pieces, one row per piece;
* a session is put together from the sessions of single days, of which a day has at most 48;
* a frame of rows is a window per (user, block of consecutive rows), the block number coming from the running count.

A piece holds at most a few hundred thousand roll-up rows whatever the user does. Raw rows are only shuffled by
(user, second) or (user, block).

Sums and sums of squares are kept in whole millionths, as decimals, so they are exact and do not depend on the order of
addition. An amount of 1e12 or more, an infinite one and NaN are unknown amounts: they count as transactions, but like NULL
they are in no sum, average or deviation, and have no z-score or ratio of their own. A sum of squares of more than 38 digits
makes the deviation NULL. Rows without a user or a timestamp have no place on a timeline: they are set apart before any window and come
back with NULL features.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spendlens.functions import columns as C

DAY = 86_400
HOUR = 3_600
SESSION_GAP = 1_800
ROWS_PER_BLOCK = 100_000


# --- roll-ups ---------------------------------------------------------------------------------------

def _measures() -> dict[str, tuple[str, Column]]:
    """What a group of transactions is reduced to, and how two groups combine."""
    return {
        "n": ("sum", F.count("*")),
        "m": ("sum", F.count(C.usable("amount"))),
        "units": ("sum", F.sum(C.units("amount"))),
        "squares": ("checked", F.try_sum(F.coalesce(F.try_multiply(C.units("amount"), C.units("amount")), F.lit(0)))),
        "last_sec": ("max", F.max(C.epoch_second())),
        "first_ts": ("min", F.min("timestamp")),
        "last_ts": ("max", F.max("timestamp")),
    }


def _combine(kind: str, column) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](column)


def _checked_sum(name: str, over) -> Column:
    """Sum over a window of sums that are NULL where they have too many digits; 0 for an empty frame."""
    rows = F.count(F.lit(1)).over(over)
    return F.when(rows == 0, F.lit(0).cast(C.WIDE)).when(F.count(name).over(over) == rows, F.try_sum(name).over(over))


def _combined_over(kind: str, name: str, over) -> Column:
    return _checked_sum(name, over) if kind == "checked" else _combine(kind, name).over(over)


def _piece(sec: Column, length: int) -> Column:
    return F.floor(sec / length)


def per_second(tx: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per user and second."""
    measures = _measures()
    return tx.groupBy("user_id", C.epoch_second().alias("sec")).agg(*[measures[n][1].alias(n) for n in names])


def per_piece(tx: DataFrame, names: Sequence[str], length: int) -> DataFrame:
    """One row per user and piece of time, straight from the rows."""
    measures = _measures()
    return tx.groupBy("user_id", _piece(C.epoch_second(), length).alias("piece")).agg(
        *[measures[n][1].alias(n) for n in names])


def second_features(tx: DataFrame, ranges: Mapping[str, int], trailing: Sequence[str],
                    before: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Figures at every (user, second).

    ``{measure}_{range}`` sums over ``[sec - range, sec]``, for whole-number measures; ``{measure}_before`` combines
    all earlier seconds of the user (sums start at 0, extremes at NULL); ``keep`` are measures of the second itself.
    """
    reach = max(ranges.values())
    length = max(DAY, 4 * reach)
    own = _piece(F.col("sec"), length)
    seconds = per_second(tx, list(dict.fromkeys([*trailing, *before, *keep])))
    near_end = F.col("sec") >= (own + 1) * length - reach
    copies = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    spread = seconds.withColumn("piece", F.explode(copies)).repartition("user_id", "piece")
    out = _trailing_sums(spread, ranges, trailing, length, [*before, *keep])
    names = ["user_id", "sec", *keep, *[f"{name}_{label}" for label in ranges for name in trailing]]
    if before:
        out = _add_before(out, per_piece(tx, before, length), before)
        names += [f"{name}_before" for name in before]
    return out.select(*names)


def _trailing_sums(spread: DataFrame, ranges: Mapping[str, int], trailing: Sequence[str], length: int,
                   carry: Sequence[str]) -> DataFrame:
    """Trailing sums as running totals of entries and exits.

    A sliding frame is added up anew for every row, which takes (rows x frame) steps. Here a second enters the total
    at its time and leaves it one second after the range has passed, so one running sum per range does.
    """
    own = _piece(F.col("sec"), length) == F.col("piece")

    def entry(at: Column, is_row: Column, signs: Mapping[str, int]) -> Column:
        changes = [(F.col(name) * signs[label]).alias(f"_{name}_{label}") for label in ranges for name in trailing]
        return F.struct(at.alias("sec"), is_row.alias("_row"), *changes)

    kinds = [entry(F.col("sec"), own, {label: 1 for label in ranges})]
    for label, span in ranges.items():
        signs = {other: -1 if other == label else 0 for other in ranges}
        kinds.append(entry(F.col("sec") + span + 1, F.lit(False), signs))
    total = Window.partitionBy("user_id", "piece").orderBy("sec")
    entries = (spread.select("user_id", "piece", *carry, F.explode(F.array(*kinds)).alias("_entry"))
               .select("user_id", "piece", *carry, "_entry.*")
               .filter(F.col("sec") < (F.col("piece") + 1) * length))
    return entries.withColumns({
        f"{name}_{label}": F.sum(f"_{name}_{label}").over(total) for label in ranges for name in trailing
    }).filter("_row")


def _add_before(seconds: DataFrame, pieces: DataFrame, names: Sequence[str]) -> DataFrame:
    kinds = {name: _measures()[name][0] for name in names}
    inside = Window.partitionBy("user_id", "piece").orderBy("sec").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("user_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    past = pieces.select("user_id", "piece",
                         *[_combined_over(kind, name, across).alias(f"_past_{name}") for name, kind in kinds.items()])
    joined = seconds.withColumns({
        f"_here_{name}": _combined_over(kind, name, inside) for name, kind in kinds.items()
    }).join(past, ["user_id", "piece"], "left")

    def combined(name: str, kind: str) -> Column:
        here, earlier = F.col(f"_here_{name}"), F.col(f"_past_{name}")
        if kind == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0))
        if kind == "checked":
            return F.try_add(here, earlier)
        return (F.greatest if kind == "max" else F.least)(here, earlier)

    return joined.withColumns({f"{name}_before": combined(name, kind) for name, kind in kinds.items()})


def _join_seconds(tx: DataFrame, seconds: DataFrame) -> DataFrame:
    """Attach per-second columns to the raw rows."""
    return tx.withColumn("sec", C.epoch_second()).join(seconds, ["user_id", "sec"], "left")


def placed(tx: DataFrame) -> DataFrame:
    """The rows that have a user and a timestamp."""
    return tx.filter("user_id IS NOT NULL AND timestamp IS NOT NULL")


def _with_others(features: DataFrame, tx: DataFrame) -> DataFrame:
    """Features of the placed rows, and the other rows with NULL for them."""
    others = tx.filter("user_id IS NULL OR timestamp IS NULL")
    return features.unionByName(others, allowMissingColumns=True)


def _within_second(*order: str):
    return Window.partitionBy("user_id", "sec").orderBy(*order)


# --- trailing spend and velocity ----------------------------------------------------------------------

SPEND_RANGES = {"1h": HOUR, "24h": DAY}


def trailing_spend(tx: DataFrame) -> DataFrame:
    """Spend of the last hour and the last 24 hours at every transaction, both ends included."""
    known = placed(tx)
    sums = second_features(known, SPEND_RANGES, ["units"]).select(
        "user_id", "sec", C.from_units("units_1h").alias("hourly_spending"),
        C.from_units("units_24h").alias("daily_spending"))
    return _with_others(_join_seconds(known, sums).drop("sec"), tx)


def velocity_metrics(tx: DataFrame) -> DataFrame:
    """Maximum, average and deviation of the trailing spends per user.

    All rows of a second share one value, so the figures are aggregated from the roll-up with its row counts as
    weights and the raw rows are not read again.
    """
    sums = second_features(placed(tx), SPEND_RANGES, ["units"], keep=["n"])
    aggregates, results = [F.sum("n").alias("n")], []
    for name, column in (("hourly", "units_1h"), ("daily", "units_24h")):
        value, n = F.col(column).cast(C.WIDE), F.col("n").cast("decimal(18,0)")
        aggregates += [
            F.max(value).alias(f"max_{name}"),
            F.try_sum(F.try_multiply(n, value)).alias(f"sum_{name}"),
            F.try_sum(F.try_multiply(n, F.try_multiply(value, value))).alias(f"squares_{name}"),
            F.sum(n.cast("double") * value.cast("double") * value.cast("double")).alias(f"rough_{name}"),
        ]
        results += [
            C.from_units(f"max_{name}").alias(f"max_{name}_spending"),
            (C.from_units(f"sum_{name}") / F.col("n")).alias(f"avg_{name}_spending"),
            C.deviation_from_units("n", f"sum_{name}", f"squares_{name}", f"rough_{name}").alias(f"std_{name}_spending"),
        ]
    return sums.groupBy("user_id").agg(*aggregates).select("user_id", *results)


# --- sessions ---------------------------------------------------------------------------------------

SESSION_MEASURES = ["n", "units", "first_ts", "last_ts"]


def _seconds_by_day(tx: DataFrame, gap: int, names: Sequence[str]) -> DataFrame:
    """Seconds numbered by the session of their day: a pause longer than ``gap`` starts the next one."""
    days = per_second(tx, names).withColumn("day", _piece(F.col("sec"), DAY))
    w = Window.partitionBy("user_id", "day").orderBy("sec")
    opens = (F.col("sec") - F.lag("sec").over(w) > gap).cast("int")
    return days.withColumn("_opens", F.coalesce(opens, F.lit(0))).withColumn("part", F.sum("_opens").over(w))


def _day_sessions(tx: DataFrame, gap: int, names: Sequence[str]) -> DataFrame:
    """Sessions of single days with the number of the whole session they belong to.

    A day has at most ``DAY / gap`` of them, so they are numbered in one window per user.
    """
    kinds = _measures()
    parts = _seconds_by_day(tx, gap, names).groupBy("user_id", "day", "part").agg(
        F.min("sec").alias("start_sec"), F.max("sec").alias("end_sec"),
        *[_combine(kinds[name][0], name).alias(name) for name in names])
    w = Window.partitionBy("user_id").orderBy("start_sec")
    opens = (F.col("start_sec") - F.lag("end_sec").over(w) > gap).cast("int")
    return parts.withColumn("_opens", F.coalesce(opens, F.lit(0))).withColumn("session_id", F.sum("_opens").over(w))


def sessions(tx: DataFrame, gap: int = SESSION_GAP) -> DataFrame:
    """Sessions of a user: a pause longer than ``gap`` seconds starts the next one. Numbered from 0."""
    return _day_sessions(tx, gap, SESSION_MEASURES).groupBy("user_id", "session_id").agg(
        F.sum("n").alias("session_transaction_count"),
        C.from_units(F.sum("units")).alias("session_total_amount"),
        F.min("first_ts").alias("session_start"),
        F.max("last_ts").alias("session_end"),
    )


def session_transactions(tx: DataFrame, gap: int = SESSION_GAP) -> DataFrame:
    """The transactions with the session they belong to, one row each."""
    numbers = _day_sessions(tx, gap, ["n"]).select("user_id", "day", "part", "session_id")
    seconds = _seconds_by_day(tx, gap, ["n"]).join(numbers, ["user_id", "day", "part"])
    return _join_seconds(tx, seconds.select("user_id", "sec", "session_id")).drop("sec")


# --- features at every transaction --------------------------------------------------------------------

def behaviour_features(tx: DataFrame) -> DataFrame:
    """Running z-score, pause since the previous transaction, and count, average and ratio of the last hour.

    The running figures include the current row and every row with the same timestamp.
    """
    known = placed(tx)
    seconds = second_features(known, {"1h": HOUR}, ["n", "m", "units"], before=["m", "units", "squares", "last_sec"])
    here = _within_second("timestamp")
    first = F.row_number().over(_within_second("timestamp", "transaction_id")) == 1
    unit = C.units("amount")
    rows = _join_seconds(known, seconds).withColumns({
        "_m": F.col("m_before") + F.count(unit).over(here),
        "_total": F.col("units_before") + F.coalesce(F.sum(unit).over(here), F.lit(0)),
        "_squares": F.try_add("squares_before", F.try_sum(F.coalesce(F.try_multiply(unit, unit), F.lit(0))).over(here)),
        "_first": first,
    })
    deviation = C.deviation_from_units("_m", "_total", "_squares")
    average_1h = F.try_divide(C.from_units("units_1h"), F.col("m_1h"))
    pause = F.when(F.col("_first"), F.col("sec") - F.col("last_sec_before")).otherwise(F.lit(0))
    features = rows.select(
        *tx.columns,
        C.zscore(C.usable("amount"), F.try_divide(C.from_units("_total"), F.col("_m")), deviation).alias("amount_zscore"),
        pause.alias("time_since_last"),
        F.col("n_1h").alias("transactions_last_hour"),
        average_1h.alias("avg_amount_last_hour"),
        F.try_divide(C.usable("amount"), average_1h).alias("amount_ratio"),
    )
    return _with_others(features, tx)


def merchant_features(tx: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Count and average per (user, merchant) on every row; a missing merchant is a merchant of its own.

    ``history`` is the frame to count in when ``tx`` carries other computed columns.
    """
    counted = tx if history is None else history
    stats = counted.groupBy(F.col("user_id").alias("_user"), F.col("merchant").alias("_merchant")).agg(
        F.count("*").alias("merchant_frequency"), F.avg("amount").alias("avg_merchant_amount"))
    same = (F.col("user_id") == F.col("_user")) & F.col("merchant").eqNullSafe(F.col("_merchant"))
    return tx.join(stats, same, "left").drop("_user", "_merchant")


def recent_history(tx: DataFrame, rows: int = 10, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Average and deviation of the ``rows`` previous transactions, and the count of the last hour.

    The running count numbers the transactions of a user; blocks of consecutive numbers are framed on their own,
    each starting with a copy of the last ``rows`` rows of the block before it.
    """
    known = placed(tx)
    seconds = second_features(known, {"1h": HOUR}, ["n"], before=["n"])
    number = F.col("n_before") + F.row_number().over(_within_second("timestamp", "transaction_id")) - 1
    numbered = _join_seconds(known, seconds).withColumn("_number", number)
    block, position = _piece(F.col("_number"), rows_per_block), F.col("_number") % rows_per_block
    own = F.struct(block.alias("block"), F.lit(False).alias("copy"))
    next_block = F.struct((block + 1).alias("block"), F.lit(True).alias("copy"))
    copies = F.when(position >= rows_per_block - rows, F.array(own, next_block)).otherwise(F.array(own))
    spread = numbered.withColumn("_at", F.explode(copies)).select("*", "_at.block", "_at.copy")
    frame = Window.partitionBy("user_id", "block").orderBy("_number").rowsBetween(-rows, -1)
    features = spread.withColumns({
        f"avg_last_{rows}": F.avg("amount").over(frame),
        f"std_last_{rows}": F.stddev("amount").over(frame),
        "count_last_hour": F.col("n_1h"),
    }).filter(~F.col("copy")).select(*tx.columns, f"avg_last_{rows}", f"std_last_{rows}", "count_last_hour")
    return _with_others(features, tx)


def daily_moving_average(tx: DataFrame, points: int = 7) -> DataFrame:
    """Daily spend per user and its average over the last ``points`` days that have spend."""
    daily = tx.groupBy("user_id", F.to_date("timestamp").alias("day")).agg(F.sum("amount").alias("daily_spend"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(1 - points, 0)
    return daily.withColumn("moving_average", F.avg("daily_spend").over(w))
