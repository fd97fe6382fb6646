"""Per-user timelines against plain Python, on skewed rows and with pieces so small that every border is crossed."""

import statistics

import pytest
from helpers import by_user, close, frame, sec, skewed_rows, stdev, tx
from pyspark.sql import functions as F

from spendlens.functions import columns as C
from spendlens.operators import timeline as L


@pytest.fixture(scope="module")
def rows():
    return skewed_rows()


@pytest.fixture(scope="module")
def df(spark, rows):
    return frame(spark, rows).repartition(5).cache()


def keyed(result, *columns):
    return {r.transaction_id: tuple(r[c] for c in columns) for r in result.collect()}


def test_trailing_spend(df, rows):
    got = keyed(L.trailing_spend(df), "hourly_spending", "daily_spending")
    for group in by_user(rows).values():
        for row in group:
            want = tuple(sum(o["amount"] for o in group if 0 <= sec(row) - sec(o) <= span) for span in (3600, 86400))
            assert all(close(g, w) for g, w in zip(got[row["transaction_id"]], want))


def test_trailing_edge_is_inclusive(spark):
    out = keyed(L.trailing_spend(frame(spark, [tx(1, "u", 5, 82_800), tx(2, "u", 7, 86_400), tx(3, "u", 9, 86_401)])),
                "hourly_spending")
    assert out == {"1": (5.0,), "2": (12.0,), "3": (16.0,)}


def test_velocity_metrics(df, rows):
    got = {r.user_id: r for r in L.velocity_metrics(df).collect()}
    for user, group in by_user(rows).items():
        for name, span in (("hourly", 3600), ("daily", 86400)):
            sums = [sum(o["amount"] for o in group if 0 <= sec(r) - sec(o) <= span) for r in group]
            assert close(got[user][f"max_{name}_spending"], max(sums))
            assert close(got[user][f"avg_{name}_spending"], statistics.fmean(sums))
            assert close(got[user][f"std_{name}_spending"], stdev(sums), 4)


def expected_sessions(rows, gap=1800):
    out = {}
    for user, group in by_user(rows).items():
        number, last = 0, None
        for row in group:
            if last is not None and sec(row) - last > gap:
                number += 1
            last = sec(row)
            out[row["transaction_id"]] = (user, number)
    return out


def test_session_transactions(df, rows):
    assert keyed(L.session_transactions(df), "user_id", "session_id") == expected_sessions(rows)


def test_sessions(df, rows):
    want = {}
    amounts = {r["transaction_id"]: r["amount"] for r in rows}
    for transaction_id, key in expected_sessions(rows).items():
        want.setdefault(key, []).append(amounts[transaction_id])
    got = {(r.user_id, r.session_id): r for r in L.sessions(df).collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key].session_transaction_count == len(values)
        assert close(got[key].session_total_amount, sum(values))


def test_session_gap_of_exactly_the_limit_continues(spark):
    out = L.sessions(frame(spark, [tx(1, "u", 1, 86_000), tx(2, "u", 1, 87_800), tx(3, "u", 1, 89_601)])).collect()
    assert sorted(r.session_transaction_count for r in out) == [1, 2]


def test_behaviour_features(df, rows):
    columns = ["amount_zscore", "time_since_last", "transactions_last_hour", "avg_amount_last_hour", "amount_ratio"]
    got = keyed(L.behaviour_features(df), *columns)
    assert len(got) == len(rows)
    for group in by_user(rows).values():
        for i, row in enumerate(group):
            seen = [o["amount"] for o in group if o["timestamp"] <= row["timestamp"]]
            hour = [o["amount"] for o in group if 0 <= sec(row) - sec(o) <= 3600]
            sd = stdev(seen)
            z = (row["amount"] - statistics.fmean(seen)) / sd if sd else None
            pause = sec(row) - sec(group[i - 1]) if i else None
            want = (z, pause, len(hour), statistics.fmean(hour), row["amount"] / statistics.fmean(hour))
            assert all(close(g, w) for g, w in zip(got[row["transaction_id"]], want)), (row, want)


def test_merchant_features_count_a_missing_merchant(df, rows):
    got = keyed(L.merchant_features(df), "merchant_frequency", "avg_merchant_amount")
    for row in rows:
        same = [o["amount"] for o in rows if (o["user_id"], o["merchant"]) == (row["user_id"], row["merchant"])]
        assert got[row["transaction_id"]][0] == len(same)
        assert close(got[row["transaction_id"]][1], statistics.fmean(same))


@pytest.mark.parametrize("block", [11, 100, 100_000])
def test_recent_history(df, rows, block):
    got = keyed(L.recent_history(df, rows_per_block=block), "avg_last_10", "std_last_10", "count_last_hour")
    assert len(got) == len(rows)
    for group in by_user(rows).values():
        for i, row in enumerate(group):
            before = [o["amount"] for o in group[max(0, i - 10):i]]
            hour = [o for o in group if 0 <= sec(row) - sec(o) <= 3600]
            want = (statistics.fmean(before) if before else None, stdev(before), len(hour))
            assert all(close(g, w) for g, w in zip(got[row["transaction_id"]], want))


def test_same_result_for_any_partitioning(spark, rows):
    def figures(parts):
        out = L.behaviour_features(frame(spark, rows).repartition(parts))
        return sorted(map(tuple, out.select("transaction_id", F.round("amount_zscore", 9), "time_since_last").collect()))

    assert figures(1) == figures(9)


def test_first_and_equal_amounts_have_no_score(spark):
    out = keyed(L.behaviour_features(frame(spark, [tx(1, "u", 10.1, 0), tx(2, "u", 10.1, 5), tx(3, "u", 10.1, 9)])),
                "amount_zscore", "time_since_last")
    assert out == {"1": (None, None), "2": (None, 5), "3": (None, 4)}


def test_rows_without_user_or_timestamp_have_no_features(spark):
    rows = [tx(1, "u", 1, 0), tx(2, "u", 2, 60), *[tx(f"n{i}", None, 5 * i, i) for i in range(6)],
            *[tx(f"t{i}", "u", 5, 0, timestamp=None) for i in range(3)], tx("b", None, 1, 0, timestamp=None)]
    df = frame(spark, rows)
    nothing = {r["transaction_id"] for r in rows} - {"1", "2"}
    for result, names in ((L.trailing_spend(df), ["hourly_spending", "daily_spending"]),
                          (L.behaviour_features(df), ["amount_zscore", "time_since_last", "transactions_last_hour",
                                                      "avg_amount_last_hour", "amount_ratio"]),
                          (L.recent_history(df), ["avg_last_10", "std_last_10", "count_last_hour"])):
        out = keyed(result, *names)
        assert len(out) == len(rows)
        assert all(out[i] == (None,) * len(names) for i in nothing)
    assert keyed(L.recent_history(df), "avg_last_10", "count_last_hour")["2"] == (1.0, 2)


def test_close_and_tiny_amounts(spark):
    """Thirty large amounts that differ by cents, and three below a cent."""
    large = [900_000 + i % 3 / 100 for i in range(30)]
    tiny = [0.004, 0.003, 0.006]
    rows = [tx(f"a{i:02d}", "large", x, i * 60) for i, x in enumerate(large)]
    rows += [tx(f"b{i}", "tiny", x, i * 60) for i, x in enumerate(tiny)]
    out = keyed(L.behaviour_features(frame(spark, rows)), "amount_zscore", "avg_amount_last_hour")
    for name, amounts in (("a", large), ("b", tiny)):
        for i in range(1, len(amounts)):
            so_far = amounts[:i + 1]
            score, average = out[f"{name}{i:02d}" if name == "a" else f"{name}{i}"]
            assert close(score, (amounts[i] - statistics.mean(so_far)) / statistics.stdev(so_far), 5)
            assert close(average, statistics.mean(so_far), 9)
    spread = {r.user_id: r.std_hourly_spending for r in L.velocity_metrics(frame(spark, rows)).collect()}
    sums = [sum(tiny[:i + 1]) for i in range(3)]
    assert close(spread["tiny"], statistics.stdev(sums), 5)


def test_daily_moving_average(spark):
    rows = [tx(d, "u", d + 1, d * 86_400) for d in range(9)]
    out = {str(r.day): r.moving_average for r in L.daily_moving_average(frame(spark, rows)).collect()}
    assert out["2024-01-01"] == 1.0 and out["2024-01-07"] == 4.0 and out["2024-01-09"] == 6.0


# --- amounts of any size ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def odd_amounts(spark):
    """Two users: one with amounts that are no usable numbers, one with the largest usable ones."""
    inf, nan = float("inf"), float("nan")
    amounts = [1.0, nan, 3.0, 1e13, 1e15, inf, -inf, None, 5.0]
    rows = [tx(f"a{i}", "a", v, 60 * i) for i, v in enumerate(amounts)]
    return frame(spark, rows + [tx(f"b{i:03d}", "b", 9e11 + i % 2, i) for i in range(300)])


def test_unusable_amounts_are_in_no_sum_and_no_count(odd_amounts):
    got = {r.transaction_id: r for r in L.behaviour_features(odd_amounts).collect()}
    assert [got[f"a{i}"].avg_amount_last_hour for i in range(9)] == [1, 1, 2, 2, 2, 2, 2, 2, 3]
    assert [got[f"a{i}"].transactions_last_hour for i in range(9)] == list(range(1, 10))
    assert [got[f"a{i}"].amount_ratio for i in (1, 3, 4, 5, 6, 7)] == [None] * 6 and got["a8"].amount_ratio == 5 / 3
    assert [got[f"a{i}"].amount_zscore for i in (0, 1, 3, 4, 5, 6, 7)] == [None] * 7
    assert close(got["a2"].amount_zscore, 1 / 2 ** 0.5) and close(got["a8"].amount_zscore, 1.0)
    trailing = keyed(L.trailing_spend(odd_amounts), "hourly_spending", "daily_spending")
    assert [trailing[f"a{i}"] for i in range(9)] == [(1, 1), (1, 1), *[(4, 4)] * 6, (9, 9)]
    sessions = {r.user_id: (r.session_transaction_count, r.session_total_amount) for r in L.sessions(odd_amounts).collect()}
    assert sessions["a"] == (9, 9.0)


def test_large_amounts_end_no_job(odd_amounts):
    """Squares of more than 38 digits make a running deviation unknown; sums stay exact."""
    got = {r.transaction_id: r for r in L.behaviour_features(odd_amounts).collect()}
    assert close(got["b001"].amount_zscore, 1 / 2 ** 0.5, 3) and got["b299"].amount_zscore is None
    assert got["b299"].avg_amount_last_hour == 9e11 + 0.5
    velocity = {r.user_id: r for r in L.velocity_metrics(odd_amounts).collect()}
    sums = [sum(9e11 + j % 2 for j in range(i + 1)) for i in range(300)]
    assert velocity["b"].max_hourly_spending == sums[-1] and close(velocity["b"].avg_hourly_spending, statistics.fmean(sums))
    assert close(velocity["b"].std_hourly_spending, statistics.stdev(sums), 6)
    trailing = keyed(L.trailing_spend(odd_amounts), "hourly_spending")
    assert trailing["b299"] == (sums[-1],)


def test_unknown_amounts_only(spark):
    df = frame(spark, [tx(1, "u", None, 0), tx(2, "u", float("nan"), 1)])
    row = L.velocity_metrics(df).first()
    assert (row.max_hourly_spending, row.std_daily_spending) == (None, None)
    assert {r.amount_zscore for r in L.behaviour_features(df).collect()} == {None}


def test_totals_in_units_are_rounded_once(spark):
    totals = [0, -1, 2 ** 53 - 1, 2 ** 53 + 1, 270_000_000_000_150_000_000, -270_000_000_000_150_000_001, 10 ** 37 + 7]
    rows = spark.createDataFrame([(str(t),) for t in totals], "t string").select(F.col("t").cast(C.WIDE).alias("t"))
    got = {int(r.t): r.x for r in rows.select("t", C.from_units("t").alias("x")).collect()}
    assert got == {t: t / 1_000_000 for t in totals}  # Python divides whole numbers exactly, then rounds
    assert rows.select(C.from_units(F.lit(None).cast(C.WIDE)).alias("x")).first().x is None
