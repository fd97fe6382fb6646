"""Small frames and plain-Python answers to compare with."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

from spendlens import domain

START = dt.datetime(2024, 1, 1)


def tx(transaction_id, user_id, amount, seconds, **other):
    """One transaction ``seconds`` after the start of 2024."""
    row = {f.name: None for f in domain.TRANSACTION_SCHEMA.fields}
    row.update(transaction_id=str(transaction_id), user_id=user_id, amount=None if amount is None else float(amount),
               currency="USD", merchant="M1", category="FOOD", status="COMPLETED", device_id="D1", location="L1",
               timestamp=START + dt.timedelta(seconds=seconds))
    row.update(other)
    return row


def frame(spark, rows):
    names = [f.name for f in domain.TRANSACTION_SCHEMA.fields]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], domain.TRANSACTION_SCHEMA)


def skewed_rows(n=600, seed=7):
    """A third of the rows belongs to one user; there are equal seconds, equal timestamps and long pauses."""
    rng = random.Random(seed)
    rows, clock = [], {}
    for i in range(n):
        user = "hot" if i % 3 == 0 else f"u{rng.randrange(12)}"
        step = rng.choice([0, 0, 0.25, 0.5, 1, 60, 600, 1800, 1801, 3600, 30_000])
        clock[user] = clock.get(user, rng.randrange(50_000)) + step
        rows.append(tx(f"{i:05d}", user, rng.choice([10.0, 10.0, round(rng.uniform(1, 500), 2)]), clock[user],
                       merchant=rng.choice(["M1", "M2", None]), category=rng.choice(domain.CATEGORIES[:4]),
                       device_id=f"D{rng.randrange(6)}"))
    rng.shuffle(rows)
    return rows


def by_user(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r["timestamp"], r["transaction_id"])):
        groups.setdefault(row["user_id"], []).append(row)
    return groups


def sec(row):
    return math.floor((row["timestamp"] - dt.datetime(1970, 1, 1)).total_seconds())


def stdev(values):
    return statistics.stdev(values) if len(values) > 1 else None


def close(a, b, digits=6):
    if a is None or b is None:
        return a is b
    return abs(a - b) <= 10 ** -digits * max(1.0, abs(b))
