"""Registry of the named queries and the SQL text each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


# Common table expressions of the check SQL: name -> (needed names, text).
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": (
        (),
        """SELECT event_id, user_id AS person_id, ts, CAST(ts AS DATE) AS date, event_type AS type,
           CAST(extract('hour' FROM ts) * 2 + extract('minute' FROM ts) // 30 AS INTEGER) AS slot,
           CAST(value AS DECIMAL(18,2)) AS amount,
           CASE user_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS pattern
           FROM events""",
    ),
    "slots": (
        ("ev",),
        """SELECT pattern, person_id, date, slot, CAST(SUM(amount) AS DECIMAL(18,2)) AS amount
           FROM ev GROUP BY pattern, person_id, date, slot""",
    ),
    "s48": ((), "SELECT CAST(range AS INTEGER) AS slot FROM range(48)"),
    "grid": (
        ("slots", "s48"),
        """SELECT d.pattern, d.person_id, d.date, s48.slot, COALESCE(s.amount, 0) AS amount
           FROM (SELECT DISTINCT pattern, person_id, date FROM slots) d CROSS JOIN s48
           LEFT JOIN slots s ON s.person_id = d.person_id AND s.date = d.date AND s.slot = s48.slot""",
    ),
    "vecs": (
        ("grid",),
        """SELECT pattern, person_id, date, slot, CAST(amount AS DOUBLE) AS x,
           MIN(CAST(amount AS DOUBLE)) OVER p AS lo, MAX(CAST(amount AS DOUBLE)) OVER p AS hi
           FROM grid WINDOW p AS (PARTITION BY person_id, date)""",
    ),
    "shapes": (
        ("slots", "s48"),
        """SELECT pattern, person_id, block, slot, s AS raw,
           CASE WHEN MAX(s) OVER (PARTITION BY person_id, block) <> 0
                THEN s / MAX(s) OVER (PARTITION BY person_id, block) ELSE s END AS x
           FROM (SELECT c.pattern, c.person_id, c.block, s48.slot, CAST(SUM(COALESCE(s.amount, 0)) AS DOUBLE) AS s
                 FROM (SELECT pattern, person_id, d, CAST(floor(date_diff('day', o, d) / 5.0) AS INTEGER) AS block
                       FROM (SELECT pattern, person_id, o, CAST(unnest(generate_series(f, l, INTERVAL 1 DAY)) AS DATE) AS d
                             FROM (SELECT pattern, person_id, MIN(date) AS f, MAX(date) AS l, (SELECT MIN(date) FROM slots) AS o
                                   FROM slots GROUP BY pattern, person_id))) c
                 CROSS JOIN s48
                 LEFT JOIN slots s ON s.person_id = c.person_id AND s.date = c.d AND s.slot = s48.slot
                 GROUP BY c.pattern, c.person_id, c.block, s48.slot HAVING COUNT(*) = 5)""",
    ),
    "seqd": (
        ("slots",),
        """SELECT pattern, person_id, date, slot, amount,
           CAST(row_number() OVER w AS INTEGER) AS seq,
           COALESCE(SUM(amount) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
           COALESCE(LAG(amount, 1) OVER w, 0) AS out1, COALESCE(LAG(amount, 2) OVER w, 0) AS out2,
           COALESCE((slot - LAG(slot) OVER w) * 1800, 0) AS gap
           FROM slots WHERE amount > 0
           WINDOW w AS (PARTITION BY person_id, date ORDER BY slot)""",
    ),
    "proc": (
        ("seqd",),
        "SELECT date, LAG(date) OVER (ORDER BY date) AS prev_date FROM (SELECT DISTINCT date FROM seqd)",
    ),
    "daily": (
        ("seqd",),
        """SELECT pattern, person_id, date, CAST(SUM(amount) AS DOUBLE) AS total,
           CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS mean,
           COALESCE(stddev_samp(CAST(amount AS DOUBLE)), 0.0) AS std,
           CASE WHEN COUNT(*) >= 2 THEN COALESCE(regr_slope(CAST(amount AS DOUBLE), CAST(seq AS DOUBLE)), 0.0) ELSE 0.0 END AS slope
           FROM seqd GROUP BY pattern, person_id, date""",
    ),
}


def _feature_body(proc: str = "proc", seqd: str = "seqd", daily: str = "daily") -> str:
    return f"""SELECT s.pattern, s.person_id, s.date, s.slot, CAST(s.slot // 2 AS INTEGER) AS hour,
      CAST((s.slot % 2) * 30 AS INTEGER) AS minute, CAST(s.amount AS DOUBLE) AS amount, s.seq AS output_seq,
      CASE WHEN d.total > 0 THEN CAST(s.before + s.amount AS DOUBLE) / d.total ELSE 0.0 END AS ratio_to_prev_day,
      CASE WHEN d.total > 0 THEN CAST(s.before AS DOUBLE) / d.total ELSE 0.0 END AS ratio_before,
      CASE WHEN d.total > 0 THEN CAST(COALESCE(u.upto, 0) AS DOUBLE) / d.total ELSE 0.0 END AS ratio_prev_to_total,
      CASE WHEN d.total > 0 THEN CAST(s.gap AS DOUBLE) ELSE 0.0 END AS time_diff_prev_outputs,
      CASE WHEN d.total > 0 THEN CAST(s.before AS DOUBLE) ELSE 0.0 END AS prev_sum,
      CASE WHEN d.total > 0 THEN d.mean ELSE 0.0 END AS prev_day_mean,
      CASE WHEN d.total > 0 THEN d.std ELSE 0.0 END AS prev_day_std,
      CASE WHEN d.total > 0 THEN d.total ELSE 0.0 END AS prev_day_total,
      CAST(COALESCE(p0.amount - p1.amount, 0) AS DOUBLE) AS slope_prev_day_n_n_minus_1,
      CAST(COALESCE(p1.amount - p2.amount, 0) AS DOUBLE) AS slope_prev_day_n_minus_1_n_minus_2,
      CASE WHEN d.total > 0 THEN d.slope ELSE 0.0 END AS avg_change_rate,
      CASE WHEN d.total > 0 THEN CAST(s.out1 AS DOUBLE) ELSE 0.0 END AS prev_output,
      CASE WHEN d.total > 0 THEN CAST(s.out2 AS DOUBLE) ELSE 0.0 END AS prev_prev_output
      FROM {seqd} s JOIN {proc} k ON k.date = s.date
      LEFT JOIN {daily} d ON d.person_id = s.person_id AND d.date = k.prev_date
      LEFT JOIN {seqd} p0 ON p0.person_id = s.person_id AND p0.date = k.prev_date AND p0.seq = s.seq
      LEFT JOIN {seqd} p1 ON p1.person_id = s.person_id AND p1.date = k.prev_date AND p1.seq = s.seq - 1
      LEFT JOIN {seqd} p2 ON p2.person_id = s.person_id AND p2.date = k.prev_date AND p2.seq = s.seq - 2
      LEFT JOIN (SELECT a.person_id, a.date, a.slot, SUM(b.amount) AS upto
                 FROM {seqd} a JOIN {proc} kk ON kk.date = a.date
                 JOIN {seqd} b ON b.person_id = a.person_id AND b.date = kk.prev_date AND b.slot <= a.slot
                 GROUP BY a.person_id, a.date, a.slot) u
        ON u.person_id = s.person_id AND u.date = s.date AND u.slot = s.slot"""


_CTES["feats"] = (("seqd", "proc", "daily"), _feature_body())
_CTES["preds"] = (
    ("slots",),
    """SELECT * FROM (SELECT pattern, person_id, date, slot, CAST(amount AS DOUBLE) AS actual,
       CAST(LAG(amount) OVER w AS DOUBLE) AS personal,
       CAST(SUM(amount) OVER b AS DOUBLE) / COUNT(*) OVER b AS base
       FROM slots WHERE amount > 0
       WINDOW w AS (PARTITION BY person_id ORDER BY date, slot),
              b AS (PARTITION BY person_id ORDER BY date, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       WHERE personal IS NOT NULL""",
)
_CTES["splits"] = (
    ("preds",),
    """SELECT person_id, date, CASE WHEN n >= 29 THEN
          CASE WHEN r <= n - 9 THEN 'train' WHEN r <= n - 4 THEN 'valid' ELSE 'holdout' END
        WHEN n >= 5 THEN CASE WHEN r <= greatest(floor(n * 0.7), 3) THEN 'train'
          WHEN r <= greatest(floor(n * 0.7), 3) + greatest(floor(n * 0.15), 1) THEN 'valid' ELSE 'holdout' END END AS split
       FROM (SELECT person_id, date, row_number() OVER (PARTITION BY person_id ORDER BY date) AS r,
             COUNT(*) OVER (PARTITION BY person_id) AS n FROM (SELECT DISTINCT person_id, date FROM preds))""",
)


def with_ctes(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause of the named expressions and what they need, then ``body``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _CTES[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({_CTES[n][1]})" for n in ordered]
    parts += [f"{n} AS ({t})" for n, t in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def hash01(*keys: str, seed: int = 42) -> str:
    """SQL twin of the hashed fraction."""
    text = " || '|' || ".join([f"CAST({k} AS VARCHAR)" for k in keys] + [f"'{seed}'"])
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"
