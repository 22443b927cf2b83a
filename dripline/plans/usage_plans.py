"""Named queries over usage events: grids, roll-ups, dashboard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dripline.functions import arrays as A, scalars as S
from dripline.operators import eda, evaluate, grid, quality, scan
from dripline.plans import inputs as I
from dripline.plans.catalog import hash01, query, with_ctes
from dripline.session import scratch_path
from dripline.sources import sinks, tables
from dripline.sources.tables import table, usage_events

KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "slot_grid",
    with_ctes(
        """SELECT pattern, person_id, date, slot, CAST(slot // 2 AS INTEGER) AS hour,
           CAST((slot % 2) * 30 AS INTEGER) AS minute, CAST(amount AS DOUBLE) AS amount FROM grid""",
        "grid",
    ),
)
def slot_grid(spark, base):
    return grid.dense_grid(I.slots(spark, base)).withColumn("amount", F.col("amount").cast("double"))


@query(
    "time_columns",
    """SELECT event_id, CAST(extract('hour' FROM ts) AS INTEGER) AS hour,
       CAST(extract('minute' FROM ts) // 30 * 30 AS INTEGER) AS minute,
       CAST(extract('hour' FROM ts) * 2 + extract('minute' FROM ts) // 30 AS INTEGER) AS slot,
       extract('hour' FROM ts) + (extract('minute' FROM ts) // 30 * 30) / 60.0 AS exact_hour,
       round(sin(2 * pi() * (extract('hour' FROM ts) * 60 + extract('minute' FROM ts) // 30 * 30) / 1440.0), 6) + 0.0 AS time_sin,
       round(cos(2 * pi() * (extract('hour' FROM ts) * 60 + extract('minute' FROM ts) // 30 * 30) / 1440.0), 6) + 0.0 AS time_cos,
       value > 0 AS is_usage,
       CAST(extract('day' FROM ts) AS VARCHAR) || '-' || CAST(extract('hour' FROM ts) AS VARCHAR) AS axis_label
       FROM events""",
)
def time_columns(spark, base):
    ev = usage_events(spark, base)
    h, m = S.slot_hour(F.col("slot")), S.slot_minute(F.col("slot"))
    return ev.select(
        "event_id",
        h.alias("hour"),
        m.alias("minute"),
        S.slot_index(h, m).alias("slot"),
        S.exact_hour(h, m).alias("exact_hour"),
        (F.round(S.time_sin(h, m), 6) + 0.0).alias("time_sin"),
        (F.round(S.time_cos(h, m), 6) + 0.0).alias("time_cos"),
        (F.col("amount") > 0).alias("is_usage"),
        F.concat_ws("-", F.dayofmonth("ts"), F.hour("ts")).alias("axis_label"),
    )


@query(
    "date_range_scan",
    """SELECT event_id, user_id AS person_id, CAST(ts AS DATE) AS date, value AS amount FROM events
       WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13' AND value > 0""",
)
def date_range_scan(spark, base):
    """Days 5 to 12; plain column comparisons, so both filters reach the Parquet reader."""
    ev = table(spark, base, "events")
    lo, hi = F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-13").cast("timestamp_ntz")
    return ev.filter((F.col("ts") >= lo) & (F.col("ts") < hi) & (F.col("value") > 0)).select(
        "event_id", F.col("user_id").alias("person_id"), F.to_date("ts").alias("date"), F.col("value").alias("amount")
    )


@query("day_vectors", with_ctes("SELECT pattern, person_id, date, slot, x AS amount FROM vecs", "vecs"))
def day_vectors(spark, base):
    vectors = grid.day_vectors(grid.dense_grid(I.slots(spark, base)))
    return grid.explode_vector(vectors, grid.DAY)


@query(
    "minmax_vectors",
    with_ctes(
        """SELECT pattern, person_id, date, slot, CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0.0 END AS amount
           FROM vecs""",
        "vecs",
    ),
)
def minmax_vectors(spark, base):
    v = grid.sparse_day_vectors(I.slots(spark, base)).withColumn("vec", A.minmax(F.col("vec")))
    return grid.explode_vector(v, grid.DAY)


@query(
    "cumulative_minmax",
    with_ctes(
        """SELECT pattern, person_id, date, slot,
           round(CASE WHEN MAX(c) OVER p > MIN(c) OVER p
                      THEN (c - MIN(c) OVER p) / (MAX(c) OVER p - MIN(c) OVER p) ELSE 0.0 END, 6) AS amount
           FROM (SELECT pattern, person_id, date, slot, SUM(x) OVER (PARTITION BY person_id, date ORDER BY slot) AS c FROM vecs)
           WINDOW p AS (PARTITION BY person_id, date)""",
        "vecs",
    ),
)
def cumulative_minmax(spark, base):
    v = grid.sparse_day_vectors(I.slots(spark, base)).withColumn("vec", A.cumulative_minmax(F.col("vec")))
    return grid.explode_vector(v, grid.DAY).withColumn("amount", F.round("amount", 6))


@query("five_day_shapes", with_ctes("SELECT pattern, person_id, block, slot, x AS amount FROM shapes", "shapes"))
def five_day_shapes(spark, base):
    return grid.explode_vector(I.shapes(spark, base), ["pattern", "person_id", "block"])


@query(
    "day_attributes",
    with_ctes(
        """SELECT g.pattern, g.person_id, g.date, g.slot, CAST(g.amount AS DOUBLE) AS amount, a.hours, a.n_hours
           FROM grid g JOIN (SELECT person_id, date, string_agg(CAST(h AS VARCHAR), ',' ORDER BY h) AS hours,
                                    CAST(COUNT(*) AS INTEGER) AS n_hours
                             FROM (SELECT DISTINCT person_id, date, CAST(extract('hour' FROM ts) AS INTEGER) AS h FROM ev)
                             GROUP BY person_id, date) a
           ON a.person_id = g.person_id AND a.date = g.date""",
        "ev", "grid",
    ),
)
def day_attributes(spark, base):
    """Lists that every slot row of a day repeats, taken from its first row and attached to the grid."""
    ev = usage_events(spark, base)
    rows = ev.count()
    dense = grid.dense_grid(grid.placed_by_day(grid.slot_sums(ev), rows))
    source = dense.select(*grid.DAY, "slot").join(grid.placed_by_day(grid.day_attributes(ev), rows), grid.DAY)
    out = grid.attach_day_attributes(dense, source, ["start_hours", "counts"])
    return out.select(
        *grid.DAY, "slot", F.col("amount").cast("double").alias("amount"),
        F.array_join("start_hours", ",").alias("hours"), F.size("counts").alias("n_hours"),
    )


@query(
    "hourly_counts",
    """WITH c AS (SELECT date_trunc('hour', ts) AS h, COUNT(*) AS n FROM events GROUP BY 1)
       SELECT CAST(extract('day' FROM s.h) AS VARCHAR) || '-' || CAST(extract('hour' FROM s.h) AS VARCHAR) AS label,
       CAST(s.h AS DATE) AS date, CAST(extract('hour' FROM s.h) AS INTEGER) AS hour, COALESCE(c.n, 0) AS n
       FROM (SELECT unnest(generate_series((SELECT MIN(h) FROM c), (SELECT MAX(h) FROM c), INTERVAL 1 HOUR)) AS h) s
       LEFT JOIN c ON c.h = s.h""",
)
def hourly_counts(spark, base):
    return eda.hourly_counts(usage_events(spark, base))


@query(
    "hourly_by_type",
    with_ctes(
        """SELECT date, hour, type, n, n / SUM(n) OVER (PARTITION BY date, hour) AS share
           FROM (SELECT date, CAST(extract('hour' FROM ts) AS INTEGER) AS hour, type, COUNT(*) AS n FROM ev GROUP BY ALL)""",
        "ev",
    ),
)
def hourly_by_type(spark, base):
    return eda.hourly_by_type(usage_events(spark, base))


@query(
    "hourly_by_type_person",
    with_ctes(
        """SELECT person_id, date, hour, type, n, n / SUM(n) OVER (PARTITION BY person_id, date, hour) AS share
           FROM (SELECT person_id, date, CAST(extract('hour' FROM ts) AS INTEGER) AS hour, type, COUNT(*) AS n
                 FROM ev GROUP BY ALL)""",
        "ev",
    ),
)
def hourly_by_type_person(spark, base):
    return eda.hourly_by_type(usage_events(spark, base), ["person_id"])


@query(
    "hourly_amount",
    with_ctes(
        """SELECT date, hour, CASE WHEN g = 1 THEN 'total' ELSE type END AS type, amount FROM (
           SELECT date, hour, type, grouping(type) AS g, CAST(SUM(amount) AS DOUBLE) AS amount
           FROM (SELECT *, CAST(extract('hour' FROM ts) AS INTEGER) AS hour FROM ev)
           GROUP BY GROUPING SETS ((date, hour), (date, hour, type)))""",
        "ev",
    ),
)
def hourly_amount(spark, base):
    return eda.hourly_amount(usage_events(spark, base))


@query("type_share", "SELECT event_type AS type, COUNT(*) AS n, COUNT(*) / SUM(COUNT(*)) OVER () AS share FROM events GROUP BY 1")
def type_share(spark, base):
    return eda.shares(usage_events(spark, base), "type")


_SIZED = {
    "sized": """SELECT *, CAST(CASE WHEN amount <= 120 THEN 120 WHEN amount <= 140 THEN 140 WHEN amount <= 260 THEN 260
                WHEN amount <= 500 THEN 500 ELSE 1000 END AS INTEGER) AS capacity FROM ev"""
}


@query(
    "capacity_share",
    with_ctes(
        "SELECT capacity, COUNT(*) AS n, COUNT(*) / SUM(COUNT(*)) OVER () AS share FROM sized GROUP BY capacity", "ev", extra=_SIZED
    ),
)
def capacity_share(spark, base):
    return eda.shares(I.sized_events(spark, base), "capacity")


@query(
    "combo_counts",
    with_ctes(
        """SELECT CAST(row_number() OVER (ORDER BY capacity, combined) AS INTEGER) AS rank, combined, n FROM (
           SELECT capacity, CAST(capacity AS VARCHAR) || ' - ' || type AS combined, COUNT(*) AS n FROM sized GROUP BY ALL)""",
        "ev",
        extra=_SIZED,
    ),
)
def combo_counts(spark, base):
    return eda.combination_counts(I.sized_events(spark, base))


@query(
    "person_type_pivot",
    with_ctes(
        "SELECT *, "
        + ", ".join(f"CASE WHEN total > 0 THEN {k} / total ELSE 0.0 END AS {k}_share" for k in KINDS)
        + " FROM (SELECT person_id, CAST(SUM(amount) AS DOUBLE) AS total, "
        + ", ".join(f"COALESCE(CAST(SUM(amount) FILTER (WHERE type = '{k}') AS DOUBLE), 0.0) AS {k}" for k in KINDS)
        + " FROM ev GROUP BY person_id)",
        "ev",
    ),
)
def person_type_pivot(spark, base):
    return eda.person_type_pivot(usage_events(spark, base), KINDS)


_GROUPS = """SELECT person_id, event_id, ts, date, type,
  CAST(SUM(CASE WHEN ts - prev > INTERVAL 1 MINUTE THEN 1 ELSE 0 END)
    OVER (PARTITION BY person_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp
  FROM (SELECT *, LAG(ts) OVER (PARTITION BY person_id ORDER BY ts, event_id) AS prev FROM ev)"""


@query("gap_groups", with_ctes(f"SELECT person_id, event_id, date, type, grp FROM ({_GROUPS})", "ev"))
def gap_groups(spark, base):
    return eda.gap_groups(usage_events(spark, base)).drop("ts")


@query(
    "gap_consistency",
    with_ctes(
        f"""SELECT consistent, COUNT(*) AS n FROM (SELECT person_id, grp, COUNT(DISTINCT type) = 1 AS consistent
            FROM ({_GROUPS}) GROUP BY person_id, grp) GROUP BY consistent""",
        "ev",
    ),
)
def gap_consistency(spark, base):
    return eda.group_consistency(eda.gap_groups(usage_events(spark, base)))


@query(
    "next_gap_minutes",
    """SELECT user_id AS person_id, event_id,
       (epoch_us(LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1000000.0 / 60 AS gap_min
       FROM events""",
)
def next_gap_minutes(spark, base):
    return eda.next_gap_minutes(usage_events(spark, base))


_PROFILE = """SELECT s48.slot, COALESCE(A, 0.0) AS A, COALESCE(B, 0.0) AS B, COALESCE(C, 0.0) AS C, COALESCE(D, 0.0) AS D
  FROM (SELECT DISTINCT slot FROM slots) s48 LEFT JOIN (
    SELECT slot, MAX(avg) FILTER (WHERE pattern = 'A') AS A, MAX(avg) FILTER (WHERE pattern = 'B') AS B,
           MAX(avg) FILTER (WHERE pattern = 'C') AS C, MAX(avg) FILTER (WHERE pattern = 'D') AS D
    FROM (SELECT pattern, slot, CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS avg FROM grid GROUP BY pattern, slot) GROUP BY slot) p
  ON p.slot = s48.slot"""


def _profile(spark, base):
    s = I.slots(spark, base)
    return eda.slot_profile(s, s.select(*grid.DAY).distinct(), tables.PATTERNS)


@query("slot_profile", with_ctes(_PROFILE, "grid"))
def slot_profile(spark, base):
    return _profile(spark, base)


@query("slot_profile_v2", with_ctes(f"SELECT slot, A, B, C FROM ({_PROFILE})", "grid"))
def slot_profile_v2(spark, base):
    return eda.project_versions(_profile(spark, base), "v2.0.0")


@query(
    "hourly_totals",
    with_ctes(
        "SELECT pattern, CAST(slot // 2 AS INTEGER) AS hour, CAST(SUM(amount) AS DOUBLE) AS usage FROM slots GROUP BY ALL", "slots"
    ),
)
def hourly_totals(spark, base):
    return eda.hourly_totals(I.slots(spark, base))


@query(
    "peak_bands",
    with_ctes(
        """SELECT band, CAST(SUM(amount) AS DOUBLE) AS usage, COUNT(DISTINCT person_id) AS users FROM (
           SELECT *, CASE WHEN h >= 6 AND h < 9 THEN 'morning' WHEN h >= 11 AND h < 14 THEN 'lunch'
                     WHEN h >= 17 AND h < 20 THEN 'evening' WHEN h >= 22 OR h < 5 THEN 'night' END AS band
           FROM (SELECT *, extract('hour' FROM ts) AS h FROM ev)) WHERE band IS NOT NULL GROUP BY band""",
        "ev",
    ),
)
def peak_bands(spark, base):
    return eda.peak_bands(usage_events(spark, base))


@query(
    "monthly_vs_baseline",
    with_ctes(
        """SELECT u.pattern, u.month, u.usage, b.baseline, u.usage - b.baseline AS delta FROM
           (SELECT pattern, strftime(date, '%Y-%m') AS month, CAST(SUM(amount) AS DOUBLE) AS usage FROM ev GROUP BY ALL) u
           LEFT JOIN (SELECT pattern, CAST(SUM(amount) AS DOUBLE) / COUNT(DISTINCT date) * 30 AS baseline FROM ev GROUP BY pattern) b
           ON b.pattern = u.pattern""",
        "ev",
    ),
)
def monthly_vs_baseline(spark, base):
    """Baseline: thirty times the pattern's mean daily amount."""
    ev = usage_events(spark, base)
    per_day = ev.groupBy("pattern", "date").agg(F.sum("amount").alias("a"))
    baseline = per_day.groupBy("pattern").agg((F.sum("a").cast("double") / F.count("*") * 30).alias("baseline"))
    return eda.monthly_vs_baseline(ev, baseline)


@query(
    "kpis",
    with_ctes(
        """SELECT COUNT(DISTINCT person_id) AS persons, COUNT(DISTINCT person_id // 2) AS devices,
           CAST(SUM(amount) AS DOUBLE) / COUNT(DISTINCT date) AS mean_daily FROM ev""",
        "ev",
    ),
)
def kpis(spark, base):
    """Two persons share a device."""
    return eda.kpis(usage_events(spark, base), F.floor(F.col("person_id") / 2))


@query(
    "accuracy_by_cluster",
    with_ctes(
        """SELECT CASE WHEN g = 1 THEN 'mean' ELSE cluster END AS cluster, round(AVG(personal), 6) AS personal, round(AVG(base), 6) AS base,
           round(AVG((personal + base) / 2), 6) AS average FROM (SELECT *, 0 AS g FROM per UNION ALL SELECT *, 1 AS g FROM per) GROUP BY 1""",
        "preds",
        extra={
            "per": """SELECT pattern AS cluster,
                AVG(CASE WHEN abs(actual - personal) / actual < 0.1 THEN 1.0 ELSE 0.0 END) * 100 AS personal,
                AVG(CASE WHEN abs(actual - base) / actual < 0.1 THEN 1.0 ELSE 0.0 END) * 100 AS base FROM preds GROUP BY pattern"""
        },
    ),
)
def accuracy_by_cluster(spark, base):
    preds = I.predictions(spark, base)
    scores = preds.groupBy(F.col("pattern").alias("cluster")).agg(
        evaluate.accuracy(F.col("actual"), F.col("personal")).alias("personal"),
        evaluate.accuracy(F.col("actual"), F.col("base")).alias("base"),
    )
    out = eda.accuracy_by_cluster(scores.withColumn("average", (F.col("personal") + F.col("base")) / 2), ["personal", "base", "average"])
    return out.select("cluster", *[F.round(c, 6).alias(c) for c in ("personal", "base", "average")])


@query(
    "status_counts",
    """SELECT COALESCE(status, 'all') AS status, COUNT(*) AS n FROM (SELECT CASE WHEN e = 0 THEN 'normal' WHEN e < 3 THEN 'check'
       ELSE 'fault' END AS status FROM (SELECT user_id // 2 AS device, COUNT(*) FILTER (WHERE event_type = 'error'
       AND ts >= TIMESTAMP '2024-01-26') AS e FROM events GROUP BY 1)) GROUP BY ROLLUP (status)""",
)
def status_counts(spark, base):
    """Device status from its error events of the last five days."""
    recent = (F.col("type") == "error") & (F.col("date") >= F.lit("2024-01-26").cast("date"))
    errors = usage_events(spark, base).groupBy(F.floor(F.col("person_id") / 2).alias("device")).agg(
        F.count_if(recent).alias("e")
    )
    status = F.when(F.col("e") == 0, "normal").when(F.col("e") < 3, "check").otherwise("fault")
    return eda.status_counts(errors.select(status.alias("status")))


@query(
    "success_counts",
    with_ctes(
        """SELECT pattern, CAST(SUM(CASE WHEN n >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS ok, COUNT(*) AS jobs
           FROM (SELECT pattern, person_id, COUNT(*) AS n FROM slots WHERE amount > 0 GROUP BY ALL) GROUP BY pattern""",
        "slots",
    ),
)
def success_counts(spark, base):
    """A person's training job succeeds with at least ten rows."""
    n = I.slots(spark, base).filter("amount > 0").groupBy("pattern", "person_id").agg(F.count("*").alias("n"))
    jobs = n.withColumn("status", F.when(F.col("n") >= 10, "success").otherwise("skipped"))
    return eda.success_counts(jobs, ["pattern"])


_SAMPLES = """SELECT 'VOICE_' || c_custkey AS id, 'HOME_' || c_nationkey AS family_id,
  CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender, CAST(c_custkey % 80 AS INTEGER) AS age,
  CAST(c_custkey % 31 + 70 AS DOUBLE) AS accuracy FROM customer"""


@query(
    "faceted_filter",
    f"""SELECT * FROM ({_SAMPLES}) WHERE (lower(id) LIKE '%ome_1%' OR lower(family_id) LIKE '%ome_1%')
        AND accuracy >= 80 AND accuracy < 90 AND gender = 'Female' AND age >= 20 AND age < 40""",
)
def faceted_filter(spark, base):
    return eda.facet_filter(I.voice_samples(spark, base), "OME_1", accuracy="80-90", gender="Female", age="20-39")


@query(
    "family_ids",
    f"SELECT family_id, MIN(id) AS first FROM ({_SAMPLES}) WHERE accuracy >= 90 GROUP BY family_id ORDER BY first",
)
def family_ids(spark, base):
    """Homes of the shown samples in the order in which they are first seen."""
    return eda.first_seen(eda.facet_filter(I.voice_samples(spark, base), accuracy="90+"), "family_id", "id")


@query(
    "facet_bands",
    f"""SELECT CASE WHEN accuracy >= 90 THEN '90+' WHEN accuracy >= 80 THEN '80-90' ELSE '<80' END AS accuracy_band,
        CASE WHEN age < 20 THEN '<20' WHEN age < 40 THEN '20-39' WHEN age < 60 THEN '40-59' ELSE '60+' END AS age_band,
        CAST(CASE WHEN lower(gender) LIKE 'm%' THEN 1 ELSE 0 END AS INTEGER) AS gender, COUNT(*) AS n
        FROM ({_SAMPLES}) GROUP BY 1, 2, 3""",
)
def facet_bands(spark, base):
    return (
        I.voice_samples(spark, base)
        .groupBy(
            eda.accuracy_band(F.col("accuracy")).alias("accuracy_band"),
            eda.age_band(F.col("age")).alias("age_band"),
            S.gender_flag(F.col("gender")).alias("gender"),
        )
        .agg(F.count("*").alias("n"))
    )


@query(
    "label_json",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS snr FROM events
       WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 5""",
)
def label_json(spark, base):
    """Signal level inside nested label JSON, with the noise gate (above 5 dB)."""
    ev = table(spark, base, "events")
    level = F.concat(F.from_json("props", "k string")["k"], F.lit("dB"))
    nested = F.to_json(F.struct(F.struct(level.alias("SignalToNoiseRatio")).alias("Wav")))
    return tables.parse_labels(ev.select("event_id", nested.alias("json"))).select("event_id", "snr").filter(F.col("snr") > 5)


@query(
    "list_parsing",
    """SELECT event_id, len(list) AS n, CAST(list_sum(list) AS BIGINT) AS total FROM (SELECT event_id,
       CAST('[' || json_extract_string(props, '$.k') || ', ' || user_id || ']' AS BIGINT[]) AS list FROM events)""",
)
def list_parsing(spark, base):
    """A list kept as text becomes an array."""
    ev = table(spark, base, "events")
    text = F.concat(F.lit("["), F.from_json("props", "k string")["k"], F.lit(", "), F.col("user_id").cast("string"), F.lit("]"))
    v = A.parse_int_list(text)
    return ev.select(
        "event_id", F.size(v).cast("long").alias("n"), F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x).alias("total")
    )


@query(
    "union_patterns",
    with_ctes(
        """SELECT pattern, COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) AS amount FROM (
           SELECT * FROM slots WHERE pattern = 'A' UNION ALL SELECT * FROM slots WHERE pattern = 'B'
           UNION ALL SELECT * FROM slots WHERE pattern = 'C' UNION ALL SELECT * FROM slots WHERE pattern = 'D') GROUP BY pattern""",
        "slots",
    ),
)
def union_patterns(spark, base):
    s = I.slots(spark, base)
    a, b, c, d = (s.filter(F.col("pattern") == p) for p in "ABCD")
    merged = a.unionByName(b).unionByName(c).unionByName(d)
    return merged.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


@query(
    "append_merge",
    with_ctes(
        """SELECT pattern, person_id, date, slot, CAST(amount AS DOUBLE) AS amount, MAX(extra) AS extra FROM (
           SELECT *, CAST(NULL AS VARCHAR) AS extra FROM slots WHERE date <= DATE '2024-01-20'
           UNION SELECT *, CAST(NULL AS VARCHAR) FROM slots WHERE date >= DATE '2024-01-10') GROUP BY ALL""",
        "slots",
    ),
)
def append_merge(spark, base):
    """Overlapping parts merge without duplicates; a column only one side has becomes null."""
    s = I.slots(spark, base)
    root = scratch_path(spark, "merged")
    sinks.append_merge(spark, root, s.filter("date <= '2024-01-20'").withColumn("extra", F.lit(None).cast("string")), ["person_id"])
    sinks.append_merge(spark, root, s.filter("date >= '2024-01-10'"), ["person_id"])
    return sinks.read_snapshot(spark, root).withColumn("amount", F.col("amount").cast("double"))


@query("pattern_table", with_ctes("SELECT DISTINCT pattern, person_id, date FROM slots", "slots"))
def pattern_table(spark, base):
    return sinks.pattern_table(I.slots(spark, base).select("pattern", "person_id", "date"))


@query(
    "distinct_counts",
    with_ctes(
        """SELECT DISTINCT person_id, hours FROM (SELECT person_id, date, string_agg(CAST(h AS VARCHAR), ',' ORDER BY h) AS hours
           FROM (SELECT DISTINCT person_id, date, CAST(extract('hour' FROM ts) AS INTEGER) AS h FROM ev) GROUP BY person_id, date)""",
        "ev",
    ),
)
def distinct_counts(spark, base):
    a = grid.day_attributes(usage_events(spark, base))
    return a.select("person_id", F.array_join("start_hours", ",").alias("hours")).distinct()


@query(
    "unused_slots",
    with_ctes(
        """SELECT p.person_id, s48.slot FROM (SELECT DISTINCT person_id FROM slots) p CROSS JOIN s48
           WHERE NOT EXISTS (SELECT 1 FROM slots s WHERE s.person_id = p.person_id AND s.slot = s48.slot)""",
        "slots", "s48",
    ),
)
def unused_slots(spark, base):
    """Slots a person never used (set difference)."""
    used = I.slots(spark, base).groupBy("person_id").agg(F.collect_set("slot").alias("u"))
    free = F.array_except(F.sequence(F.lit(0), F.lit(47)), F.col("u"))
    return used.select("person_id", F.explode(free).alias("slot"))


@query(
    "common_slots",
    with_ctes(
        """SELECT DISTINCT person_id, slot FROM slots WHERE date < DATE '2024-01-16'
           INTERSECT SELECT DISTINCT person_id, slot FROM slots WHERE date >= DATE '2024-01-16'""",
        "slots",
    ),
)
def common_slots(spark, base):
    """Slots used in both halves of the month (intersection)."""
    s = I.slots(spark, base)
    halves = [s.filter(c).select("person_id", "slot") for c in ("date < '2024-01-16'", "date >= '2024-01-16'")]
    return halves[0].intersect(halves[1])


@query(
    "unregistered_patterns",
    with_ctes(
        "SELECT DISTINCT pattern FROM ev WHERE pattern NOT IN (SELECT pattern FROM ev WHERE person_id % 4 < 2)", "ev"
    ),
)
def unregistered_patterns(spark, base):
    """Pattern names absent from the registry; the registry here lists the patterns of even device halves."""
    ev = usage_events(spark, base)
    registry = ev.filter(F.col("person_id") % 4 < 2).select("pattern").distinct()
    return sinks.unregistered(ev.select("pattern").distinct(), registry)


@query(
    "unprocessed_recordings",
    """SELECT vec_id, CAST(label AS BIGINT) AS user_id FROM embeddings WHERE vec_id NOT IN
       (SELECT vec_id FROM embeddings WHERE label < 5)""",
)
def unprocessed_recordings(spark, base):
    """Inputs not yet in the processed-keys table."""
    e = table(spark, base, "embeddings")
    done = e.filter("label < 5").select("vec_id")
    return tables.unprocessed(e.select("vec_id", F.col("label").cast("long").alias("user_id")), done, "vec_id")


@query(
    "version_keys",
    """SELECT user_id, CAST(user_id AS VARCHAR) || '_' || CASE user_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END
       || '_' || strftime(MAX(ts), '%Y%m%d') || '_v' || CAST(COUNT(*) AS VARCHAR) AS version_key,
       date_diff('day', CAST(MIN(ts) AS DATE), CAST(MAX(ts) AS DATE)) AS span FROM events GROUP BY user_id""",
)
def version_keys(spark, base):
    ev = usage_events(spark, base)
    last = ev.groupBy("person_id", "pattern").agg(F.max("date").alias("d"), F.min("date").alias("f"), F.count("*").alias("n"))
    return last.select(
        F.col("person_id").alias("user_id"),
        S.version_key(F.col("person_id"), F.col("pattern"), F.col("d"), F.col("n")).alias("version_key"),
        F.datediff("d", "f").cast("long").alias("span"),
    )


@query(
    "log_order",
    with_ctes(
        """SELECT person_id, event_id, CAST(row_number() OVER (PARTITION BY person_id, date ORDER BY ts DESC, event_id DESC) AS INTEGER) AS pos
           FROM ev""",
        "ev",
    ),
)
def log_order(spark, base):
    """Newest first within each person's day."""
    newest = [F.desc("ts"), F.desc("event_id")]
    rows = scan.pieces(usage_events(spark, base).withColumn("one", F.lit(1)), [F.col("person_id"), F.desc("date"), *newest])
    placed = scan.with_running(rows, ["person_id", "date"], newest, "one", "pos")
    return placed.select("person_id", "event_id", F.col("pos").cast("int").alias("pos"))


@query(
    "sorted_merge",
    with_ctes("SELECT person_id, COUNT(*) AS days FROM (SELECT DISTINCT person_id, date FROM slots) GROUP BY 1 ORDER BY 1", "slots"),
)
def sorted_merge(spark, base):
    s = I.slots(spark, base).select("person_id", "date").distinct()
    return s.groupBy("person_id").agg(F.count("*").alias("days")).orderBy("person_id")
