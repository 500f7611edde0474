"""Queries for signal operators on arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal as G
from ..views import SIGNAL_SQL, signals, table, vectors
from .registry import query, r6

X = "SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings"
LONG = "SELECT vec_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS v FROM ({})"
RMS = "sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x))"


def digest(c):
    """Sums that identify an array without comparing floats bit by bit."""
    weighted = F.aggregate(F.zip_with(c, F.sequence(F.lit(1), F.size(c)), lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v)
    return r6(weighted)


DIGEST = "round(list_sum(list_transform({}, lambda v, i: v * i)), 6)"


@query(f"SELECT vec_id, {DIGEST.format('y')} AS y FROM (SELECT vec_id, list_transform(x, lambda v, i: (v + x[len(x) + 1 - i]) / 2) AS y FROM ({X}))")
def g02_to_mono(spark, d):
    return vectors(spark, d).select("vec_id", digest(G.to_mono(F.array("x", F.reverse("x")))).alias("y"))


@query(f"SELECT vec_id, {DIGEST.format('list_transform(x, lambda v: v - m)')} AS y FROM (SELECT vec_id, x, list_avg(x) AS m FROM ({X}))")
def g03_remove_dc(spark, d):
    return vectors(spark, d).select("vec_id", digest(G.remove_dc(F.col("x"))).alias("y"))


@query(f"""SELECT vec_id, {DIGEST.format('list_transform(x, lambda v: v * f)')} AS y FROM (SELECT vec_id, x, CASE WHEN r < 1e-12 THEN 1.0 WHEN p * 0.5 / r > 0.99 THEN 0.99 / p ELSE 0.5 / r END AS f
    FROM (SELECT vec_id, x, {RMS} AS r, list_max(list_transform(x, lambda v: abs(v))) AS p FROM ({X})))""")
def g04_normalize_rms(spark, d):
    import math

    return vectors(spark, d).select("vec_id", digest(G.normalize_rms(F.col("x"), 20 * math.log10(0.5))).alias("y"))


@query(f"""SELECT vec_id, {DIGEST.format('list_slice(x, 17, 48)')} AS cropped, {DIGEST.format('list_concat(list_concat(list_transform(range(0, 8), lambda i: 0.0::DOUBLE), x), list_transform(range(0, 8), lambda i: 0.0::DOUBLE))')} AS padded FROM ({X})""")
def g06_crop_or_pad(spark, d):
    return vectors(spark, d).select("vec_id", digest(G.center_crop_or_pad(F.col("x"), 32)).alias("cropped"), digest(G.center_crop_or_pad(F.col("x"), 80, pad=True)).alias("padded"))


@query("SELECT vec_id, CASE WHEN label = 0 THEN 'sample rate must be positive' WHEN label = 1 THEN 'empty audio signal' END AS error FROM embeddings")
def g07_validate(spark, d):
    e = table(spark, d, "embeddings")
    x = F.when(F.col("label") == 1, F.slice("embedding", 1, 0)).otherwise(F.col("embedding"))
    return e.select("vec_id", G.validation_error(x, F.col("label").cast("double")).alias("error"))


@query(f"SELECT vec_id, len(x)::BIGINT AS n_samples, len(x) / 16.0::DOUBLE AS duration, round({RMS}, 6) AS rms, list_max(list_transform(x, lambda v: abs(v))) AS peak, 'ok' AS status FROM ({X})")
def g08_profile(spark, d):
    x = F.col("x")
    return vectors(spark, d).select("vec_id", F.size(x).cast("long").alias("n_samples"), G.duration(x, F.lit(16.0)).alias("duration"), r6(G.rms(x)).alias("rms"), G.peak(x).alias("peak"), F.lit("ok").alias("status"))


@query(f"""SELECT user_id, {', '.join(f'round(min(pos) FILTER (run >= {p} * total) / greatest(max(n) - 1, 1)::DOUBLE, 6) AS p{int(p * 100)}' for p in (0.1, 0.5, 0.9))}
    FROM (SELECT user_id, pos, sum(v * v) OVER (PARTITION BY user_id ORDER BY pos) AS run, sum(v * v) OVER (PARTITION BY user_id) AS total, count(*) OVER (PARTITION BY user_id) AS n FROM ({SIGNAL_SQL})) GROUP BY 1""")
def g09_energy_positions(spark, d):
    p = G.energy_positions(F.col("x"))
    return signals(spark, d).select("user_id", p.alias("p")).select("user_id", *[r6(F.col("p")[i]).alias(f"p{(i + 1) * 10}") for i in (0, 4, 8)])


ENTROPY = """SELECT {key}, round(CASE WHEN bool_or(far) THEN -sum(n / t * log2(n / t)) ELSE 0 END, {digits}) AS entropy FROM (
      SELECT {key}, least(floor((v - lo) / nullif(hi - lo, 0) * 64), 63) AS b, count(*)::DOUBLE AS n, any_value(t) AS t, bool_or(abs(v - v0) > 1e-8 + 1e-5 * abs(v0)) AS far FROM (
        SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi, count(*) OVER w AS t, first_value(v) OVER (PARTITION BY {key} ORDER BY pos) AS v0 FROM ({rows}) WINDOW w AS (PARTITION BY {key})) GROUP BY {key}, b) GROUP BY {key}"""


@query(ENTROPY.format(key="user_id", rows=SIGNAL_SQL, digits=6))
def g10_entropy(spark, d):
    return signals(spark, d).select("user_id", r6(G.entropy(F.col("x"))).alias("entropy"))


def part(k: int) -> str:
    """Number of the part (from 0) that a position lies in, when the first n % k parts are one longer."""
    return f"CASE WHEN pos < (n % {k}) * (n // {k} + 1) THEN pos // (n // {k} + 1) ELSE (n % {k}) + (pos - (n % {k}) * (n // {k} + 1)) // (n // {k}) END"


@query(f"""SELECT user_id, seg, round(entropy / nullif(max(entropy) OVER (PARTITION BY user_id), 0), 6) AS ratio FROM (
      SELECT user_id, CAST(split_part(k, ':', 2) AS BIGINT) AS seg, entropy FROM ({ENTROPY.format(key='k', digits=14, rows=f"SELECT user_id || ':' || ({part(5)}) AS k, pos, v FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ({SIGNAL_SQL}))")}),
      LATERAL (SELECT CAST(split_part(k, ':', 1) AS BIGINT) AS user_id))""")
def g11_partitioned_entropy(spark, d):
    e = G.partitioned_entropy(F.col("x"), (5,))
    return signals(spark, d).select("user_id", F.posexplode(e).alias("seg", "ratio")).select("user_id", F.col("seg").cast("long").alias("seg"), r6("ratio").alias("ratio"))


@query(f"SELECT vec_id, count(*) FILTER ((v < 0) <> (before < 0)) AS crossings, round(count(*) FILTER ((v < 0) <> (before < 0)) / (count(*) - 1)::DOUBLE, 6) AS rate FROM (SELECT *, lag(v) OVER (PARTITION BY vec_id ORDER BY pos) AS before FROM ({LONG.format(X)})) GROUP BY 1")
def g12_zero_crossings(spark, d):
    return vectors(spark, d).select("vec_id", G.zero_crossings(F.col("x")).cast("long").alias("crossings"), r6(G.zero_crossing_rate(F.col("x"))).alias("rate"))


@query(f"""SELECT vec_id, {', '.join(f'round(min(i) FILTER (run >= {p} * total) / 63.0::DOUBLE, 6) AS p{int(p * 100)}' for p in (0.2, 0.8))} FROM (
      SELECT vec_id, pos - 1 AS i, sum(f) OVER (PARTITION BY vec_id ORDER BY pos) AS run, sum(f) OVER (PARTITION BY vec_id) AS total FROM (
        SELECT vec_id, pos, CAST((c < 0) <> (lag(c) OVER (PARTITION BY vec_id ORDER BY pos) < 0) AS INT) AS f FROM (SELECT vec_id, pos, v - avg(v) OVER (PARTITION BY vec_id) AS c FROM ({LONG.format(X)}))) WHERE pos > 0) GROUP BY 1""")
def g13_crossing_positions(spark, d):
    return vectors(spark, d).select("vec_id", G.crossing_positions(F.col("x")).alias("p")).select("vec_id", r6(F.col("p")[0]).alias("p20"), r6(F.col("p")[3]).alias("p80"))
