"""Signal operators on array columns, as higher-order functions that stay in the JVM.

An empty or null signal gives null (or the value stated).  Sums run over samples in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Segment counts of the partitioned entropy.
PARTITIONS = (2, 3, 5, 7, 11, 13, 17)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _double(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once for a row; what stands inside a lambda is computed anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mean(a: Column) -> Column:
    return _sum(_double(a)) / F.nullif(F.size(a), F.lit(0))


def pcm_to_float(a: Column, bits: int = 16, signed: bool = True) -> Column:
    """Integer samples to -1..1: signed by 2^(bits-1), unsigned around the middle."""
    half = float(1 << bits - 1)
    return F.transform(a, (lambda x: (x.cast("double") / half).cast("float")) if signed else (lambda x: ((x.cast("double") - half) / half).cast("float")))


def to_mono(channels: Column) -> Column:
    """Mean over an array of equally long channels."""
    total = F.aggregate(F.slice(channels, 2, F.greatest(F.size(channels) - 1, F.lit(0))), _double(F.element_at(channels, 1)), lambda s, c: F.zip_with(s, c, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.size(channels))


def remove_dc(a: Column) -> Column:
    return _once(a, lambda held: _once(mean(held), lambda m: F.transform(held, lambda x: x.cast("double") - m)))


def rms(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))) / F.nullif(F.size(a), F.lit(0)))


def peak(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))


def normalize_rms(a: Column, target_dbfs: float = -20.0, limit: float = 0.99) -> Column:
    """Scaled to the level; all of it again if its peak passes the limit; near-silence is unchanged."""

    def scaled(held: Column, level: Column) -> Column:
        gain = F.lit(10 ** (target_dbfs / 20)) / level
        top = peak(held) * gain
        factor = F.when(level < 1e-12, 1.0).when(top > limit, gain * F.lit(limit) / top).otherwise(gain)
        return _once(factor, lambda f: F.transform(held, lambda x: x.cast("double") * f))

    return _once(a, lambda held: _once(rms(held), lambda level: scaled(held, level)))


def center_crop_or_pad(a: Column, length: Column | int, pad: bool = False) -> Column:
    n, t = F.size(a), F.lit(length) if isinstance(length, int) else length
    crop = F.slice(a, F.floor((n - t) / 2).cast("int") + 1, t)
    if not pad:
        return F.when(n > t, crop).otherwise(a)
    left = F.floor((t - n) / 2).cast("int")
    zero = F.lit(0.0).cast("double")
    padded = F.concat(F.array_repeat(zero, left), _double(a), F.array_repeat(zero, (t - n - left).cast("int")))
    return F.when(n > t, _double(crop)).otherwise(padded)


def validation_error(a: Column, rate: Column) -> Column:
    """null if the signal is usable."""
    return (
        F.when(rate.isNull() | (rate <= 0), "sample rate must be positive")
        .when(a.isNull() | (F.size(a) == 0), "empty audio signal")
        .when(F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "non-finite samples")
    )


def duration(a: Column, rate: Column) -> Column:
    return F.when(rate > 0, F.size(a) / rate).otherwise(0.0)


def zero_crossings(a: Column) -> Column:
    """Changes of sign between neighbours (zero counts as positive)."""
    flips = F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: ((x < 0) != (y < 0)).cast("int"))
    return F.when(F.size(a) < 2, 0).otherwise(F.aggregate(flips, F.lit(0), lambda s, x: s + x))


def zero_crossing_rate(a: Column) -> Column:
    return zero_crossings(a) / F.greatest(F.size(a) - 1, F.lit(1))


def pre_emphasis(a: Column, factor: float = 0.97) -> Column:
    """y[0] = x[0], y[i] = x[i] - factor * x[i-1]."""
    d = _double(a)
    rest = F.zip_with(F.slice(d, 2, F.greatest(F.size(d) - 1, F.lit(0))), F.slice(d, 1, F.greatest(F.size(d) - 1, F.lit(0))), lambda x, before: x - factor * before)
    return F.when(F.size(d) < 2, d).otherwise(F.concat(F.slice(d, 1, 1), rest))


def _reached(values: Column, step: int) -> Column:
    """For step%, 2 * step%, ... of the sum of non-negative values, the 0-based index at which it is reached.

    One pass that carries the running sum and, for each share, how many positions stayed below it.
    """
    shares = [p / 100 for p in range(step, 100, step)]

    def counted(values: Column, goals: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("s"), F.array_repeat(F.lit(0), len(shares)).alias("n"))
        carried = F.aggregate(values, start, lambda t, x: F.struct((t["s"] + x).alias("s"), F.zip_with(t["n"], goals, lambda n, g: n + (t["s"] + x < g).cast("int")).alias("n")))
        return carried["n"]

    return _once(_sum(values), lambda total: _once(F.array(*[p * total for p in shares]), lambda goals: counted(values, goals)))


def energy_positions(a: Column, step: int = 10) -> Column:
    """For 10%, 20%, ... of the energy where it is reached, over n - 1; zeros for silence, nulls for no samples."""
    points = len(range(step, 100, step))

    def places(squares: Column) -> Column:
        last = F.greatest(F.size(squares) - 1, F.lit(1))
        return F.when(_sum(squares) > 0, F.transform(_reached(squares, step), lambda i: i / last)).otherwise(F.array_repeat(F.lit(0.0), points))

    found = _once(F.transform(a, lambda x: x.cast("double") * x.cast("double")), places)
    return F.when(F.size(a) > 0, found).otherwise(F.array_repeat(F.lit(None).cast("double"), points))


def crossing_positions(a: Column, step: int = 20) -> Column:
    """Where shares of the centred signal's sign changes are reached, over n - 1; zeros if there are none."""
    none = F.array_repeat(F.lit(0.0), len(range(step, 100, step)))

    def places(c: Column) -> Column:
        size = F.greatest(F.size(c) - 1, F.lit(0))
        flips = F.zip_with(F.slice(c, 1, size), F.slice(c, 2, size), lambda x, y: ((x < 0) != (y < 0)).cast("double"))
        last = F.greatest(size, F.lit(1))
        return _once(flips, lambda held: F.when(_sum(held) > 0, F.transform(_reached(held, step), lambda i: i / last)).otherwise(none))

    return F.when(F.size(a) > 1, _once(remove_dc(a), places)).otherwise(none)


def entropy(a: Column, bins: int = 64) -> Column:
    """Shannon entropy in bits of an equal-width histogram from least to greatest sample.

    A constant signal (all samples close to the first) has 0, an empty one null.
    """

    def of(d: Column, ends: Column) -> Column:
        lo, hi = ends["lo"], ends["hi"]
        first = F.get(d, F.lit(0))
        flat = ~F.exists(d, lambda x: F.abs(x - first) > F.lit(1e-8) + F.lit(1e-5) * F.abs(first))
        place = F.transform(d, lambda x: F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1).cast("long")))
        n = F.size(d).cast("double")

        def part(run: Column) -> Column:
            return run / n * F.log2(run / n)

        # Bins in order, so that one pass counts the runs of equal ones.
        start = F.struct(F.lit(-1).cast("long").alias("bin"), F.lit(0.0).alias("run"), F.lit(0.0).alias("bits"))

        def step(t: Column, p: Column) -> Column:
            same = p == t["bin"]
            done = F.when(~same & (t["run"] > 0), part(t["run"])).otherwise(0.0)
            return F.struct(p.alias("bin"), F.when(same, t["run"] + 1).otherwise(1.0).alias("run"), (t["bits"] - done).alias("bits"))

        bits = F.aggregate(F.array_sort(place), start, step, lambda t: t["bits"] - part(t["run"]))
        return F.when(F.size(d) > 0, F.when(flat, 0.0).otherwise(bits))

    return _once(_double(a), lambda d: _once(F.struct(F.array_min(d).alias("lo"), F.array_max(d).alias("hi")), lambda ends: of(d, ends)))


def segments(a: Column, parts: int) -> Column:
    """The signal cut in parts, the first n % parts of them one longer."""
    n = F.size(a)
    size, longer = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(a, i * size + F.least(i, longer) + 1, size + (i < longer).cast("int")))


def partitioned_entropy(a: Column, partitions=PARTITIONS, bins: int = 64) -> Column:
    """Entropies of the segments of each partitioning, over the greatest of that partitioning."""

    def relative(k: int) -> Column:
        own = F.transform(segments(a, k), lambda s: entropy(s, bins))
        return _once(own, lambda held: _once(F.array_max(held), lambda top: F.transform(held, lambda e: F.when(top > 0, e / top).otherwise(e))))

    out = [relative(k) for k in partitions]
    none = F.array_repeat(F.lit(None).cast("double"), sum(partitions))
    return F.when(F.size(a) > 0, F.concat(*out)).otherwise(none)


def strongest(pairs: Column, n: int = 30, least: float = 50.0, most: float | None = None) -> Column:
    """The n greatest magnitudes of array<struct<freq, amp>> inside the limits, in order of frequency, nulls to fill."""
    held = F.filter(pairs, lambda p: (p["freq"] >= least) & (F.lit(True) if most is None else p["freq"] <= most))
    ranked = F.slice(F.array_sort(F.transform(held, lambda p: F.struct((-p["amp"]).alias("k"), p["freq"].alias("freq"), p["amp"].alias("amp")))), 1, n)
    back = F.array_sort(F.transform(ranked, lambda p: F.struct(p["freq"].alias("freq"), p["amp"].alias("amp"))))
    fill = F.array_repeat(F.struct(F.lit(None).cast("double").alias("freq"), F.lit(None).cast("double").alias("amp")), (F.lit(n) - F.size(back)).cast("int"))
    return F.concat(back, fill)
