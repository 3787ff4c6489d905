"""Functions on signals (arrays of samples), Column to Column, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

PEAK = 0.95


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, F.abs))


def mean_abs(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))) / F.size(samples)


def peak_normalize(samples: Column, to: float = PEAK) -> Column:
    """Scaled so that the largest magnitude is ``to``; all-zero signals stay."""
    top = peak(samples).cast("double")
    return F.when(top > 0, F.transform(samples, lambda x: x.cast("double") / top * to)).otherwise(F.transform(samples, lambda x: x.cast("double")))


def fade_out(samples: Column, rate: Column, seconds: float = 0.05) -> Column:
    """The last samples fall to zero on a straight line, if the signal is longer than the fade."""
    n, k = F.size(samples), (rate * seconds).cast("int")
    ramp = lambda i: F.when(k > 1, 1 - (i - (n - k)) / (k - 1)).otherwise(F.lit(1.0))
    return F.when((k > 0) & (n > k), F.transform(samples, lambda x, i: F.when(i >= n - k, x.cast("double") * ramp(i)).otherwise(x.cast("double")))).otherwise(F.transform(samples, lambda x: x.cast("double")))


def quantize_int16(samples: Column) -> Column:
    return F.transform(samples, lambda x: (x.cast("double") * 32767).cast("smallint"))


def duration_s(samples: Column, rate: Column) -> Column:
    return F.size(samples) / rate


def artifact_flag(samples: Column, rate: Column, text: Column, per_char: float = 0.08, factor: float = 2.5, quiet: float = 0.01) -> Column:
    """Much longer than its text should take, or next to silent."""
    return (duration_s(samples, rate) > F.length(text) * per_char * factor) | (peak(samples) < quiet)


def trim_quiet_tail(samples: Column, rate: Column) -> Column:
    """Without the last tenth, if that is much quieter than the second before it; signals under two
    seconds stay."""
    n = F.size(samples)
    cut = (n * 0.9).cast("int")
    main, tail = F.slice(samples, F.lit(1), cut), F.slice(samples, cut + 1, n)
    second = F.slice(main, F.greatest(cut - rate + 1, F.lit(1)), rate)
    return F.when((n >= rate * 2) & (mean_abs(tail) < mean_abs(second) * 0.1), main).otherwise(samples)


def trim_silence(samples: Column, threshold: float = 0.01) -> Column:
    """Without leading and trailing samples up to the threshold; all-silent signals stay."""
    loud = F.transform(samples, lambda x: (F.abs(x) > threshold))
    first, last = F.array_position(loud, True), F.array_position(F.reverse(loud), True)
    return F.when(first > 0, F.slice(samples, first.cast("int"), (F.size(samples) - first - last + 2).cast("int"))).otherwise(samples)


def resample_linear(samples: Column, speed: float) -> Column:
    """Faster by ``speed``: linear interpolation between samples, half-pixel centres."""
    n = F.size(samples)
    to = (n / F.lit(float(speed))).cast("int")

    def at(i: Column) -> Column:
        place = F.greatest((i + 0.5) * n / to - 0.5, F.lit(0.0))
        low = F.floor(place).cast("int")
        high = F.least(low + 1, n - 1)
        part = place - low
        return F.get(samples, low).cast("double") * (1 - part) + F.get(samples, high).cast("double") * part

    return F.when((to > 0) & (F.lit(speed) != 1.0), F.transform(F.sequence(F.lit(0), to - 1), at)).otherwise(F.transform(samples, lambda x: x.cast("double")))


def silence(rate: Column, seconds: Column) -> Column:
    return F.array_repeat(F.lit(0.0), (seconds * rate).cast("int"))


def concat_with_gaps(parts: DataFrame, by: str, order: str, samples: str = "samples", rate: str = "rate", gap: Column | None = None) -> DataFrame:
    """Parts of each series laid end to end with silence between: ``parts`` with ``samples`` (as doubles,
    but for the last part with the gap behind them) and ``offset``, the samples before. A part stays a
    row, so a long series is never one array; samples in order of ``order`` are the series."""
    w = W.partitionBy(by).orderBy(order)
    last = F.lead(order).over(w).isNull()
    behind = F.when(last, F.array().cast("array<double>")).otherwise(silence(F.col(rate), F.lit(0.3) if gap is None else gap))
    laid = parts.withColumn(samples, F.concat(F.transform(samples, lambda x: x.cast("double")), behind))
    before = F.sum(F.size(samples).cast("bigint")).over(w.rowsBetween(W.unboundedPreceding, -1))
    return laid.withColumn("offset", F.coalesce(before, F.lit(0)))
