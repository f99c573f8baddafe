"""Kernels on one row's series, as Arrow functions: spectra, entropy, fluctuation, random convolution features."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def _floats(x) -> np.ndarray:
    out = np.asarray([] if x is None else x, float)
    return out[~np.isnan(out)]


def band_powers(x: np.ndarray, bands: dict[str, tuple[float, float]], longest: int = 120, least: int = 60) -> dict[str, float | None]:
    """Sums of Welch's spectral density within half-open bands of frequency, at one sample per unit of time.

    Segments of up to ``longest`` samples overlap by half; each loses its mean and gets a periodic Hann window.
    """
    if len(x) < least:
        return dict.fromkeys(bands)
    size = min(longest, len(x))
    window = np.hanning(size + 1)[:-1]
    starts = range(0, len(x) - size + 1, size - size // 2)
    segments = np.stack([x[s : s + size] for s in starts])
    spectrum = np.abs(np.fft.rfft((segments - segments.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2 / (window**2).sum()
    spectrum[:, 1 : -1 if size % 2 == 0 else None] *= 2
    density, freq = spectrum.mean(axis=0), np.fft.rfftfreq(size)
    return {name: float(density[(freq >= a) & (freq < b)].sum()) for name, (a, b) in bands.items()}


def sample_entropy(x: np.ndarray, m: int = 2, share: float = 0.2) -> float | None:
    """-ln of the share of pairs that match in ``m`` values (each within ``share`` population deviations) and match in m + 1.

    Pairs of length m count over all of its places, so one more than of length m + 1.
    """
    if len(x) < m + 2 or x.std() <= 0:
        return None
    near = np.abs(x[:, None] - x) <= share * x.std()

    def pairs(size: int) -> int:
        places = len(x) - size + 1
        match = np.ones((places, places), bool)
        for i in range(size):
            match &= near[i : i + places, i : i + places]
        return (int(match.sum()) - places) // 2

    b, a = pairs(m), pairs(m + 1)
    return float(-np.log(a / b)) if a and b else None


def fluctuation_exponent(x: np.ndarray, low: int = 4, high: int = 16, scales: int = 6) -> float | None:
    """Slope of log fluctuation against log scale after a linear detrending of each segment; needs 2 * ``high`` values and three scales."""
    if len(x) < 2 * high or x.std() <= 0:
        return None
    walk = np.cumsum(x - x.mean())
    points = []
    for n in np.unique(np.rint(np.geomspace(low, min(high, len(x) // 4), scales)).astype(int)):
        count = len(x) // n
        if n >= 2 and count >= 2:
            segments = walk[: count * n].reshape(count, n)
            t = np.arange(n) - (n - 1) / 2
            flat = segments - segments.mean(axis=1, keepdims=True)
            rest = flat - np.outer(flat @ t / (t @ t), t)
            points.append((n, np.sqrt((rest**2).mean(axis=1)).mean()))
    if len(points) < 3 or min(f for _, f in points) <= 0:
        return None
    n, f = np.log10(np.array(points)).T
    return float(((n - n.mean()) @ (f - f.mean())) / ((n - n.mean()) ** 2).sum())


def on_series(kernel: Callable[[np.ndarray], float | None], x: Column) -> Column:
    """A kernel of a series to a number, over an array column; null elements are left out."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([kernel(_floats(v)) for v in s], dtype="float64")

    y = run(x)
    return F.nanvl(y, F.lit(None).cast("double"))


def bands_of(x: Column, bands: dict[str, tuple[float, float]], **options) -> Column:
    """Struct of band powers."""
    schema = StructType([StructField(b, DoubleType()) for b in bands])

    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([band_powers(_floats(v), bands, **options) for v in s], columns=list(bands)).astype(float)

    return run(x)


#: The 84 kernels of the published MiniRocket method: nine weights, of which three are 2 and six are -1.
KERNELS = tuple(combinations(range(9), 3))


class RandomConvolutions:
    """MiniRocket features: share of positive values of dilated convolutions above biases drawn from training data.

    The kernels, exponential dilations, quantile biases and alternating padding follow the published description, and so do the
    channels of series that have several: each kernel and dilation gets a random subset, whose size is drawn on a logarithmic
    scale, and convolves their sum.
    """

    def __init__(self, sample: list[np.ndarray], features: int = 336, seed: int = 0) -> None:
        rng, other = np.random.default_rng(seed), np.random.default_rng([seed, 1])
        sample = [np.atleast_2d(x) for x in sample]
        length, channels = min(x.shape[1] for x in sample), len(sample[0])
        per = max(1, features // len(KERNELS))
        most = np.log2(max(1, (length - 1) / 8))
        dilations, counts = np.unique(np.floor(2 ** np.linspace(0, most, min(per, 32))).astype(int), return_counts=True)
        counts = np.maximum(1, counts * per // counts.sum())
        golden = (5**0.5 + 1) / 2
        self.plan = []
        for i, (d, n) in enumerate(zip(dilations.tolist(), counts.tolist(), strict=True)):
            for k in range(len(KERNELS)):
                size = int(2 ** other.uniform(0, np.log2(min(channels, 9) + 1)))
                chosen = np.sort(other.permutation(channels)[: max(1, size)])
                x = sample[rng.integers(len(sample))][chosen, :length].sum(axis=0)
                quantiles = (np.arange(1, n + 1) * golden) % 1
                self.plan.append((d, k, chosen, np.quantile(self._convolved(x, d, k), quantiles), (i + k) % 2 == 0))

    @staticmethod
    def _shifted(x: np.ndarray, d: int) -> list[np.ndarray]:
        """The nine shifts by multiples of ``d`` of each series, a row of ``x``, with zeros beyond its ends."""
        padded = np.concatenate([np.zeros((len(x), 4 * d)), x, np.zeros((len(x), 4 * d))], axis=1)
        return [padded[:, j * d : j * d + x.shape[1]] for j in range(9)]

    @classmethod
    def _convolved(cls, x: np.ndarray, d: int, k: int) -> np.ndarray:
        shifted = cls._shifted(x[None], d)
        return (3 * sum(shifted[j] for j in KERNELS[k]) - sum(shifted))[0]

    def _block(self, x: np.ndarray) -> np.ndarray:
        """Features of the series of one length, (series, channel, time)."""
        out, ready = [], {}
        for d, k, chosen, biases, padded in self.plan:
            key = (d, chosen.tobytes())
            if key not in ready:
                shifted = self._shifted(x[:, chosen].sum(axis=1), d)
                ready[key] = shifted, sum(shifted)
            shifted, total = ready[key]
            c = 3 * sum(shifted[j] for j in KERNELS[k]) - total
            c = c if padded or c.shape[1] <= 8 * d else c[:, 4 * d : -4 * d]
            out += [(c > b).mean(axis=1) for b in biases]
        return np.column_stack(out)

    def many(self, series: list[np.ndarray], block: int = 128) -> np.ndarray:
        """A row of features for each series; series of one shape go together."""
        series = [np.atleast_2d(x) for x in series]
        shapes: dict[tuple[int, ...], list[int]] = {}
        for i, x in enumerate(series):
            shapes.setdefault(x.shape, []).append(i)
        out = np.empty((len(series), sum(len(p[3]) for p in self.plan)))
        for places in shapes.values():
            for at in range(0, len(places), block):
                some = places[at : at + block]
                out[some] = self._block(np.stack([series[i] for i in some]))
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.many([x])[0]


def series_of(s: pd.Series) -> list[np.ndarray]:
    """Series as arrays, or arrays of channels."""
    return [np.stack([_floats(c) for c in v]) if v is not None and len(v) and isinstance(v[0], (list, np.ndarray)) else _floats(v) for v in s]


def convolved(x: Column, model: RandomConvolutions) -> Column:
    """Feature array of each series, an array or an array of channels."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(model.many(series_of(s))), dtype=object)

    return run(x)
