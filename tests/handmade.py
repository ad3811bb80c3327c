"""Hand-made demand series and step-by-step second opinions on the forecasts."""

import numpy as np


def _wave(n, base=20.0):
    return [base + 10 * np.sin(2 * np.pi * t / 12) + 0.3 * t for t in range(n)]


def _rare(n, seed):
    rng = np.random.default_rng(seed)
    return [float(rng.integers(1, 40)) if rng.random() < 0.2 else 0.0 for _ in range(n)]


SERIES = {
    "zero": [0.0] * 30,
    "one_late": [0.0] * 20 + [7.0] + [0.0] * 9,
    "one_first": [9.0] + [0.0] * 29,
    "alternating": [0.0, 5.0] * 18,
    "flat": [12.0] * 36,
    "up": [2.0 + 1.5 * t for t in range(40)],
    "down": [100.0 - 2.0 * t for t in range(40)],
    "seasonal": [float(5 + (t % 12) * 3) for t in range(48)],
    "negatives": [(-3.0 if t % 5 == 0 else 4.0 + t % 3) for t in range(30)],
    "small_negatives": [(-0.5 if t % 7 == 0 else 4.0 + t % 3) for t in range(31)],
    "collapse": [50.0] * 24 + [1.0] * 6,
    "boom": [float(3 * 1.08**t) for t in range(47)],
    "n11": [3.0, 0, 4, 0, 0, 5, 1, 0, 2, 0, 6],
    "n12": [3.0, 0, 4, 0, 0, 5, 1, 0, 2, 0, 6, 1],
    "n23": _rare(23, 1),
    "n24": _rare(24, 2),
    "n31": _rare(31, 3),
    "n48": _rare(48, 4),
    "wave": _wave(60),
    "rare": _rare(77, 5),
}


def smooth(start, xs, a):
    for x in xs:
        start = a * x + (1 - a) * start
    return start


def recent3(v):
    return (np.mean(v[-3:]) - np.mean(v[-6:-3])) / 3 if len(v) >= 6 else 0.0


def volatility(v):
    return np.std(v[-12:]) / (np.mean(v[-12:]) + 1)


def season(v):
    if len(v) < 24:
        return np.ones(12)
    positive = [x for x in v if x > 0]
    overall = np.mean(positive) if positive else 1.0
    raw = []
    for p in range(12):
        own = [x for x in v[p::12] if x > 0]
        raw.append(np.mean(own) / overall if own else 1.0)
    padded = [0.0, *raw, 0.0]
    sm = np.array([sum(padded[i : i + 3]) / 3 for i in range(12)])
    return sm / sm.mean()


def opinions(values, horizon):
    """Method -> forecast, each written from its definition."""
    v = np.array(values, dtype=float)
    n, h = len(v), np.arange(1, horizon + 1)
    hits = [t for t in range(n) if v[t] > 0]
    zeros = np.zeros(horizon)
    idx = season(v)[(h - 1) % 12]
    out = {}
    if hits:
        gaps, sizes, previous = [], [], 0
        for t in hits:
            if t > 0:
                gaps.append(t - previous)
                sizes.append(v[t])
            previous = t
        size = smooth(v[hits].mean(), sizes, 0.25)
        gap = smooth(n / len(hits), gaps, 0.25)
        prob = smooth(len(hits) / n, [float(x > 0) for x in v[1:]], 0.15)
        rate = size / max(1, gap)
        out["croston"] = np.maximum(rate + 0.3 * h * recent3(v), 0)
        out["sba"] = np.maximum(rate * 0.875 * idx, 0)
        calm = 0.9 if n >= 12 and volatility(v) > 0.5 else 1.0
        out["tsb"] = np.maximum(zeros + prob * size * calm, 0)
    else:
        out |= {m: zeros for m in ("croston", "sba", "tsb")}
    means = []
    for width in (1, 2, 3, 4) if n >= 12 else (1, 2):
        sums = [sum(v[i : i + width]) for i in range(0, n - width + 1, width)]
        if len(sums) >= 2:
            means.append(np.mean(sums[-3:]) / width)
    out["adida"] = zeros + max(np.mean(means), 0)
    alpha = 0.3 + 0.2 * np.exp(-volatility(v)) if n >= 12 else 0.35
    level = smooth(v[0], v[1:], alpha)
    drift = min(max(recent3(v), -0.15 * level), 0.15 * level) if n >= 6 else 0.0
    es = out["exp_smoothing"] = np.maximum(level + drift * h, 0)
    w = min(max(3, n // 4), 12)
    weights = np.exp(np.linspace(-3, 0, w))
    level = float(v[-w:] @ weights / weights.sum())
    drift = (v[-w:].mean() - v[-2 * w : -w].mean()) / w if n >= 2 * w else 0.0
    drift = min(max(drift, -0.1 * level), 0.15 * level)
    out["weighted_ma"] = np.maximum((level + drift * h) * idx, 0)
    out["ma_benchmark"] = zeros + max(np.mean(v[-3:]), 0)
    if v.min() <= -1:
        out["exponential_trend"] = es
    else:
        slope, start = np.polyfit(np.arange(n), np.log(v + 1), 1, w=np.exp(np.linspace(-1, 0, n)))
        grown = np.exp(start + slope * (n - 1 + h)) - 1
        grown = np.minimum(grown, v[-12:].mean() * (1.5 + np.exp(-0.5 * volatility(v))))
        damp = np.exp(-0.05 * (h - 1))
        out["exponential_trend"] = np.maximum(grown * damp + v.mean() * (1 - damp), 0)
    slope, start = np.polyfit(np.arange(n), v, 1)
    if (v[-12:].mean() - v[:12].mean()) / (v[:12].mean() + 1) < -0.3:
        slope, start = 0.0, v.mean()
    rest = v - (start + slope * np.arange(n))
    steps = n - 1 + h
    shift = np.array([rest[s % 12 :: 12].mean() for s in steps]) if n >= 24 else 0.0
    out["prophet"] = np.maximum(start + slope * steps + shift, 0)
    out["intelligent_growth"] = growth_path(v, out, horizon)
    return out


def growth_path(v, out, horizon):
    years = [v[i : i + 12].sum() for i in range(0, len(v) - 11, 12)]
    if len(years) < 2:
        return out["exp_smoothing"]
    rates = [(b - a) / a for a, b in zip(years, years[1:]) if a > 0]
    g = float(np.average(rates, weights=np.arange(1, len(rates) + 1))) if rates else 0.0
    if g > 0.15:
        first = years[-1] * (1 + np.clip(g, 0.03, 0.40))
    elif g < -0.15:
        first = years[-1] * (1 + max(g, -0.10))
    else:
        first = years[-1] * (1 + np.clip(g, -0.03, 0.08))
    path = 0.5 * out["croston"] + 0.3 * out["sba"] + 0.2 * out["tsb"]
    last = v[-12:]
    shape = last / last.mean() if last.mean() > 0 else np.ones(12)
    for lo, hi, target in ((0, min(12, horizon), first), (12, min(24, horizon), first * (1 + 0.75 * g))):
        total = path[lo:hi].sum()
        if hi > lo and total > 0 and (target == 0 or abs(total - target) / target > 0.35):
            path[lo:hi] = target / (hi - lo) * shape[: hi - lo]
    return np.maximum(path, 0)


def pull_to_median(paths, weights, fallback):
    good = {m: p for m, p in paths.items() if np.std(p) >= 1e-6}
    if not good:
        return fallback
    w = np.array([weights[m] for m in good])
    stack = np.array(list(good.values()))
    mean, median = w @ stack / w.sum(), np.median(stack, axis=0)
    mad = np.median(abs(stack - median), axis=0)
    pull = np.minimum(abs(mean - median) / (3 * mad + 1e-6), 1)
    return np.maximum(mean * (1 - pull) + median * pull, 0)
