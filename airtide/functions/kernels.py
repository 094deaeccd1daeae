"""Sequential signal and image kernels in NumPy, called once for each series or image."""

from __future__ import annotations

import heapq

import numpy as np


def butterworth(kind: str, cutoff: float | tuple[float, float], order: int, rate: float) -> np.ndarray:
    """Second-order sections (b0, b1, b2, 1, a1, a2) of a digital Butterworth filter.

    ``kind``: lowpass, highpass, bandpass or bandstop. The analog prototype is warped, transformed and mapped bilinearly.
    """
    edges = np.atleast_1d(np.asarray(cutoff, dtype=float))
    if kind not in ("lowpass", "highpass", "bandpass", "bandstop") or len(edges) != (2 if kind.startswith("band") else 1):
        raise ValueError("the filter type or its cutoff frequencies are wrong")
    if not 1 <= order or (edges <= 0).any() or (edges >= rate / 2).any() or (len(edges) == 2 and edges[0] >= edges[1]):
        raise ValueError("order and cutoff frequencies must be positive, ascending and below half the sample frequency")
    poles = -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))
    w = 4 * np.tan(np.pi * edges / rate)
    if kind == "lowpass":
        p, z, gain = poles * w[0], np.array([]), w[0] ** order
    elif kind == "highpass":
        p, z, gain = w[0] / poles, np.zeros(order), 1.0
    else:
        width, centre = w[1] - w[0], np.sqrt(w[0] * w[1])
        q = poles * width / 2 if kind == "bandpass" else width / 2 / poles
        root = np.sqrt(q**2 - centre**2 + 0j)
        p = np.concatenate([q + root, q - root])
        z, gain = (np.zeros(order), width**order) if kind == "bandpass" else (np.concatenate([np.full(order, 1j * centre), np.full(order, -1j * centre)]), 1.0)
    gain = float(np.real(gain * np.prod(4 - z) / np.prod(4 - p)))
    p = (4 + p) / (4 - p)
    z = np.concatenate([(4 + z) / (4 - z), np.full(len(p) - len(z), -1.0)])
    sections = []
    up = p[p.imag > 1e-12]
    real = np.sort(p[np.abs(p.imag) <= 1e-12].real)
    pairs = [np.poly([x, np.conj(x)]).real for x in up] + [np.poly(real[k : k + 2]) for k in range(0, len(real), 2)]
    pairs.sort(key=lambda a: abs(a[-1]) if len(a) == 3 else abs(a[1]) ** 2)
    level = np.sort(z[np.abs(z.imag) <= 1e-12].real)  # paired from both ends
    zeros = [np.poly([x, np.conj(x)]).real for x in z[z.imag > 1e-12]]
    zeros += [np.poly(level[[k, -1 - k]] if 2 * k + 1 < len(level) else level[[k]]) for k in range((len(level) + 1) // 2)]
    for a, b in zip(pairs, zeros):
        a, b = np.pad(a, (0, 3 - len(a))), np.pad(b, (0, 3 - len(b)))
        sections.append(np.concatenate([b, a]))
    out = np.array(sections)
    out[0, :3] *= gain
    return out


#: Samples that a section filters in one product of matrices.
BLOCK = 64


def _sections(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Run the sections over the rows of x (series, samples), block by block: outputs and the next state are linear in a block and its state."""
    n = x.shape[1]
    y = np.pad(x, ((0, 0), (0, -n % BLOCK)))
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        move, push = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
        powers = [np.eye(2)]
        for _ in range(BLOCK):
            powers.append(powers[-1] @ move)
        answer = np.array([b0] + [(powers[i] @ push)[0] for i in range(BLOCK - 1)])
        i, j = np.indices((BLOCK, BLOCK))
        own = np.where(i >= j, answer[np.maximum(i - j, 0)], 0.0)
        held = np.array([p[0] for p in powers[:BLOCK]])
        into = np.array([powers[BLOCK - 1 - i] @ push for i in range(BLOCK)])
        s = np.broadcast_to(state[k].T, (y.shape[0], 2))
        for at in range(0, y.shape[1], BLOCK):
            part = y[:, at : at + BLOCK].copy()
            y[:, at : at + BLOCK] = part @ own.T + s @ held.T
            s = s @ powers[BLOCK].T + part @ into
    return y[:, :n]


def at_rest(sos: np.ndarray) -> np.ndarray:
    """(section, 2) states of sections that a constant 1 has gone through for ever."""
    rest, scale = [], 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        matrix = np.array([[1 + a1, -1.0], [a2, 1.0]])
        rest.append(np.linalg.solve(matrix, [b1 - a1 * b0, b2 - a2 * b0]) * scale)
        scale *= (b0 + b1 + b2) / (1 + a1 + a2)
    return np.array(rest)


def padding(sos: np.ndarray) -> int:
    """Samples by which a series is extended at either end."""
    return 3 * (2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum())))


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over the last axis, odd extension at the ends, sections in their steady state at first."""
    if np.isnan(x).any():
        raise ValueError("missing values cannot be filtered")
    flat, pad = np.atleast_2d(x.reshape(-1, x.shape[-1])), padding(sos)
    if flat.shape[1] <= pad:
        raise ValueError(f"a series of more than {pad} samples is needed")
    wide = np.concatenate([2 * flat[:, :1] - flat[:, pad:0:-1], flat, 2 * flat[:, -1:] - flat[:, -2 : -pad - 2 : -1]], axis=1)
    zi = at_rest(sos)[:, :, None]
    y = _sections(sos, wide, zi * wide[:, 0])
    y = _sections(sos, y[:, ::-1].copy(), zi * y[:, -1])[:, ::-1]
    return y[:, pad:-pad].reshape(x.shape)


def welch(x: np.ndarray, rate: float, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power of the last axis: Hann windows, mean of each segment removed."""
    step = size - overlap
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = [x[..., k : k + size] for k in range(0, x.shape[-1] - size + 1, step)]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean(axis=-1, keepdims=True)) * window)) ** 2 for p in parts], axis=0) / (rate * (window**2).sum())
    power[..., 1 : None if size % 2 else -1] *= 2
    return np.fft.rfftfreq(size, 1 / rate), power


def refined_peak(freq: np.ndarray, power: np.ndarray, low: float, high: float) -> float:
    """Frequency of the largest power in [low, high], by a parabola unless it is at the range's edge."""
    inside = np.flatnonzero((freq >= low) & (freq <= high))
    k = inside[np.argmax(power[inside])]
    if k in (inside[0], inside[-1]):
        return float(freq[k])
    a, b, c = power[k - 1 : k + 2]
    bend = a - 2 * b + c
    return float(freq[k] + (freq[1] - freq[0]) * (0.5 * (a - c) / bend if bend else 0.0))


def prominent(c: np.ndarray, height: float, least: float) -> list[int]:
    """Peaks not below a height with at least this prominence; a flat top counts at its middle.

    A peak's prominence is its height over the higher of the two lowest values that lie between it and, on either side,
    the next higher value or the end.
    """
    edges = np.flatnonzero(np.diff(c) != 0)
    first, last = np.append(0, edges + 1), np.append(edges, len(c) - 1)  # runs of equal values
    v = c[first]
    found = []
    for r in range(1, len(v) - 1):
        if v[r] <= v[r - 1] or v[r] <= v[r + 1] or v[r] < height:
            continue
        left, right = v[:r][::-1], v[r + 1 :]
        lows = [side[: int(np.argmax(side > v[r])) if (side > v[r]).any() else len(side)].min() for side in (left, right)]
        if v[r] - max(lows) >= least:
            found.append(int(first[r] + last[r]) // 2)
    return found


def phase_lag(a: np.ndarray, b: np.ndarray, reach: float) -> int | None:
    """How much later series a is than b, from the peak of their correlation nearest to 0 within ``reach``; None without one.

    Peaks are as prominent as the deviation of the whole correlation; of two as near the higher one counts, and then the later.
    """
    t = np.arange(len(a))
    a, b = (v - np.polyval(np.polyfit(t, v, 1), t) for v in (a, b))
    n = len(a)
    size = 1 << (2 * n - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)
    lags = np.arange(-((n - 1) // 2), n // 2 + 1)  # the middle n lags
    c = full[lags]
    near = np.abs(lags) <= reach
    top = prominent(c[near], 0.0, float(c.std()))
    if not top:
        return None
    inside, values = lags[near], c[near]
    return int(inside[min(top, key=lambda k: (abs(inside[k]), -values[k], -inside[k]))])


def watershed(image: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Flood from markers, highest values first, over neighbours of four; every pixel gets the number of a marker."""
    out = markers.copy()
    heap = [(-image[p], k, p) for k, p in enumerate(map(tuple, np.argwhere(markers)))]
    heapq.heapify(heap)
    age = len(heap)
    while heap:
        _, _, (r, c) = heapq.heappop(heap)
        for y, x in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
            if 0 <= y < image.shape[0] and 0 <= x < image.shape[1] and not out[y, x]:
                out[y, x] = out[r, c]
                heapq.heappush(heap, (-image[y, x], age, (y, x)))
                age += 1
    return out
