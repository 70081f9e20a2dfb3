"""Frames and their spectral features, a matrix of frames at a time.

Everything that depends only on rate and settings (window, filters, cosine
weights, pitch bins) is built once per worker and kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import AcousticConfig, half_away

TINY = 1e-20
#: Weights of a candidate's harmonics, from the fundamental on.
HARMONICS = (1.0, 0.90, 0.60, 0.40)

SCALARS = ("rms", "peak", "zcr", "clip", "centroid_hz", "spread_hz", "rolloff_hz", "flatness", "pitch_hz", "pitch_conf", "voiced_prob")
FRAME_SCHEMA = "session_id string, sample_rate int, batch_no long, start_s double, end_s double, " + ", ".join(f"{c} double" for c in SCALARS) + ", log_mel array<double>, mfcc array<double>"
FRAME_ARROW = pa.schema([("session_id", pa.string()), ("sample_rate", pa.int32()), ("batch_no", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), *[(c, pa.float64()) for c in SCALARS], ("log_mel", pa.list_(pa.float64())), ("mfcc", pa.list_(pa.float64()))])


def _mel(f: np.ndarray | float):
    return 2595 * np.log10(1 + np.asarray(f) / 700)


def hann(n: int) -> np.ndarray:
    """Symmetric window; ones for a single sample."""
    return np.hanning(n).astype(np.float32) if n > 1 else np.ones(max(0, n), np.float32)


@dataclass(frozen=True)
class Plan:
    frame: int
    hop: int
    fft: int
    bin_hz: float
    window: np.ndarray
    low: int
    high: int
    filters: np.ndarray
    cosines: np.ndarray


@lru_cache(maxsize=16)
def plan(rate: int, config: AcousticConfig) -> Plan:
    frame, fft = config.frame_length(rate), config.fft_size(rate)
    bin_hz, bins = rate / fft, fft // 2 + 1
    low, high = max(1, int(np.ceil(config.minimum_pitch_hz / bin_hz))), min(fft // 2, int(np.floor(config.maximum_pitch_hz / bin_hz)))
    bottom, top = min(80.0, rate / 2), min(8000.0, rate / 2)
    edges = np.zeros(config.mel_filters + 2, int)
    if top > bottom:
        points = _mel(bottom) + np.arange(len(edges)) / (len(edges) - 1) * (_mel(top) - _mel(bottom))
        edges = np.clip(np.floor(700 * (10 ** (points / 2595) - 1) * fft / rate).astype(int), 0, bins - 1)
    filters = np.zeros((bins, config.mel_filters))
    for k, (a, b, c) in enumerate(zip(edges, edges[1:], edges[2:], strict=False)):
        if b > a:
            filters[a:b, k] += np.arange(b - a) / (b - a)
        if c > b:
            filters[b:c, k] += (c - np.arange(b, c)) / (c - b)
    place = np.arange(config.mel_filters) + 0.5
    cosines = np.cos(np.pi * np.arange(config.mfcc_count)[:, None] * place / config.mel_filters).T
    return Plan(frame, config.hop_length(rate), fft, bin_hz, hann(frame), low, high, filters, cosines)


def signal_features(x: np.ndarray, config: AcousticConfig) -> dict[str, np.ndarray]:
    """Level, peak, sign changes and clipped share of each row of samples."""
    d = x.astype(np.float64)
    positive = x >= 0
    changes = (positive[:, 1:] != positive[:, :-1]).sum(1)
    return {"rms": np.sqrt((d * d).mean(1)), "peak": np.abs(d).max(1), "zcr": changes / (x.shape[1] - 1) if x.shape[1] > 1 else np.zeros(len(x)), "clip": (np.abs(d) >= config.clipping_threshold).mean(1)}


def _pitch(power: np.ndarray, p: Plan, config: AcousticConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pitch (NaN without one), its confidence, and how far one bin dominates the pitch band."""
    n = len(power)
    pitch, sure, voiced = np.full(n, np.nan), np.zeros(n), np.zeros(n)
    if p.low > p.high:
        return pitch, sure, voiced
    bins = np.arange(p.low, p.high + 1)
    band = power[:, p.low : p.high + 1]
    top, total = band.max(1), band.sum(1)
    heard = total > TINY
    voiced[heard] = np.minimum(1, top[heard] / total[heard])
    score = np.zeros_like(band)
    for h, w in enumerate(HARMONICS, 1):
        at = bins * h
        inside = at < power.shape[1]
        score[:, inside] += w * power[:, at[inside]]
    with np.errstate(divide="ignore", invalid="ignore"):
        presence = np.where((top > TINY)[:, None], np.minimum(1, np.sqrt(np.maximum(0, band / top[:, None]))), 0.0)
    # A lowest candidate with hardly any fundamental is the shadow of a higher one.
    weak = presence[:, 0] < 0.25
    score[weak, 0] *= presence[weak, 0] / 0.25
    best = score.argmax(1)
    rows = np.arange(n)
    peak = score[rows, best]
    rival = (np.abs(np.arange(len(bins))[None] - best[:, None]) > 1) & (band >= 0.02 * top[:, None])
    second = np.where(rival, score, 0.0).max(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        margin = np.where(second > 0, np.maximum(0, (peak - second) / peak), 1.0)
    base = np.clip(0.60 * voiced + 0.25 * presence[rows, best] + 0.15 * margin, 0, 1)
    edge = (best == 0) | (best == len(bins) - 1)
    found = peak > TINY
    sure[found] = (base * np.where(edge, 0.80, 1.0))[found]
    given = found & (voiced >= config.minimum_pitch_evidence) & (sure >= config.minimum_pitch_confidence)
    shift = np.zeros(n)
    inner = ~edge
    a, b, c = score[rows[inner], best[inner] - 1], peak[inner], score[rows[inner], best[inner] + 1]
    curve = a - 2 * b + c
    with np.errstate(divide="ignore", invalid="ignore"):
        shift[inner] = np.where(np.abs(curve) > TINY, np.clip(0.5 * (a - c) / curve, -0.5, 0.5), 0.0)
    pitch[given] = ((bins[best] + shift) * p.bin_hz)[given]
    return pitch, sure, voiced


def spectral_features(x: np.ndarray, rate: int, config: AcousticConfig) -> dict[str, np.ndarray]:
    """Spectral shape, pitch, log-mel energies and cepstrum of each row; a silent row has none of them."""
    p = plan(rate, config)
    windowed = x * (p.window if x.shape[1] == p.frame else hann(x.shape[1]))
    # Single precision is that of the result, not of the steps on the way.
    spectrum = np.fft.rfft(windowed.astype(np.float64), n=p.fft, axis=1).astype(np.complex64)
    power = spectrum.real.astype(np.float64) ** 2 + spectrum.imag.astype(np.float64) ** 2
    total = power.sum(1)
    heard = total > TINY
    safe = np.where(heard, total, 1.0)
    freq = np.arange(power.shape[1]) * p.bin_hz
    centroid = (power * freq).sum(1) / safe
    spread = np.sqrt((power * (freq - centroid[:, None]) ** 2).sum(1) / safe)
    rolloff = (np.cumsum(power, 1) >= (total * config.rolloff_fraction)[:, None]).argmax(1) * p.bin_hz
    size = np.sqrt(np.maximum(power[:, 1:], TINY))
    flat = np.minimum(1, np.exp(np.log(np.maximum(size, TINY)).mean(1)) / size.mean(1))
    pitch, sure, voiced = _pitch(power, p, config)
    mels = np.log(np.maximum(power @ p.filters, TINY))
    out = {"centroid_hz": centroid, "spread_hz": spread, "rolloff_hz": rolloff, "flatness": flat, "pitch_conf": sure, "voiced_prob": voiced}
    out = {k: np.where(heard, v, 0.0) for k, v in out.items()}
    out["pitch_hz"] = np.where(heard, pitch, np.nan)
    out["log_mel"] = np.where(heard[:, None], mels, np.log(TINY))
    out["mfcc"] = np.where(heard[:, None], mels @ p.cosines, 0.0)
    return out


def frame_batch(session: str, rate: int, start: float, samples: np.ndarray, config: AcousticConfig, batch_no: int = 0) -> pa.RecordBatch:
    """Feature rows of all complete frames of contiguous samples."""
    p = plan(rate, config)
    n = 0 if len(samples) < p.frame else 1 + (len(samples) - p.frame) // p.hop
    if not n:
        return pa.RecordBatch.from_pylist([], schema=FRAME_ARROW)
    x = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, np.float32), p.frame)[:: p.hop][:n]
    parts = [signal_features(x[i : i + 2048], config) | spectral_features(x[i : i + 2048], rate, config) for i in range(0, n, 2048)]
    f = {k: np.concatenate([q[k] for q in parts]) for k in parts[0]}
    at = start + np.arange(n) * p.hop / rate
    columns = [pa.array([session] * n, pa.string()), pa.array(np.full(n, rate, np.int32)), pa.array(np.full(n, batch_no, np.int64)), pa.array(at), pa.array(at + p.frame / rate)]
    columns += [pa.array(f[c], pa.float64(), mask=np.isnan(f[c])) for c in SCALARS]
    columns += [pa.array(list(f[c]), pa.list_(pa.float64())) for c in ("log_mel", "mfcc")]
    return pa.RecordBatch.from_arrays(columns, schema=FRAME_ARROW)


@dataclass
class Accumulator:
    """Frames of chunks that arrive one by one: batches on the hop grid, carrying the overlap of frames.

    A chunk that begins too far from where the last one ended closes what is
    pending and starts anew. All chunks must have one rate.
    """

    config: AcousticConfig = field(default_factory=AcousticConfig)
    batch_seconds: float = 4.0
    rate: int = 0
    pending: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    pending_start: float = 0.0
    implicit_start: float = 0.0
    batch_no: int = 0
    finished: bool = False

    def consume(self, session: str, rate: int, samples: np.ndarray, start: float | None = None) -> Iterator[pa.RecordBatch]:
        if self.finished:
            raise ValueError("the session has been finished already")
        if self.rate and rate != self.rate:
            raise ValueError(f"the session changed its sample rate from {self.rate} to {rate}")
        if rate <= 0 or not len(samples):
            return
        self.rate = rate
        at = self.implicit_start if start is None else start
        if not len(self.pending):
            self.pending_start = at
        elif abs(at - (self.pending_start + len(self.pending) / rate)) > max(0.1, 2 * self.config.frame_seconds):
            yield from self.flush(session)
            self.pending_start = at
        self.pending = np.concatenate([self.pending, np.asarray(samples, np.float32)])
        self.implicit_start = at + len(samples) / rate
        frame, hop = self.config.frame_length(rate), self.config.hop_length(rate)
        target = max(hop, half_away(rate * self.batch_seconds))
        advance = max(hop, half_away(target / hop) * hop)
        size = advance + max(0, frame - hop)
        while len(self.pending) >= size:
            yield from self.flush(session, size, advance)

    def flush(self, session: str, size: int | None = None, advance: int | None = None) -> Iterator[pa.RecordBatch]:
        n = min(size or len(self.pending), len(self.pending))
        if not n:
            return
        batch = frame_batch(session, self.rate, self.pending_start, self.pending[:n], self.config, self.batch_no)
        step = min(n, max(1, advance or n))
        self.pending, self.pending_start = self.pending[step:], self.pending_start + step / self.rate
        self.batch_no += 1
        if batch.num_rows:
            yield batch

    def finish(self, session: str) -> Iterator[pa.RecordBatch]:
        yield from self.flush(session)
        self.finished = True


def frames(chunks: DataFrame, config: AcousticConfig = AcousticConfig(), batch_seconds: float = 4.0) -> DataFrame:
    """Feature rows of all sessions of a chunk table.

    Sessions are sorted by Spark and pass through an accumulator chunk by
    chunk, so a recording is never held as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, acc = None, Accumulator(config, batch_seconds)
        for b in batches:
            names = b.column(0).to_pylist()
            starts, rates = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, session in enumerate(names):
                if session != current:
                    if current is not None:
                        yield from acc.finish(current)
                    current, acc = session, Accumulator(config, batch_seconds)
                yield from acc.consume(session, rates[i], np.asarray(b.column(4)[i].values), starts[i])
        if current is not None:
            yield from acc.finish(current)

    rows = chunks.select("session_id", "chunk_index", "start_s", "sample_rate", "samples")
    return rows.repartition("session_id").sortWithinPartitions("session_id", "chunk_index").mapInArrow(run, FRAME_SCHEMA)
