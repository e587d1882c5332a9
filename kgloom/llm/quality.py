"""Quality scores: random Fourier features over document statistics, ridge, isotonic calibration."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .names import free
from .scratch import Scratch

STATS = (
    "bytes words mean_word lower upper digit space stop exclaim mark symbol bar other "
    "distinct top_word mean_line distinct_line long_word caps_word marked_word repeat"
).split()
#: Width of the feature map, ridge, and the fixed-point unit of features in the sums.
FEATURES, RIDGE, UNIT = 192, 1e-3, 1 << 12
#: Folds by crc32 of the key; one is never learned from.
FOLDS, HELD_OUT = 4, 2
#: Raw scores are counted in so many bins for the calibration.
BINS, LOWEST, HIGHEST = 4096, -1.0, 2.0
THRESHOLD = 0.7


def _class_table() -> np.ndarray:
    of = np.full(256, 8)  # other bytes, parts of characters beyond ASCII among them
    for k, chars in enumerate(
        (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"-()", b"!", b"?", b"#$%&*@^~_+=<>[]{}\\/`|")
    ):
        of[list(chars)] = k
    return of


_CLASS = _class_table()


def statistics(text: bytes | None) -> list[float]:
    """The STATS of one whole text; zeros for an empty one."""
    text = text or b""
    if not text:
        return [0.0] * len(STATS)
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lower, upper, digit, space, stop, exclaim, mark, symbol, other = (
        np.bincount(_CLASS, by_byte, minlength=9) / len(text)
    ).tolist()
    words = text.split()
    counts = Counter(words)
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    top = max(counts.values(), default=0)
    repeats = sum(c - 1 for c in counts.values() if c > 3)
    caps = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1)
    marked = sum(c for w, c in counts.items() if w[-1:] in b"#$%&*@^~_+=<>|!" and w)
    long_ = sum(c for w, c in counts.items() if len(w) > 20)
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(sum(len(w) * c for w, c in counts.items()) / n),
        lower, upper, digit, space, stop, exclaim, mark, symbol, by_byte[ord("|")] / len(text), other,
        len(counts) / n, top / n, np.log1p(len(text) / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
        long_ / n, caps / n, marked / n, repeats / n,
    ]


def document_statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_hash, stats) of every row, one pass over whole texts."""
    schema = T.StructType(
        [
            df.schema[key],
            T.StructField("text_hash", T.LongType()),
            T.StructField("stats", T.ArrayType(T.DoubleType(), False), False),
        ]
    )

    def run(batches):
        for batch in batches:
            raw = batch.column(2).cast(pa.binary())
            stats = pa.array([statistics(x.as_py()) for x in raw], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), stats], names=schema.names)

    return df.select(F.col(key), F.xxhash64(text), F.col(text).cast("string")).mapInArrow(run, schema)


class Kernel:
    """Random Fourier features whose inner products approximate a Gaussian kernel."""

    def __init__(self, mean: list[float], spread: list[float], seed: int = 7):
        self.mean, self.spread = np.array(mean), np.array(spread)
        rng = np.random.default_rng(seed)
        self.w = rng.standard_normal((len(mean), FEATURES)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        """Features in fixed-point units, the constant last: sums of their products are exact."""
        x = np.clip((stats - self.mean) / self.spread, -8, 8)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ self.w + self.b) * np.sqrt(FEATURES)
        return np.rint(np.c_[z, np.ones(len(z))] * UNIT)


def _matrix(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, len(STATS)))


def normal_equations(rows: DataFrame, kernel: Kernel) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per fold, the sums of z z' and z y over rows(fold, y, stats), in whole numbers.

    Each partition gives one row for each fold and line of the sums; these are added up per line
    before they reach the driver, which gets FEATURES + 1 lines for each fold.
    """

    def part(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            z = kernel(_matrix(batch.column(2)))
            for f in np.unique(fold):
                own = fold == f
                both = z[own].T @ np.c_[z[own], y[own] * UNIT]
                sums[int(f)] = sums.get(int(f), 0) + both.astype(np.int64)
        for f, m in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), pa.array(m.tolist(), pa.list_(pa.int64()))],
                names=["fold", "line", "sums"],
            )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": pdf.fold[:1], "line": pdf.line[:1], "sums": [np.sum(np.stack(pdf.sums), 0).tolist()]})

    out = "fold int, line int, sums array<bigint>"
    got = rows.select("fold", "y", "stats").mapInArrow(part, out).groupBy("fold", "line").applyInPandas(add, out).collect()
    found: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.fold, r.line)):
        found.setdefault(r.fold, []).append(r.sums)
    return {f: (np.array(m, float)[:, :-1] / UNIT**2, np.array(m, float)[:, -1] / UNIT**2) for f, m in found.items()}


def _solve(parts) -> np.ndarray:
    a, b = sum(p[0] for p in parts), sum(p[1] for p in parts)
    n = max(1.0, a[-1, -1])
    return np.linalg.solve(a + np.eye(len(a)) * RIDGE * n, b)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and values of the rising steps nearest to means y."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, n):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    m = np.array(blocks)
    return m[:, 0] / m[:, 2], m[:, 1] / m[:, 2]


def score_quality(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """(key, held_out, score, predicted, text_hash) of every row, from its whole text alone.

    Learns from all rows of labels(key, label in 0, 1) whose key occurs in df and whose
    crc32(key as text) mod 4 is not 2. Statistics are scaled by the labelled rows' means and
    deviations and mapped to random Fourier features; partitions sum the normal equations in whole
    numbers, so the order of sums can't change them. The remaining folds are scored by the ridge
    fitted on the others, and those scores calibrate the fit on all by pooled adjacent violators.

    Null texts count as empty; null keys are scored and never learned from or held out; repeated
    rows score alike and count as often as they occur. Other labels are ignored. With one class
    or no label left all scores are the share of label 1 (0.5 without labels). An empty table gives
    no rows.
    """
    scratch = Scratch(df.sparkSession, "quality")
    stats = scratch.save(document_statistics(df, key, text), "statistics")
    fold = F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS
    held = F.coalesce(fold == HELD_OUT, F.lit(False))
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key), F.col(label).cast("double").alias("y"))
    train = scratch.save(
        stats.where(fold != HELD_OUT).join(known, key).select(fold.cast("int").alias("fold"), "y", "stats"), "training"
    )
    n, share = train.agg(F.count("*"), F.avg("y")).first()
    if not n or share in (0.0, 1.0):
        score = F.lit(0.5 if not n else float(share))
        return stats.select(key, held.alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), "text_hash")
    scale = train.select(F.posexplode("stats")).groupBy("pos").agg(F.avg("col"), F.stddev_pop("col")).orderBy("pos").collect()
    short = lambda v: float(f"{v:.6g}")  # noqa: E731  the last digits depend on the order of sums
    kernel = Kernel([short(r[1]) for r in scale], [max(short(r[2]), 1e-6) for r in scale])
    sums = normal_equations(train, kernel)
    whole = _solve(sums.values())
    without = {f: _solve([p for g, p in sums.items() if g != f] or [sums[f]]) for f in sums}

    def bins(batches):
        for batch in batches:
            f, z = batch.column(0).to_numpy(), kernel(_matrix(batch.column(2))) / UNIT
            raw = np.array([row @ without[k] for k, row in zip(f, z)])
            at = np.clip((raw - LOWEST) / (HIGHEST - LOWEST) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "y"])

    counted = train.select("fold", "y", "stats").mapInArrow(bins, "bin int, y double").groupBy("bin")
    got = sorted(map(tuple, counted.agg(F.count("*"), F.sum("y")).collect()))  # BINS rows at most
    centre = np.array([LOWEST + (b + 0.5) * (HIGHEST - LOWEST) / BINS for b, _, _ in got])
    size, ones = np.array([c for _, c, _ in got], float), np.array([s for _, _, s in got])
    at, value = isotonic(centre, ones / size, size)

    schema = T.StructType([df.schema[key], T.StructField("text_hash", T.LongType()), T.StructField("score", T.DoubleType(), False)])

    def score_all(batches):
        for batch in batches:
            raw = (kernel(_matrix(batch.column(2))) / UNIT) @ whole
            score = np.clip(np.round(np.interp(raw, at, value), 9), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=schema.names)

    scored = stats.select(key, "text_hash", "stats").mapInArrow(score_all, schema)
    return scored.select(key, held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "text_hash")


def drop_rejected(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """df without the rows that score_quality() rejects. Equal keys with equal texts share a fate.

    Null keys, null, empty and long texts, ties and missing labels as in score_quality(); all columns
    stay, whatever their names; an empty table stays empty.
    """
    k, h = free(df, "key", "hash")
    bad = score_quality(df, labels, key, text, label).where("predicted = 0")
    bad = bad.select(F.col(key).alias(k), F.col("text_hash").alias(h)).distinct()
    return df.join(bad, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(h)), "left_anti")
