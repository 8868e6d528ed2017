"""Small models in numpy: boosted trees, hashed logistic regression, an isotone threshold. Trained on the driver on bounded samples, or in parts that are mixed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Most characters of text that a sample brings to the driver.
SAMPLE_CHARS = 100_000_000


def bounded_sample(rows: DataFrame, n: int, *keys: str, chars: int = SAMPLE_CHARS) -> DataFrame:
    """At most n rows to train on, the first by a hash of `keys`, of about `chars` characters in all string columns; repeated keys fall together.

    One pass counts rows and characters by part of the hash (1,024 numbers), so only the rows of the parts needed travel.
    """
    part = F.floor(F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) / 1024)
    size = sum((F.length(F.coalesce(c, F.lit(""))) for c, t in rows.dtypes if t == "string"), F.lit(0))
    last, have, read = -1, 0, 0
    for r in sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(size).alias("size")).collect()):
        if last >= 0 and (have >= n or read + r.size > chars):
            break
        last, have, read = r.part, have + r.n, read + r.size
    return rows.where(part <= last).orderBy(F.pmod(F.xxhash64(*keys), F.lit(1 << 20)), F.xxhash64(*keys), *keys).limit(n)


class Boosted:
    """Gradient-boosted trees of depth `depth` for the logistic loss, on binned features.

    A pickled model is a few kilobytes. NaN counts as the lowest value.
    """

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def _bin(self, x: np.ndarray) -> np.ndarray:
        x = np.nan_to_num(x, nan=-1e30)
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        x = np.asarray(x, float)
        w = np.ones(len(y)) if weight is None else weight
        self.edges = [np.unique(np.quantile(np.nan_to_num(x[:, j], nan=-1e30), np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._bin(x)
        p = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        self.nodes = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = (p - y) * w, np.maximum(p * (1 - p), 1e-6) * w
            at = np.zeros(len(y), np.int64)
            split = {}
            for level in range(self.depth):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(at == node)
                    if len(rows) >= 2 * self.least and (best := self._best(b[rows], g[rows], h[rows])):
                        split[node] = best
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    if node in split:
                        j, k = split[node]
                        rows = np.flatnonzero(at == node)
                        at[rows] = 2 * node + 1 + (b[rows, j] > k)
            leaf = np.zeros(2 ** (self.depth + 1) - 1)
            gs, hs = np.bincount(at, g, len(leaf)), np.bincount(at, h, len(leaf))
            leaf = -self.rate * gs / (hs + self.ridge)
            f += leaf[at]
            self.nodes.append((split, leaf))
        return self

    def _best(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        score = lambda a, c: a * a / (c + self.ridge)
        top, best, all_g, all_h = 1e-6, None, g.sum(), h.sum()
        for j in range(b.shape[1]):
            n = len(self.edges[j]) + 1
            cg, ch, cn = (np.cumsum(np.bincount(b[:, j], v, n))[:-1] for v in (g, h, None))
            if not len(cg):
                continue
            gain = score(cg, ch) + score(all_g - cg, all_h - ch) - score(all_g, all_h)
            gain[(cn < self.least) | (len(b) - cn < self.least)] = -1
            k = int(gain.argmax())
            if gain[k] > top:
                top, best = gain[k], (j, k)
        return best

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        x = np.asarray(x, float)
        if not len(x):
            return np.zeros(0)
        b = self._bin(x)
        f = np.full(len(x), self.base)
        for split, leaf in self.nodes:
            at = np.zeros(len(x), np.int64)
            for node, (j, k) in sorted(split.items()):
                rows = np.flatnonzero(at == node)
                at[rows] = 2 * node + 1 + (b[rows, j] > k)
            f += leaf[at]
        return 1 / (1 + np.exp(-f))


class HashedLogistic:
    """Logistic regression over hashed sparse features, trained by AdaGrad in shuffled mini-batches."""

    def __init__(self, bits: int = 18, epochs: int = 6, rate: float = 0.15, decay: float = 1e-6, seed: int = 7) -> None:
        self.size, self.epochs, self.rate, self.decay, self.seed = 1 << bits, epochs, rate, decay, seed
        self.w = np.zeros(self.size, np.float32)
        self.bias = 0.0

    def fit(self, index: np.ndarray, rows: np.ndarray, y: np.ndarray, value: np.ndarray | None = None, batch: int = 256, weight: np.ndarray | None = None) -> HashedLogistic:
        """index, value: the active features of all rows one after the other; rows: offsets (len(y) + 1); weight: how often each row counts."""
        rng = np.random.default_rng(self.seed)
        # Only the features that occur, side by side.
        have = np.zeros(self.size, np.int64)
        have[index] = 1
        have, index = np.flatnonzero(have), (np.cumsum(have) - 1)[index]
        w, seen, bias, seen_b = np.zeros(len(have)), np.full(len(have), 1e-2), 0.0, 1e-2
        n, place = np.diff(rows), np.zeros(len(have), np.int64)
        for _ in range(self.epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), batch):
                r = order[k : k + batch]
                m = n[r]
                count = np.arange(m.sum())
                at = np.repeat(rows[r] - np.cumsum(m) + m, m) + count
                i, v = index[at], None if value is None else value[at]
                who = np.repeat(np.arange(len(r)), m)
                f = np.bincount(who, w[i] if v is None else w[i] * v, len(r)) + bias
                d = 1 / (1 + np.exp(-f)) - y[r]
                if weight is not None:
                    d *= weight[r]
                # Each feature of the batch once, by the last place where it stands, without a sort.
                place[i] = count
                used = i[place[i] == count]
                place[used] = count[: len(used)]
                g = np.bincount(place[i], d[who] if v is None else d[who] * v, len(used)) / len(r) + self.decay * w[used]
                seen[used] += g * g
                w[used] -= self.rate * g / np.sqrt(seen[used])
                gb = d.mean()
                seen_b += gb * gb
                bias -= self.rate * gb / np.sqrt(seen_b)
        self.w, self.bias = np.zeros(self.size, np.float32), float(bias)
        self.w[have] = w
        return self

    def score(self, index: np.ndarray, rows: np.ndarray, value: np.ndarray | None = None) -> np.ndarray:
        v = self.w[index] if value is None else self.w[index] * value
        total = np.concatenate([[0.0], np.cumsum(v, dtype=np.float64)])
        return 1 / (1 + np.exp(-(total[rows[1:]] - total[rows[:-1]] + self.bias)))


#: A part of a model: the place of a weight, -1 for the bias, the weight, and how many rows of the part had it.
TAUGHT = "at int, w double, n double"


def part_of(model: HashedLogistic, index: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> pa.Table:
    """The part of a model that these examples teach, see `HashedLogistic.fit`; no rows without examples."""
    n = np.zeros(model.size, np.int64)
    if len(y):
        model.fit(index, rows, y, weight=weight)
        n += np.bincount(index, minlength=model.size)
    at = np.flatnonzero(n)
    some = [-1] if len(y) else []
    columns = np.append(at, some).astype(np.int32), np.append(model.w[at].astype(float), [model.bias for _ in some]), np.append(n[at], [len(y) for _ in some]).astype(float)
    return pa.table(dict(zip(("at", "w", "n"), map(pa.array, columns), strict=True)))


def mixed_parts(parts: DataFrame, bits: int) -> HashedLogistic | None:
    """One model of all `parts` (TAUGHT): each weight is the mean of those of the parts, by how many of their rows it was learned from. None without parts."""
    found = parts.groupBy("at").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")).toArrow()
    if not len(found):
        return None
    at, w = found.column("at").to_numpy(), found.column("w").to_numpy()
    model = HashedLogistic(bits)
    model.w[at[at >= 0]] = w[at >= 0]
    model.bias = float(w[at < 0][0])
    return model
