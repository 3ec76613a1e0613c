"""URL filter: logistic regression on hashed character n-grams of host and path.

Host and path give n-grams of 3 to 5 bytes, each in a hash space of its own; the model is trained on a
small labelled URL table (`LABELLED` of urllabels.py, or a DataFrame of url and label of at most `MOST_LABELS`
rows; more are refused) with an L2 penalty on the driver, and its weights, one array of `BUCKETS` numbers, go to the tasks. Only the key and url columns
are read; nothing is shuffled.

Scheme, port, user information, query and fragment are left out; host and path are put in lower case, and
the host's leading www. is dropped.

Defined results: a null url or one without a host scores null and is not blocked (blocked = false);
features count once for each URL; very long URLs are read whole; repeated rows score alike; rows with
null labels or urls are not trained on; an empty or one-class label table gives score 0.5 for all and
blocks nothing; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .urllabels import labelled

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
CUTOFF = 0.5
MOST_LABELS = 200_000
U = np.uint64
_URL = re.compile(r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:@]+)(?::\d*)?([^?#]*)", re.I)

LABELLED = labelled()


def features(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of each distinct feature, and which rows have a host."""
    found = [_URL.match(u) if u else None for u in urls]
    rows, at = [], []
    for salt, part in ((1, [f"^{m[1]}$" if m else "" for m in found]), (2, [f"{m[2] or '/'}$" if m else "" for m in found])):
        for row0, _, data, offs in tx.chunks(pa.array([p.lower() for p in part], pa.large_string())):
            row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
            c = tx.sums(data)
            for n in GRAMS:
                s = np.arange(max(0, len(data) - n + 1))
                s = s[s + n < offs[row[s] + 1]]  # the line feed at the end of each row is in no n-gram
                h = tx.mix(tx.hashes(data, s, s + n, c) + U(salt))
                rows.append(row[s] + row0)
                at.append((h % U(BUCKETS)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    both = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(at))
    return both // BUCKETS, both % BUCKETS, np.array([m is not None for m in found], bool)


def logits(weights: np.ndarray, bias: float, urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    row, at, ok = features(urls)
    n = len(urls)
    size = np.maximum(np.bincount(row, minlength=n), 1)
    return np.bincount(row, weights=weights[at], minlength=n) / np.sqrt(size) + bias, ok if len(ok) else np.zeros(n, bool)


def train(rows: list[tuple[str, int]], rounds: int = 1500, step: float = 0.5, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent; each URL's features have unit length."""
    rows = [(u, int(y)) for u, y in rows if u is not None and y is not None]
    y = np.array([r[1] for r in rows], float)
    w, bias = np.zeros(BUCKETS), 0.0
    if len(set(y.tolist())) < 2:
        return w, bias
    row, at, _ = features([r[0] for r in rows])
    value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(rows)), 1))[row]
    used, at = np.unique(at, return_inverse=True)
    v = np.zeros(len(used))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, weights=v[at] * value, minlength=len(rows)) + bias)))
        g = (p - y) / len(rows)
        v -= 10 * step * (np.bincount(at, weights=g[row] * value, minlength=len(used)) + penalty * v)
        bias -= step * g.sum()
    w[used] = v
    return w, bias


def score_urls(pages: DataFrame, labelled: DataFrame | None = None, key: str = "page_id", cutoff: float = CUTOFF) -> DataFrame:
    """(key, url, score, blocked) of every row."""
    rows = LABELLED if labelled is None else [tuple(r) for r in labelled.select("url", "label").limit(MOST_LABELS + 1).collect()]
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labelled URLs")
    weights, bias = train(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, ok = logits(weights, bias, b.column(1).to_pylist())
            p = np.round(1 / (1 + np.exp(-z)), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, mask=~ok), pa.array(ok & (p > cutoff))], names=[key, "url", "score", "blocked"])

    return pages.select(F.col(key).cast("long").alias(key), F.col("url").cast("string").alias("url")).mapInArrow(run, f"{key} long, url string, score double, blocked boolean")
