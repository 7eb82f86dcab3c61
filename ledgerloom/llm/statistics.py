"""Document statistics for the quality classifier, computed in Arrow batches with numpy.

Each statistic is a function of the whole text. An empty or null text has all statistics 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

NAMES = [
    "s_bytes", "s_words", "s_mean_word", "s_upper", "s_digit", "s_symbol", "s_bar", "s_bang", "s_high", "s_space", "s_newline",
    "s_same_next", "s_distinct", "s_top_word", "s_short", "s_long", "s_line_rep", "s_period", "s_comma",
]
_CLASSES = [
    bytes(range(65, 91)), bytes(range(48, 58)), b"#$%&*@^~<>{}[]=+\\_", b"|", b"!", bytes(range(128, 256)), b" \t\r\x0b\x0c", b"\n", b".", b",",
]
_SLOT = dict(zip(["s_upper", "s_digit", "s_symbol", "s_bar", "s_bang", "s_high", "s_space", "s_newline", "s_period", "s_comma"], range(10)))
_LUT = np.full(256, 10, dtype=np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _LUT[list(_chars)] = _i


def describe(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    share = np.bincount(_LUT[np.frombuffer(raw, dtype=np.uint8)], minlength=11)[:10] / n
    words = raw.split()
    k = len(words)
    out = {name: share[i] for name, i in _SLOT.items()}
    out["s_bytes"], out["s_words"] = np.log1p(n), np.log1p(k)
    if k:
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        lens = np.fromiter(map(len, words), dtype=np.int64, count=k)
        out["s_mean_word"] = lens.mean()
        out["s_same_next"] = sum(map(bytes.__eq__, words, words[1:])) / k
        # Distinct words fall with length by nature: measured against the square root of the length.
        out["s_distinct"] = len(counts) / k**0.5
        out["s_top_word"] = max(counts.values()) / k
        out["s_short"], out["s_long"] = (lens <= 2).mean(), (lens > 20).mean()
    lines = raw.split(b"\n")
    out["s_line_rep"] = 1 - len(set(lines)) / len(lines)
    return [float(out.get(name, 0.0)) for name in NAMES]


def with_statistics(df, text: str = "text", keep: list[str] | None = None):
    """The columns ``keep`` of ``df`` (all by default) and the statistics of ``text``."""
    keep = df.columns if keep is None else keep
    slim = df.select(*keep, df[text].alias("__text"))

    def run(batches):
        for batch in batches:
            rows = np.array([describe(t.as_py()) for t in batch.column(batch.num_columns - 1)], dtype=np.float64).reshape(-1, len(NAMES))
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(rows[:, i]) for i in range(len(NAMES))]], names=[*keep, *NAMES])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*[df.schema[c] for c in keep], *[StructField(n, DoubleType()) for n in NAMES]])
    return slim.mapInArrow(run, schema)
