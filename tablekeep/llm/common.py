"""What the operators share: settled tables, whole groups inside a task, sums by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tablekeep.session import scratch_dir


def settle(df: DataFrame, label: str, **options: int | str) -> DataFrame:
    """Compute ``df`` once into a table of the shared folder and read it from there.

    Always writes, whatever the size, by the writer's ``options``. The table outlives lost executors and cuts the lineage.
    """
    path = scratch_dir(df.sparkSession, f"llm-{label}")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it in any case."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cut the frames of a sorted partition so that no run of equal ``keys`` is divided.

    Holds one Arrow batch and one group at most; the caller sees to it that groups are bounded.
    """
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        last = np.ones(len(frame), bool)
        for key in keys:
            last &= (frame[key] == frame[key].iloc[-1]).to_numpy()
        begins = len(frame) - int(np.argmin(last[::-1])) if not last.all() else 0
        if begins == 0 and held and all(held[-1][key].iloc[-1] == frame[key].iloc[0] for key in keys):
            held.append(frame)
            continue
        ready = pd.concat([*held, frame.iloc[:begins]], ignore_index=True) if held else frame.iloc[:begins]
        if len(ready):
            yield ready.reset_index(drop=True)
        held = [frame.iloc[begins:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def group_bounds(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where the runs of equal ``keys`` begin, and the number of rows at the end."""
    if frame.empty:
        return np.zeros(1, np.int64)
    new = np.zeros(len(frame), bool)
    new[0] = True
    for key in keys:
        values = frame[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), len(frame))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``bounds``; empty segments are zero."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0)
    return out


def mix64(values: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (the finalizer of SplitMix64)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 21, most_rows: int = 1 << 10) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of ``most_rows`` whose texts have ``most_bytes`` together, or one text that is longer."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    before = np.cumsum(sizes) - sizes
    begin = 0
    for row in range(1, batch.num_rows + 1):
        if row == batch.num_rows or row - begin == most_rows or before[row] + sizes[row] - before[begin] > most_bytes:
            yield batch.slice(begin, row - begin)
            begin = row


def ascii_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words between ASCII white space: bounds per text, the code of each word, the distinct words."""
    pieces = [(text.as_py() or b"").split() for text in texts]
    bounds = np.concatenate([[0], np.cumsum([len(words) for words in pieces])]).astype(np.int64)
    coded = pa.array([word for words in pieces for word in words], pa.binary()).dictionary_encode()
    return bounds, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
