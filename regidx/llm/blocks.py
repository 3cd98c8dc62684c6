"""Comparing the members of a group in bounded blocks, however large the group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members that one task compares with the rest of their group.
HOMES = 4096


def split_groups(members: DataFrame, keys: list[str], member: str, homes: int = HOMES) -> DataFrame:
    """``members`` with ``_chunk`` and ``_home``: a group of more than ``homes`` rows is cut into chunks.

    Every chunk gets the whole group, and each member is at home in exactly one, so comparing
    a chunk's homes with its rows meets all pairs. Small groups are one chunk, all at home.
    """
    counted = members.groupBy(*keys).agg(F.ceil(F.count("*") / homes).cast("int").alias("_chunks"))
    own = F.pmod(F.xxhash64(member), F.col("_chunks")).cast("int")
    return (
        members.join(counted, keys)
        .withColumn("_own", own)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        .withColumn("_home", F.col("_own") == F.col("_chunk"))
        .drop("_own", "_chunks")
    )


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking members a[i] and b[i]; a label is the smallest index of its class."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            above = label[label]
            if np.array_equal(above, label):
                break
            label = above
    return label


def by_group(members: DataFrame, keys: list[str], make, schema: str) -> DataFrame:
    """``make(frame)`` over the rows of each group, for very many small groups.

    Rows are brought together and sorted by Spark and stream through each task, which holds one
    group at a time.
    """

    def run(frames):
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            key = frame[keys].to_numpy()
            starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(frame)]
            if held and (held[-1][keys].to_numpy()[-1] != key[0]).any():
                yield make(pd.concat(held, ignore_index=True))
                held = []
            done = []
            for start, end in zip(starts[:-2], starts[1:-1], strict=True):
                part = frame.iloc[start:end].reset_index(drop=True)
                if held:
                    part = pd.concat([*held, part], ignore_index=True)
                    held = []
                if len(part) > 1:
                    done.append(make(part))
            held.append(frame.iloc[starts[-2] :])
            if done:
                yield pd.concat(done, ignore_index=True)
        if held:
            yield make(pd.concat(held, ignore_index=True))

    return members.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
