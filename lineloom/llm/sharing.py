"""Which keys share a signature, found in bounded groups however many keys share one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lineloom.llm.words import give_back, mix, signed

#: Rows of one signature that a task sends to the signature's own group, at most.
SENT = 4
#: Signatures a task holds before it packs them.
HELD = 1 << 19


def shared(rows: DataFrame, produce: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], groups: int) -> DataFrame:
    """(sig, key, indexed): the rows of signatures that two keys or more have, at least one of them indexed.

    ``produce`` gives (signature, key, indexed) arrays of a batch, the first two unsigned 64-bit. They travel
    packed, one row for each task and group of signatures. A task sends at most ``SENT`` rows of a signature,
    indexed ones first, to its group; the others are known to be shared and are spread over all groups by
    their key, so no group grows with the most frequent signature. A signature without an indexed row may
    remain where its rows were spread; joins on an indexed row leave it out.
    """
    def pack(batches):
        held = []

        def emit():
            s, k, f = (np.concatenate([h[c] for h in held]) for c in range(3))
            order = np.lexsort((k, ~f, s))
            s, k, f = s[order], k[order], f[order]
            new = np.r_[True, (s[1:] != s[:-1]) | (k[1:] != k[:-1]) | (f[1:] != f[:-1])]
            s, k, f = s[new], k[new], f[new]
            start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            nth = np.arange(len(s)) - np.repeat(start, np.diff(np.r_[start, len(s)]))
            known = nth >= SENT
            group = ((np.where(known, mix(k), s) >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
            order = np.argsort(group, kind="stable")
            group = group[order]
            cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            ends = [*cuts[1:], len(order)]
            part = lambda x: pa.array([x[order[i:j]].tobytes() for i, j in zip(cuts, ends)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(group[cuts].astype(np.int64)), part(s), part(k), part(f.astype(np.uint8) | (known.astype(np.uint8) << 1))], names=["grp", "sig", "key", "flags"])

        for b in batches:
            for one in produce(b):
                if len(one[0]):
                    held.append(one)
                if sum(len(h[0]) for h in held) > HELD:
                    yield emit()
                    held = []
        if held:
            yield emit()
        give_back()

    def search(table: pa.Table) -> pa.Table:
        s, k, flags = (np.frombuffer(b"".join(x.as_py() for x in table[c]), kind) for c, kind in (("sig", np.uint64), ("key", np.uint64), ("flags", np.uint8)))
        known = flags > 1
        done = s[known], k[known], (flags[known] & 1) > 0
        s, k, f = s[~known], k[~known], flags[~known] > 0
        order = np.lexsort((~f, k, s))
        s, k, f = s[order], k[order], f[order]
        new = np.r_[True, (s[1:] != s[:-1]) | (k[1:] != k[:-1])] if len(s) else np.zeros(0, bool)
        s, k, f = s[new], k[new], f[new]
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        each = np.diff(np.r_[start, len(s)])
        indexed = np.logical_or.reduceat(f, start) if len(s) else np.zeros(0, bool)
        kept = np.repeat((each > 1) & indexed, each)
        s, k, f = (np.concatenate([a[kept], b]) for a, b in zip((s, k, f), done))
        give_back()
        return pa.table({"sig": signed(s), "key": signed(k), "indexed": pa.array(f)})

    packed = rows.mapInArrow(pack, "grp bigint, sig binary, key binary, flags binary")
    return packed.groupBy("grp").applyInArrow(search, "sig bigint, key bigint, indexed boolean").distinct()
