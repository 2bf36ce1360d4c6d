"""Open-set enrolment over a stream: each session's gallery is kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoweave.operators.gallery import ENROLLED, Gallery
from chronoweave.params import DEFAULT, Params

STATE = "vectors array<array<double>>, owners array<long>, negatives array<array<double>>, newest long"


def enrolments(seen: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The rule of operators.gallery.enrolments over a stream of (session, seq, vec, ok), in append mode.

    A batch's rows are taken in order of seq; rows no newer than the session's newest one are late and left out. The state
    is the session's shots and refused vectors, at most max_shots a subject and negative_size; a session that is not
    seen again keeps it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        vectors, owners, negatives, newest = state.getOption or ([], [], [], None)
        gallery = Gallery(p)
        gallery.negatives = [np.asarray(n, dtype=np.float64) for n in negatives]
        for owner, vector in zip(owners, vectors, strict=True):
            gallery._add(int(owner), np.asarray(vector, dtype=np.float64))
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if newest is not None and r.seq <= newest:
                continue
            newest = int(r.seq)
            v = np.asarray(r.vec, dtype=np.float64)
            size = float(np.linalg.norm(v))
            out.append({"session": key[0], "seq": newest} | gallery.enrol(v / size if size else v, bool(r.ok)))
        state.update(([v.tolist() for v in gallery.vectors], gallery.owners, [n.tolist() for n in gallery.negatives], newest))
        if out:
            yield pd.DataFrame(out).astype({"subject": "Int64"})

    return seen.select("session", "seq", "vec", "ok").groupBy("session").applyInPandasWithState(step, ENROLLED, STATE, "append", GroupStateTimeout.NoTimeout)
