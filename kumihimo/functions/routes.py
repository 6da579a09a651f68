"""Order of a route's points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa


def nearest_first(points: pd.DataFrame) -> pd.DataFrame:
    """Order of one route's points: the first by id, then always the nearest left (ties by id). A route has at most 20 points."""
    left = points.sort_values("place").to_dict("records")
    out = []
    while left:
        here = out[-1] if out else left[0]
        pick = min(left, key=lambda p: (round((p["lat"] - here["lat"]) ** 2 + (p["lon"] - here["lon"]) ** 2, 12), p["place"]))
        left.remove(pick)
        out.append(pick | {"pos": len(out)})
    return pd.DataFrame(out, columns=["work", "place", "lat", "lon", "pos"])[["work", "place", "pos"]]


def routes_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (work, stops: list of (place, lat, lon) by place) -> (work, place, pos) in the order of ``nearest_first``, the routes of a batch at once."""
    for batch in batches:
        stops = batch.column("stops")
        n = np.diff(stops.offsets.to_numpy())
        if not n.sum():
            continue
        flat = stops.flatten()
        place, lat, lon = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        begin = np.concatenate(([0], np.cumsum(n)[:-1]))
        slot = np.arange(n.max())
        real = slot < n[:, None]
        at = np.where(real, begin[:, None] + slot, 0)
        y, x, left = lat[at], lon[at], real.copy()
        route = np.arange(len(n))
        pick = np.zeros(len(n), dtype=np.int64)
        works, places, pos = [], [], []
        for step in range(n.max()):
            going = step < n
            if step:
                away = np.round((y - y[route, pick][:, None]) ** 2 + (x - x[route, pick][:, None]) ** 2, 12)
                # slots are in order of ids, and the first of equal distances is taken
                pick = np.argmin(np.where(left, away, np.inf), axis=1)
            left[route, pick] = False
            works.append(route[going])
            places.append(place[at[route, pick][going]])
            pos.append(np.full(going.sum(), step, dtype=np.int32))
        work = batch.column("work").to_numpy(zero_copy_only=False)[np.concatenate(works)]
        yield pa.RecordBatch.from_arrays([pa.array(work), pa.array(np.concatenate(places)), pa.array(np.concatenate(pos))], names=["work", "place", "pos"])
