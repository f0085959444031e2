"""Steps of the heat diffusion on blocks of vertices and weeks: what vertices send along their edges, and what they hold then.

A block is a range of weeks and a range of vertices. All rows have it (part, bucket), a place in their order, and bytes, column
after column: an edge is never written out for each week whose window holds it, and a block's edges are sorted and numbered
once, for all steps. What doesn't change (``FIELDS``) stays where it is; only flows, a number for each receiver and week, move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

ROWS = "part int, bucket int, place int, data binary"
#: What a block has. kind: bit 1 where the vertex is one of the week's, bit 2 where it has edges there (rows are weeks); total: the
#: weight of its edges. ``at`` and ``to`` of an edge, sorted by Sunday, are places among pids and receivers; cuts: the edges of each week's window.
FIELDS = {"pids": "<i8", "receivers": "<i8", "kind": "|u1", "total": "<f8", "seed": "<f8", "cuts": "<i8", "at": "<i4", "to": "<i4", "weight": "<f8"}
#: An edge, or a vertex of a week, on its way to its blocks.
EDGE, VERTEX = {"day": "<i4", "pid": "<i8", "opponent": "<i8", "weight": "<f8", "heat": "<f8"}, {"day": "<i4", "pid": "<i8"}
#: Bytes of a row, and receivers of one.
SIZE, AT_ONCE = 8 << 20, 16384
#: The receiver of what goes to nobody.
NOBODY = -(2**63)


def saturated(heat: np.ndarray, half: float) -> np.ndarray:
    heat = np.maximum(heat, 0.0)
    return heat / (heat + half)


def _table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "bucket", "place", "data"])


def _records(parts: list[bytes], fields: dict[str, str]) -> dict[str, np.ndarray]:
    size = sum(np.dtype(t).itemsize for t in fields.values())
    found: dict[str, list[np.ndarray]] = {c: [np.zeros(0, t)] for c, t in fields.items()}
    for data in parts:
        n, at = len(data) // size, 0
        for c, t in fields.items():
            found[c].append(np.frombuffer(data, t, n, at))
            at += n * np.dtype(t).itemsize
    return {c: np.concatenate(x) for c, x in found.items()}


class Steps:
    """``days`` has the Sundays of all weeks, ``size`` of them to a block, ``span`` the days of a window; ``bounds`` the first vertex of
    each range but the first."""

    def __init__(self, days: list[int], size: int, span: int, bounds: list[int], damping: float, saturate: Callable[[np.ndarray], np.ndarray]):
        self.days, self.size, self.span, self.bounds, self.damping, self.saturate = np.array(days), size, span, np.array(bounds, np.int64), damping, saturate

    def _days(self, part: int) -> np.ndarray:
        return self.days[part * self.size : (part + 1) * self.size]

    def deal(self, edges: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges, or vertices of weeks, to the blocks that they are in: an edge to each range of weeks whose windows hold it."""
        fields = EDGE if edges else VERTEX
        for batch in batches:
            cells = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(t, copy=False) for c, t in fields.items()}
            order = np.lexsort((cells["day"], np.searchsorted(self.bounds, cells["pid"], "right")))
            cells = {c: x[order] for c, x in cells.items()}
            bucket, rows = np.searchsorted(self.bounds, cells["pid"], "right"), []
            for part in range(-(-len(self.days) // self.size)):
                first, last = self._days(part)[[0, -1]]
                inside = np.flatnonzero((first < cells["day"] + (self.span if edges else 1)) & (last >= cells["day"]))
                for own in np.split(inside, np.flatnonzero(np.diff(bucket[inside])) + 1) if len(inside) else []:
                    rows.append((part, int(bucket[own[0]]), int(edges), b"".join(x[own].tobytes() for x in cells.values())))
            yield from _table(rows).to_batches()

    def begin(self, key: tuple, table: pa.Table) -> pa.Table:
        """A block's vertices, those of its weeks and those with edges in their windows, with their seeds, and its edges."""
        part, bucket = (k.as_py() for k in key)
        days, place, data = self._days(part), table.column("place").to_pylist(), table.column("data").to_pylist()
        own, e = (_records([d for p, d in zip(place, data, strict=True) if p == k], f) for k, f in ((0, VERTEX), (1, EDGE)))
        del data
        e = {c: x[order] for order in [np.lexsort((e["opponent"], e["pid"], e["day"]))] for c, x in e.items()}
        cuts = np.stack([np.searchsorted(e["day"], days - self.span, "right"), np.searchsorted(e["day"], days, "right")], axis=1)
        pids = np.unique(np.concatenate([e["pid"], own["pid"]]))
        receivers, to = np.unique(e["opponent"], return_inverse=True)
        n, at = len(pids), np.searchsorted(pids, e["pid"])
        kind, total, heat = np.zeros((len(days), n), np.uint8), np.zeros((len(days), n)), np.zeros((len(days), n))
        for c, (a, b) in enumerate(cuts.tolist()):
            total[c], heat[c] = np.bincount(at[a:b], e["weight"][a:b], n), np.bincount(at[a:b], e["heat"][a:b], n)
            kind[c, np.bincount(at[a:b], minlength=n) > 0] = 2
        kind[np.searchsorted(days, own["day"]), np.searchsorted(pids, own["pid"])] |= 1
        kind[(kind & 2) > 0] |= 1
        seed = np.where(kind & 2, self.saturate(heat), 0.0)
        values = {"pids": pids, "receivers": receivers, "kind": kind, "total": total, "seed": seed, "cuts": cuts, "at": at, "to": to, "weight": e["weight"]}
        rows = []
        for k, (name, kind_of) in enumerate(FIELDS.items()):
            data = np.ascontiguousarray(values.pop(name), kind_of).tobytes()
            rows += [(part, bucket, k << 16 | i, data[i * SIZE : (i + 1) * SIZE]) for i in range(-(-len(data) // SIZE))]
        return _table(rows)

    def _block(self, held: pa.Table) -> dict[str, np.ndarray]:
        rows = sorted(zip(held.column("place").to_pylist(), held.column("data"), strict=True), key=lambda r: r[0])
        found = {c: np.frombuffer(b"".join(d.as_py() for p, d in rows if p >> 16 == k), t) for k, (c, t) in enumerate(FIELDS.items())}
        n = len(found["pids"])
        return found | {c: found[c].reshape(-1, n) for c in ("kind", "total", "seed")} | {"cuts": found["cuts"].reshape(-1, 2)}

    def _settled(self, block: dict[str, np.ndarray], flows: pa.Table | None) -> np.ndarray:
        """A block's heat after a step: what came in, mixed with the seed. A vertex without edges has no seed and keeps none."""
        if flows is None:
            return block["seed"]
        weeks, pids, moved = len(block["seed"]), block["pids"], np.zeros_like(block["seed"])
        rows = sorted(zip(flows.column("place").to_pylist(), flows.column("data"), strict=True), key=lambda r: r[0])
        for _, data in rows:  # by sender, so that sums are the same each time
            data = data.as_py()
            n = len(data) // (8 + 8 * weeks)
            who = np.frombuffer(data, "<i8", n)
            at = np.minimum(np.searchsorted(pids, who), len(pids) - 1)
            known = pids[at] == who
            moved[:, at[known]] += np.frombuffer(data, "<f8", n * weeks, 8 * n).reshape(weeks, n)[:, known]
        return np.clip(self.damping * moved + (1 - self.damping) * block["seed"], 0.0, 1.0)

    def send(self, key: tuple, held: pa.Table, flows: pa.Table | None = None) -> pa.Table:
        """Heat that a block's vertices, after what came in, send in proportion to the weights, summed by receiver."""
        part, bucket = (k.as_py() for k in key)
        if not held.num_rows:
            return _table([])
        block = self._block(held)
        share = np.divide(self._settled(block, flows), block["total"], out=np.zeros_like(block["total"]), where=block["total"] > 0)
        n, at, to, weight, who = len(block["receivers"]), block["at"], block["to"], block["weight"], block["receivers"]
        flow = np.zeros((len(share), n))
        for c, (a, b) in enumerate(block["cuts"].tolist()):
            flow[c] = np.bincount(to[a:b], share[c][at[a:b]] * weight[a:b], n)
        ends = np.unique([int(n and who[0] == NOBODY), *np.searchsorted(who, self.bounds), *range(0, n, AT_ONCE), n])
        rows = []
        for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            if who[a] != NOBODY:
                to_bucket = int(np.searchsorted(self.bounds, who[a], "right"))
                rows.append((part, to_bucket, bucket << 16 | k, who[a:b].tobytes() + np.ascontiguousarray(flow[:, a:b]).tobytes()))
        return _table(rows)

    def end(self, key: tuple, held: pa.Table, flows: pa.Table) -> pa.Table:
        """The vertices of each of a block's weeks, with seed and heat; the place is the week's Sunday."""
        part, bucket = (k.as_py() for k in key)
        if not held.num_rows:
            return _table([])
        block = self._block(held)
        x, rows = self._settled(block, flows), []
        for c, day in enumerate(self._days(part).tolist()):
            own = (block["kind"][c] & 1) > 0
            rows.append((part, bucket, day, block["pids"][own].tobytes() + block["seed"][c, own].tobytes() + x[c, own].tobytes()))
        return _table(rows)


def unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (day, pid, seed, comparability) of vertices by week."""
    for batch in batches:
        for day, data in zip(batch.column("place").to_pylist(), batch.column("data"), strict=True):
            data = data.as_py()
            n = len(data) // 24
            cells = [np.full(n, day, np.int32), np.frombuffer(data, "<i8", n), np.frombuffer(data, "<f8", n, 8 * n), np.frombuffer(data, "<f8", n, 16 * n)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in cells], ["day", "pid", "seed", "comparability"])
