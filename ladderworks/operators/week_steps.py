"""One week of the rating engine on a bucket of players, as arrays: what the players tell each other, and their update.

A row holds many records of one kind as bytes, so that a week is one shuffle of few rows to their buckets. Kinds: ``STATE`` of a
bucket's players under all configurations as a run begins, ``HELD`` the same from then on, ``TOLD`` (what opponents of one bucket
tell players of another), ``SIDE`` of a week's matches to come (who tells whom which score), and ``DONE`` (what a week gives,
carried unread to the end of the chain). HELD and TOLD have a player once, with a value for each configuration.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ladderworks.functions.scoring import SCALE

STATE, TOLD, SIDE, DONE, HELD = range(5)
#: What the weeks give: records of all known players, what matches read of theirs, or sums of the scores of predictions.
STATES, READS, SCORES = range(3)
SCHEMA = "bucket int, kind int, week int, data binary"
#: A record's fields by kind: week (when a state's player was seen, 0 for never), other (side: who is told; done: when seen), x, y, z
#: (mu, phi, sigma; side: score of who is told, NaN without one), start (where a new player starts), home (whether who is told is
#: at home), and pre_mu, pre_phi (done: what the week's matches read).
FIELDS = {
    STATE: {"config": "<i4", "week": "<i4", "pid": "<i8", "x": "<f8", "y": "<f8", "z": "<f8", "start": "<f8"},
    SIDE: {"pid": "<i8", "other": "<i8", "x": "<f8", "home": "|b1"},
    DONE: {"config": "<i4", "other": "<i4", "pid": "<i8", "x": "<f8", "y": "<f8", "z": "<f8", "pre_mu": "<f8", "pre_phi": "<f8"},
}
#: Sums of the scores of predictions by configuration, as `evaluate.sums` names them.
SUMS = ("n", "scored", "loss", "squares", "hits", "decided")


def packed(kind: int, columns: dict[str, np.ndarray]) -> bytes:
    """Records as bytes, column after column."""
    return b"".join(np.ascontiguousarray(columns[n], t).tobytes() for n, t in FIELDS[kind].items())


def unpacked(kind: int, parts: list[bytes]) -> dict[str, np.ndarray]:
    size = sum(np.dtype(t).itemsize for t in FIELDS[kind].values())
    found: dict[str, list[np.ndarray]] = {n: [np.zeros(0, t)] for n, t in FIELDS[kind].items()}
    for data in parts:
        n, at = len(data) // size, 0
        for name, t in FIELDS[kind].items():
            found[name].append(np.frombuffer(data, t, n, at))
            at += n * np.dtype(t).itemsize
    return {n: np.concatenate(x) for n, x in found.items()}


def rows_of_table(rows: list[tuple]) -> pa.Table:
    """Rows (bucket, kind, week, data) as a table."""
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "week", "data"])


def pack_group(kind: int, key: tuple, table: pa.Table) -> pa.Table:
    """A bucket's records of one kind and week as one row."""
    return rows_of_table([(key[0].as_py(), kind, key[1].as_py(), packed(kind, {n: table.column(n).to_numpy() for n in FIELDS[kind]}))])


def history(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of players after weeks, one row each."""
    for batch in batches:
        for week, data in zip(batch.column("week").to_pylist(), batch.column("data"), strict=True):
            d = unpacked(DONE, [data.as_py()])
            real = lambda x: pa.array(x, mask=np.isnan(x))
            columns = {"config": pa.array(d["config"]), "pid": pa.array(d["pid"]), "week": pa.array(np.full(len(d["pid"]), week, np.int32)), "mu": pa.array(d["x"]), "phi": pa.array(d["y"]), "sigma": pa.array(d["z"]), "seen": pa.array(d["other"]), "start_mu": real(d["pre_mu"]), "start_phi": real(d["pre_phi"])}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def reads(count: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a week's matches read of its players, a row for each with a value for each of ``count`` configurations."""
    for batch in batches:
        for week, data in zip(batch.column("week").to_pylist(), batch.column("data"), strict=True):
            data = data.as_py()
            n = len(data) // (8 + 16 * count)
            values = np.frombuffer(data, "<f8", 2 * n * count, 8 * n)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * count)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (values[: n * count], values[n * count :])]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data, "<i8", n)), pa.array(np.full(n, week, np.int32)), *lists], ["pid", "week", "start_mu", "start_phi"])


def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's sums of scores of a week, a row for each configuration."""
    for batch in batches:
        for week, data in zip(batch.column("week").to_pylist(), batch.column("data"), strict=True):
            sums = np.frombuffer(data.as_py(), "<f8").reshape(-1, len(SUMS))
            whole = lambda name, x: x.astype(np.int64) if name in ("n", "scored", "decided") else x
            columns = {"config": np.arange(len(sums), dtype=np.int32), "yyyyww": np.full(len(sums), week, np.int32)} | {n: whole(n, sums[:, k].copy()) for k, n in enumerate(SUMS)}
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _g(phi: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt(1 + 3 * phi * phi / math.pi**2)


#: Fixed value: so many equations are solved at once; their arrays stay in a core's cache.
AT_ONCE = 4096


def new_sigma(sigma: np.ndarray, phi: np.ndarray, variance: np.ndarray, delta: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """The roots of the volatility equation."""
    cuts = range(0, len(sigma), AT_ONCE)
    return np.concatenate([np.zeros(0), *[_roots(*[x[k : k + AT_ONCE] for x in (sigma, phi, variance, delta, tau)]) for k in cuts]])


def _roots(sigma: np.ndarray, phi: np.ndarray, variance: np.ndarray, delta: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """By false position with halving, to 1e-6 of the logarithm. Equations that are solved take no part in further rounds."""
    a, fixed, square, slope = np.log(sigma * sigma), phi * phi + variance, delta * delta, tau**2

    def f(x: np.ndarray) -> np.ndarray:
        e = np.exp(x)
        total = fixed + e
        return e * (square - total) / (2 * total * total) - (x - a) / slope

    gap = square - phi * phi - variance
    low, steps = a - tau, 1
    while steps < 40 and (wide := (f(low) < 0) & (gap <= 0)).any():
        steps += 1
        low = np.where(wide, a - steps * tau, low)
    left, right = a, np.where(gap > 0, np.log(np.maximum(gap, 1e-300)), low)
    f_left, f_right = f(left), f(right)
    out, rows = np.zeros(len(a)), np.arange(len(a))
    for _ in range(60):
        live = np.abs(right - left) > 1e-6
        if not live.all():
            out[rows[~live]] = left[~live]
            rows, left, right, f_left, f_right, a, fixed, square, slope = (x[live] for x in (rows, left, right, f_left, f_right, a, fixed, square, slope))
        if not len(rows):
            break
        flat = np.abs(f_right - f_left) < 1e-300
        c = np.where(flat, right, left + (left - right) * f_left / np.where(flat, 1.0, f_right - f_left))
        f_c = f(c)
        crossed = f_c * f_right <= 0
        left, f_left = np.where(crossed, right, left), np.where(crossed, f_right, f_left / 2)
        right, f_right = c, f_c
    out[rows] = left
    return np.exp(out / 2)


class Bucket:
    """The rows of one bucket of players by kind. ``names`` are those of the buckets (their number, if they are named from 0 on); a
    player is in the one at the place of the rest of the id. ``gives`` says what is done.

    x, y, z, start: a row for each player (``pids``, sorted), a column for each configuration; start is nothing where all is 0.
    A player was last ``seen`` in the same week under all of them.
    """

    def __init__(self, table: pa.Table, settings: dict[str, np.ndarray], names: list[int] | int, gives: int = STATES):
        self.bucket = table.column("bucket")[0].as_py()
        rows = sorted(zip(table.column("kind").to_pylist(), table.column("week").to_pylist(), table.column("data").to_pylist(), strict=True), key=lambda r: r[:2])
        self.set, self.names, self.count, self.gives = settings, np.arange(names) if isinstance(names, int) else np.array(names), len(settings["tau"]), gives
        held = [d for k, _, d in rows if k == HELD]
        if held:
            self._held(held[0])
        else:
            self._begin([d for k, _, d in rows if k == STATE])
        self.messages = [d for k, _, d in rows if k == TOLD]
        self.rest = [(self.bucket, k, w, d) for k, w, d in rows if k in (SIDE, DONE)]

    def _begin(self, records: list[bytes]) -> None:
        s = unpacked(STATE, records)
        order = np.lexsort((s["config"], s["pid"]))
        self.pids, self.seen = (s[n][order][:: self.count].copy() for n in ("pid", "week"))
        self.x, self.y, self.z, start = (s[n][order].reshape(-1, self.count) for n in ("x", "y", "z", "start"))
        self.start = start if start.any() else None

    def _held(self, data: bytes) -> None:
        n, parts = np.frombuffer(data, "<i8", 2).tolist()
        self.pids, self.seen = np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, "<i4", n, 16 + 8 * n).copy()
        values = np.frombuffer(data, "<f8", n * parts * self.count, 16 + 8 * n + 4 * n).reshape(parts, n, self.count)
        self.x, self.y, self.z = (v.copy() for v in values[:3])
        self.start = values[3] if parts == 4 else None

    def _state(self) -> bytes:
        values = [v for v in (self.x, self.y, self.z, self.start) if v is not None]
        return b"".join((np.array([len(self.pids), len(values)], "<i8").tobytes(), self.pids.tobytes(), self.seen.tobytes(), *[v.tobytes() for v in values]))

    def tell(self, week: int, gaps: dict[int, int], elapsed: int) -> None:
        """The states as the week's matches read them, and what its players tell their opponents. gaps: weeks from a week to this one.
        Without a score only players who have others in that week tell."""
        now = lambda r: r[1] == SIDE and r[2] == week
        sides = unpacked(SIDE, [r[3] for r in self.rest if now(r)])
        self.rest = [r for r in self.rest if not now(r)]
        plays = np.isin(self.pids, sides["pid"][~np.isnan(sides["x"])])
        distinct, back = np.unique(self.seen, return_inverse=True)
        absent = np.array([gaps[w] if w else 0 for w in distinct.tolist()], np.int64)[back] if len(self.seen) else np.zeros(0, np.int64)
        over = lambda weeks: np.maximum(0, weeks - self.set["grace"])
        if (self.set["decay"] > 0).any():
            gap = absent[~plays, None]
            self.x[~plays] -= self.set["decay"] / SCALE * (over(gap) - over(gap - elapsed))
        p, reseed = np.flatnonzero(plays), self.set["reseed_after"]
        anew = (self.seen[p] == 0)[:, None] | ((reseed > 0) & (absent[p, None] >= reseed))
        gap = np.where(anew, 0, absent[p, None])
        phi, sigma = np.where(anew, self.set["rd"] / SCALE, self.y[p]), np.where(anew, self.set["sigma"], self.z[p])
        mu = np.where(anew, 0.0 if self.start is None else self.start[p], self.x[p])
        phi = np.sqrt(phi * phi + gap * (sigma * sigma + self.set["drift"] ** 2))
        self.x[p], self.y[p], self.z[p], self.seen[p] = mu, phi, sigma, week
        who, weight = self.pids[p], _g(phi)
        sides = {n: c[np.isin(sides["pid"], who)] for n, c in sides.items()}
        at, to = np.searchsorted(who, sides["pid"]), self.names[sides["other"] % len(self.names)]
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
        for part in np.split(order, cuts[1:]) if len(order) else []:
            data = b"".join((sides["other"][part].tobytes(), sides["x"][part].tobytes(), mu[at[part]].tobytes(), weight[at[part]].tobytes(), sides["home"][part].tobytes()))
            # The week of a message is the bucket that sends it: rows are read in its order, so sums are the same each time.
            self.rest.append((int(to[part[0]]), TOLD, self.bucket, data))

    def _told(self) -> list[np.ndarray]:
        """What players were told: who, score, the opponent's mu and weight by configuration, and whether who is told is at home."""
        c, found = self.count, []
        for data in self.messages:
            n = len(data) // (17 + 16 * c)
            values = np.frombuffer(data, "<f8", 2 * n * c, 16 * n).reshape(2, n, c)
            found.append((np.frombuffer(data, "<i8", n), np.frombuffer(data, "<f8", n, 8 * n), *values, np.frombuffer(data, "|b1", n, 16 * n + 16 * n * c)))
        none = (np.zeros(0, "<i8"), np.zeros(0), np.zeros((0, c)), np.zeros((0, c)), np.zeros(0, "|b1"))
        return [np.concatenate(x) for x in zip(none, *found, strict=True)]

    def update(self, week: int) -> None:
        """The states after the week, from what its players were told, and what the week gives."""
        told, score, mu, weight, home = self._told()
        real = ~np.isnan(score)
        # Of matches without a score those are predicted whose players both have others in the week.
        order = np.flatnonzero(real | np.isin(told, told[real]))
        at = np.searchsorted(self.pids, told[order])
        rank = np.argsort(at, kind="stable")
        order, at = order[rank], at[rank]
        score, mu, weight, home, real = score[order], mu[order], weight[order], home[order], real[order]
        own = self.x[at]
        chance = _logistic(weight * (own - mu))
        sums = _scored(chance[home], score[home]) if self.gives == SCORES else None
        if not real.all():
            at, score, mu, weight, own, chance = (x[real] for x in (at, score, mu, weight, own, chance))
        part, surprise = weight * weight * chance * (1 - chance), weight * (score[:, None] - chance)
        scale, most, k = (self.set[c] for c in ("info_scale", "upset_max", "upset_k"))
        gate = (most > 0) & (k > 0)
        lead = SCALE * (mu - own) if (scale > 0).any() or gate.any() else None
        if (scale > 0).any():
            part = np.where(scale > 0, part * _logistic(lead / np.where(scale > 0, scale, 1)), part)
        if gate.any():
            quality = most / (1 + (most - 1) * np.exp(np.clip(-k * lead, -700, 700)))
            surprise = np.where(gate & (surprise > 0), surprise * quality, surprise)
        who, first, games = np.unique(at, return_index=True, return_counts=True)
        damp = np.sqrt(games)[:, None]
        i, total = (np.add.reduceat(x, first, axis=0) / damp if len(first) else x for x in (part, surprise))
        pre_mu, pre_phi = self.x[who], self.y[who]
        moved = i > 0
        row, config = np.nonzero(moved)
        cell, info, total = (who[row], config), i[moved], total[moved]
        phi = self.y[cell]
        sigma = np.minimum(self.set["max_sigma"][config], new_sigma(self.z[cell], phi, 1 / info, total / info, self.set["tau"][config]))
        phi = 1 / np.sqrt(1 / (phi**2 + sigma**2) + info)
        self.x[cell] += phi * phi * total
        self.y[cell], self.z[cell] = phi, sigma
        if self.gives == SCORES:
            data = sums.tobytes()
        elif self.gives == READS:
            data = b"".join((self.pids[who].tobytes(), pre_mu.tobytes(), pre_phi.tobytes()))
        else:
            data = self._known(who, pre_mu, pre_phi)
        self.rest.append((self.bucket, DONE, week, data))

    def _known(self, who: np.ndarray, pre_mu: np.ndarray, pre_phi: np.ndarray) -> bytes:
        """A record of each known player under each configuration."""
        read = {n: np.full(self.x.shape, np.nan) for n in ("pre_mu", "pre_phi")}
        read["pre_mu"][who], read["pre_phi"][who] = pre_mu, pre_phi
        known = self.seen > 0
        n = int(known.sum())
        each = lambda x: np.repeat(x[known], self.count)
        done = {"config": np.tile(np.arange(self.count), n), "other": each(self.seen), "pid": each(self.pids)}
        return packed(DONE, done | {n: x[known].ravel() for n, x in {"x": self.x, "y": self.y, "z": self.z, **read}.items()})

    def table(self) -> pa.Table:
        return rows_of_table([(self.bucket, HELD, 0, self._state()), *self.rest])


def _scored(p: np.ndarray, actual: np.ndarray) -> np.ndarray:
    """``SUMS`` of predictions by configuration (columns of p)."""
    n, real = len(p), ~np.isnan(actual)
    p, actual = p[real], actual[real][:, None]
    q = np.clip(p, 1e-12, 1 - 1e-12)
    clear = actual[:, 0] != 0.5
    hits = (p[clear] >= 0.5) == (actual[clear] == 1.0)
    loss = -(actual * np.log(q) + (1 - actual) * np.log(1 - q))
    each = lambda v: np.full(p.shape[1], float(v))
    return np.stack([each(n), each(len(p)), loss.sum(axis=0), ((p - actual) ** 2).sum(axis=0), hits.sum(axis=0).astype(float), each(clear.sum())], axis=1)
