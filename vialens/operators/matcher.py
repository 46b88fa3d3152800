"""Places of a vehicle along route shapes: passes of a point, a beam of hypotheses, and when to commit to one."""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cached_property
from typing import NamedTuple

import numpy as np

from vialens import constants as C

FAR = 1.7976931348623157e308


@dataclass
class Shape:
    """A polyline in metres with the distance along it, and the stops on it."""

    id: str
    route_ix: int
    direction: int
    x: np.ndarray
    y: np.ndarray
    cum: np.ndarray
    circular: bool = False
    headsign: str = ""
    planned: float = 6.0
    stops: list[tuple[float, str]] = field(default_factory=list)

    @cached_property
    def length(self) -> float:
        return float(self.cum[-1])

    @cached_property
    def _columns(self) -> tuple[list[float], list[float], list[float]]:
        return self.x.tolist(), self.y.tolist(), self.cum.tolist()

    def at(self, along: float) -> tuple[float, float]:
        """The point at a distance along the shape, its ends beyond them."""
        x, y, cum = self._columns
        if along <= cum[0]:
            return x[0], y[0]
        if along >= cum[-1]:
            return x[-1], y[-1]
        k = bisect_right(cum, along) - 1
        share = (along - cum[k]) / (cum[k + 1] - cum[k])
        return x[k] + share * (x[k + 1] - x[k]), y[k] + share * (y[k + 1] - y[k])

    def bearing(self, along: float) -> float:
        (ax, ay), (bx, by) = self.at(along - 15.0), self.at(along + 15.0)
        return math.degrees(math.atan2(bx - ax, by - ay)) % 360.0

    def next_stop(self, along: float) -> int | None:
        return next((k for k, (d, _) in enumerate(self.stops) if d > along - 5.0), None)

    def gap(self, start: float, end: float) -> float:
        """Metres from one place to another, the short way round on a loop."""
        d, n = end - start, self.length
        if not self.circular or n <= 1.0:
            return d
        d = math.fmod(d, n)
        return d - n if d > n / 2 else d + n if d < -n / 2 else d

    @cached_property
    def _segments(self) -> tuple[np.ndarray, ...]:
        """Number, start, steps, squared length (1 for none), and distance along of each segment."""
        dx, dy = np.diff(self.x), np.diff(self.y)
        square = dx * dx + dy * dy
        return np.arange(len(dx)), self.x[:-1], self.y[:-1], dx, dy, np.where(square > 0, square, 1.0), self.cum[:-1], np.diff(self.cum)

    @cached_property
    def _box(self) -> tuple[float, float, float, float]:
        return float(self.x.min()), float(self.y.min()), float(self.x.max()), float(self.y.max())

    @cached_property
    def _cells(self) -> dict[tuple[int, int], tuple[np.ndarray, ...]]:
        return {}

    def _near_cell(self, px: float, py: float, radius: float) -> tuple[np.ndarray, ...]:
        """The segments whose box, ``radius`` wider, touches the point's grid cell; found once a cell and radius."""
        size = 2 * radius
        cell = (math.floor(px / size), math.floor(py / size), radius)
        if cell not in self._cells:
            number, ax, ay, dx, dy, *_ = self._segments
            x0, y0 = cell[0] * size - radius, cell[1] * size - radius
            x1, y1 = x0 + size + 2 * radius, y0 + size + 2 * radius
            met = (np.minimum(ax, ax + dx) <= x1) & (np.maximum(ax, ax + dx) >= x0) & (np.minimum(ay, ay + dy) <= y1) & (np.maximum(ay, ay + dy) >= y0)
            self._cells[cell] = tuple(c[met] for c in self._segments)
        return self._cells[cell]

    def passes(self, px: float, py: float, radius: float = C.TENTATIVE_M) -> list[tuple[float, float]]:
        """(distance, along) of the nearest point of each run of segments within ``radius``, nearest first, at most four."""
        x0, y0, x1, y1 = self._box
        if not (x0 - radius <= px <= x1 + radius and y0 - radius <= py <= y1 + radius):
            return []
        number, ax, ay, dx, dy, square, cum, step = self._near_cell(px, py, radius)
        rx, ry = px - ax, py - ay
        share = np.minimum(np.maximum((rx * dx + ry * dy) / square, 0.0), 1.0)
        dist = np.hypot(rx - share * dx, ry - share * dy)
        near = np.flatnonzero(dist <= radius)
        if not len(near):
            return []
        runs: list[list] = []  # first and last segment, least distance and where
        for k, d, a in zip(number[near].tolist(), dist[near].tolist(), (cum[near] + share[near] * step[near]).tolist(), strict=True):
            if runs and runs[-1][1] == k - 1:
                runs[-1][1] = k
                if d < runs[-1][2]:
                    runs[-1][2:] = d, a
            else:
                runs.append([k, k, d, a])
        if self.circular and len(runs) > 1 and runs[0][0] == 0 and runs[-1][1] == len(self.x) - 2:
            last = runs.pop()  # one pass over the place where the loop closes
            if last[2] < runs[0][2]:
                runs[0][2:] = last[2:]
        return sorted((d, a) for _, _, d, a in runs)[: C.PER_SHAPE]


class Hyp(NamedTuple):
    """A place that the vehicle may be at: mean cost, last distance from the shape, metres and steps advanced since the last step back."""

    shape: str
    along: float
    lap: int
    cost: float
    dist: float
    progress: float
    fixes: int


class Motion(NamedTuple):
    """What a fix says: where, how far from the last one, whether that gap means anything, and the heading of a moving vehicle."""

    x: float
    y: float
    travelled: float
    usable: bool
    heading: float | None


def _continued(old: Hyp, shape: Shape, dist: float, along: float, base: float, m: Motion) -> Hyp:
    gap = shape.gap(old.along, along)
    back = gap < -C.BACKWARD_M
    extra = max(abs(gap - m.travelled) - C.SLACK_M, 0.0) * C.MOTION_WEIGHT + C.BACKWARD_COST * back if m.usable else 0.0
    progress, fixes = old.progress, old.fixes
    if m.usable:
        progress, fixes = (0.0, 0) if back else (progress + max(gap, 0.0), min(fixes + 1, 255))
    lap = old.lap + (shape.circular and along < old.along and gap > 0)
    return Hyp(shape.id, along, lap, C.DECAY * old.cost + (1 - C.DECAY) * (base + extra), dist, progress, fixes)


def advance(beam: list[Hyp], shapes: list[Shape], m: Motion) -> list[Hyp]:
    """The beam after a fix: for each pass the cheapest of a fresh start and of the continued hypotheses of its shape; of those
    within 300 m on one shape the cheapest stays; the cheapest four in all. Without a pass the beam stays, far from its shapes."""
    found = []
    for s in shapes:
        for dist, along in s.passes(m.x, m.y):
            turn = 0.0
            if m.heading is not None:
                d = abs(m.heading - s.bearing(along)) % 360.0
                turn = min(d, 360.0 - d) * C.HEADING_WEIGHT
            base = dist + turn
            options = [_continued(h, s, dist, along, base, m) for h in beam if h.shape == s.id]
            options.append(Hyp(s.id, along, 0, base + C.SPAWN, dist, 0.0, 0))
            found.append(min(options, key=lambda h: h.cost))
    if not found:
        return [h._replace(dist=FAR) for h in beam]
    kept: list[Hyp] = []
    for h in sorted(found, key=lambda h: (h.cost, h.shape)):
        if all(k.shape != h.shape or abs(k.along - h.along) >= C.SEPARATION_M for k in kept):
            kept.append(h)
    return kept[: C.BEAM]


def committed(beam: list[Hyp]) -> Hyp | None:
    """The best hypothesis if it has advanced enough and the first rival elsewhere costs clearly more."""
    if not beam:
        return None
    best = beam[0]
    if best.progress < C.PROGRESS_M or best.fixes < C.FIXES or best.dist > C.TENTATIVE_M:
        return None
    rival = next((h for h in beam[1:] if h.shape != best.shape or abs(h.along - best.along) > C.SEPARATION_M), None)
    return None if rival and rival.cost < best.cost + C.MARGIN else best
