"""Association of detections with tracks: greedy nearest match within a distance, one state for each stream."""

from __future__ import annotations

import math


class Tracker:
    """Tracks by number: their last place and how many frames ago it was seen."""

    def __init__(self, reach: float = 50.0, patience: int = 15, tracks: dict[int, list[float]] | None = None, following: int = 1) -> None:
        self.reach, self.patience, self.following = reach, patience, following
        self.tracks = tracks or {}

    def update(self, points: list[tuple[float, float]]) -> list[int]:
        """The track of each point of a frame; new tracks for points that no free track is near.

        Nearest pairs first, ties by track, then by point. Tracks unseen for more than `patience` frames end.
        """
        pairs = sorted((math.dist(p, t[:2]), k, i) for i, p in enumerate(points) for k, t in self.tracks.items())
        given: dict[int, int] = {}
        for distance, track, i in pairs:
            if distance <= self.reach and i not in given and track not in given.values():
                given[i] = track
        for i in range(len(points)):
            if i not in given:
                given[i] = self.following
                self.following += 1
        for track in self.tracks.values():
            track[2] += 1
        for i, track in given.items():
            self.tracks[track] = [points[i][0], points[i][1], 0]
        self.tracks = {k: t for k, t in self.tracks.items() if t[2] <= self.patience}
        return [given[i] for i in range(len(points))]


def hook(row: dict, context: dict) -> None:
    """A stateful frame hook: points (array of x, y) to track_ids."""
    tracker = context["state"].setdefault("tracker", Tracker())
    points = row["points"] if row["points"] is not None else []
    row["track_ids"] = tracker.update([(float(p[0]), float(p[1])) for p in points])
