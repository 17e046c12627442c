"""Plain models of the index rules, written for the tests."""

from __future__ import annotations

import math


def dp(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def greedy(members: list[tuple[int, str]], radius: int) -> list[tuple[int, str]]:
    """(id, sequence) in ascending order -> those farther than the radius from all before them."""
    found: list[tuple[int, str]] = []
    for i, s in members:
        if all(dp(s, c) > radius for _, c in found):
            found.append((i, s))
    return found


def rc(s: str) -> str:
    return s.upper()[::-1].translate(str.maketrans("ACGT", "TGCA"))


class Tree:
    def __init__(self, windows: list[str], radii, ratios, t: int):
        self.windows, self.t, self.layers, self.stats = windows, t, [], []
        parents = [list(range(len(windows)))]
        memo: dict = {}

        def d(a: int, b: int) -> int:
            key = (windows[a], windows[b])
            if key not in memo:
                memo[key] = memo[key[::-1]] = dp(*key)
            return memo[key]

        for radius, ratio in zip(radii, ratios, strict=True):
            worlds, counts = [], dict(center=0, table=0, mb=0, cand=0, pairs=0, pruned=0, members=0)
            for p, members in enumerate(parents):
                centers: list[int] = []
                for m in members:
                    for k, c in enumerate(centers):
                        if d(m, c) <= radius:
                            counts["center"] += k + 1
                            break
                    else:
                        counts["center"] += len(centers)
                        centers.append(m)
                k = math.ceil(ratio * len(centers))
                beacons = [b * len(centers) // k for b in range(k)]
                counts["table"] += k * len(centers)
                inside = [[c] for c in centers]
                for m in members:
                    if m in centers:
                        continue
                    counts["members"] += 1
                    counts["pairs"] += len(centers)
                    counts["mb"] += k
                    near = [d(m, c) for c in centers]
                    for i, x in enumerate(near):
                        if i not in beacons:
                            low = max((abs(near[b] - d(centers[i], centers[b])) for b in beacons), default=0)
                            if k and low > min(near[b] for b in beacons) + 2 * t:
                                counts["pruned"] += 1
                            else:
                                counts["cand"] += 1
                        if x <= min(near) + 2 * t:
                            inside[i].append(m)
                worlds += [(p, c, sorted(w)) for c, w in zip(centers, inside, strict=True)]
            self.layers.append(worlds)
            self.stats.append(counts)
            parents = [w for _, _, w in worlds]

    def hits(self, read: str, t: int) -> set:
        parent = 0
        for worlds in self.layers:
            parent = min((dp(read, self.windows[c]), k) for k, (p, c, _) in enumerate(worlds) if p == parent)[1]
        return {(m, x) for m in self.layers[-1][parent][2] if (x := dp(read, self.windows[m])) <= t}


def brute(windows: list[str], read: str, t: int) -> set:
    return {(k, x) for k, w in enumerate(windows) if (x := dp(read, w)) <= t}
