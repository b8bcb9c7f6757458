"""Turns between lines: the shortest path of bounded curvature from one heading to another."""

from __future__ import annotations

import math

WORDS = ("LSL", "RSR", "LSR", "RSL", "LRL", "RLR")


def _solve(word: str, d: float, a: float, b: float) -> tuple[float, float, float] | None:
    """Lengths of the three pieces, radius one, from (0, 0) at heading a to (d, 0) at heading b; None where the word does not fit."""
    turn = lambda x: x % (2 * math.pi)
    left = {"L": 1, "R": -1}
    first, last = left[word[0]], left[word[2]]
    # Centres of the first and last circles.
    x0, y0 = -first * math.sin(a), first * math.cos(a)
    x1, y1 = d - last * math.sin(b), last * math.cos(b)
    gap, way = math.hypot(x1 - x0, y1 - y0), math.atan2(y1 - y0, x1 - x0)
    if word[1] == "S":
        if first == last:
            heading, straight = way, gap
        else:
            if gap < 2:
                return None
            straight = math.sqrt(gap * gap - 4)
            heading = way + first * math.atan2(2, straight)
        return turn(first * (heading - a)), straight, turn(last * (b - heading))
    if gap > 4:
        return None
    # The middle circle touches both: it stands off the line of centres by an angle whose cosine is gap / 4.
    best = None
    for side in (1, -1):
        off = way + side * math.acos(gap / 4)
        touch0 = off  # from the first centre to the middle one
        mx, my = x0 + 2 * math.cos(off), y0 + 2 * math.sin(off)
        touch1 = math.atan2(y1 - my, x1 - mx)
        h0 = touch0 + first * math.pi / 2  # heading at the first touch
        h1 = touch1 + math.pi + last * math.pi / 2  # heading at the second touch, seen from the last circle
        lengths = turn(first * (h0 - a)), turn(-first * (h1 - h0)), turn(last * (b - h1))
        if best is None or sum(lengths) < sum(best):
            best = lengths
    return best


def turn_path(start: tuple[float, float, float], end: tuple[float, float, float], radius: float) -> tuple[str, tuple[float, float, float]]:
    """Word and lengths in metres of the shortest path between (x, y, heading in radians from the x axis); the first word wins ties."""
    dx, dy = (end[0] - start[0]) / radius, (end[1] - start[1]) / radius
    way = math.atan2(dy, dx)
    found = [(w, s) for w in WORDS if (s := _solve(w, math.hypot(dx, dy), start[2] - way, end[2] - way))]
    word, lengths = min(found, key=lambda f: sum(f[1]))
    return word, tuple(x * radius for x in lengths)


def turn_points(start: tuple[float, float, float], word: str, lengths: tuple[float, float, float], radius: float, step: float = 5.0) -> list[tuple[float, float]]:
    """Points along a path, at most ``step`` apart, with its start and end."""
    x, y, h = start
    out = [(x, y)]
    for kind, length in zip(word, lengths, strict=True):
        n = max(1, math.ceil(length / step))
        bend = {"L": 1, "R": -1, "S": 0}[kind] / radius
        for _ in range(n):
            s = length / n
            if bend:
                x += (math.sin(h + bend * s) - math.sin(h)) / bend
                y -= (math.cos(h + bend * s) - math.cos(h)) / bend
                h += bend * s
            else:
                x, y = x + s * math.cos(h), y + s * math.sin(h)
            out.append((x, y))
    return out
