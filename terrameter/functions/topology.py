"""Planar polygon topology: crossing segments, validity, containment and overlapping interiors.

Orientation signs are exact: a floating-point filter decides clear cases, rational arithmetic the
rest.  Candidate segment pairs come from intervals sorted by x, in bounded slabs, so rings with many
vertices need no full pair table.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np

_EPS = 3.4e-16
_SLAB = 1 << 20


def orient(ax, ay, bx, by, cx, cy) -> np.ndarray:
    """Sign of the turn a-b-c: 1 left, -1 right, 0 straight."""
    left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    det = left - right
    at_end = ((cx == ax) & (cy == ay)) | ((cx == bx) & (cy == by))  # the turn is straight, without rounding
    sign = np.where(at_end, 0.0, np.sign(det))
    unsure = np.flatnonzero((np.abs(det) <= _EPS * 4 * (np.abs(left) + np.abs(right))) & ~at_end)
    if len(unsure):
        for i in unsure:
            a, b, c, d, e, f = (Fraction(float(v[i])) for v in np.broadcast_arrays(ax, ay, bx, by, cx, cy))
            exact = (c - a) * (f - b) - (d - b) * (e - a)
            sign[i] = (exact > 0) - (exact < 0)
    return sign


def _close_pairs(s: np.ndarray, t: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of segments (rows x1 y1 x2 y2) whose boxes meet: i < j within s, or s against t."""
    own = t is None
    t = s if own else t
    lo_s, hi_s = np.minimum(s[:, :2], s[:, 2:]), np.maximum(s[:, :2], s[:, 2:])
    lo_t, hi_t = np.minimum(t[:, :2], t[:, 2:]), np.maximum(t[:, :2], t[:, 2:])
    order = np.argsort(lo_t[:, 0], kind="stable")
    reach = float((hi_t[:, 0] - lo_t[:, 0]).max(initial=0.0))
    begin = np.searchsorted(lo_t[order, 0], lo_s[:, 0] - reach, "left")
    n = np.maximum(0, np.searchsorted(lo_t[order, 0], hi_s[:, 0], "right") - begin)
    at = 0
    while at < len(s):
        end = at + max(1, int(np.searchsorted(np.cumsum(n[at:]), _SLAB, "right")))
        i = np.repeat(np.arange(at, min(end, len(s))), n[at:end])
        j = order[np.repeat(begin[at:end] - np.concatenate(([0], np.cumsum(n[at:end])[:-1])), n[at:end]) + np.arange(len(i))]
        ok = (lo_t[j] <= hi_s[i]).all(1) & (hi_t[j] >= lo_s[i]).all(1)
        if own:
            ok &= i < j
        yield i[ok], j[ok]
        at = end


def _meetings(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For aligned rows: whether interiors cross; whether they overlap along a line; whether segments touch at all."""
    a, b, c, d = s[:, :2].T, s[:, 2:].T, t[:, :2].T, t[:, 2:].T
    o1, o2, o3, o4 = orient(*a, *b, *c), orient(*a, *b, *d), orient(*c, *d, *a), orient(*c, *d, *b)
    proper = (o1 * o2 < 0) & (o3 * o4 < 0)
    straight = (o1 == 0) & (o2 == 0) & (o3 == 0) & (o4 == 0)
    axis = (np.abs(b[0] - a[0]) < np.abs(b[1] - a[1])).astype(int)
    pick = lambda p: np.where(axis == 0, p[0], p[1])
    lo = np.maximum(np.minimum(pick(a), pick(b)), np.minimum(pick(c), pick(d)))
    hi = np.minimum(np.maximum(pick(a), pick(b)), np.maximum(pick(c), pick(d)))
    along = straight & (lo < hi)
    touch = proper | along | ((o1 * o2 <= 0) & (o3 * o4 <= 0) & (~straight | (lo <= hi)))
    return proper, along, touch


def _meet(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For aligned rows: whether interiors cross or overlap along a line; whether segments touch at all."""
    proper, along, touch = _meetings(s, t)
    return proper | along, touch


def _segments(ring: np.ndarray) -> np.ndarray:
    """Segments of a closed ring without repeated vertices in a row."""
    keep = np.concatenate(([True], (np.diff(ring, axis=0) != 0).any(1)))
    ring = ring[keep]
    return np.hstack([ring[:-1], ring[1:]])


def signed_area(ring: np.ndarray) -> float:
    p = ring - ring[0]
    return float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum() / 2)


def _placed(points: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places of ``n`` points by the edges a-b that are at the height of each (``row``): 1 inside, 0 on an edge, -1 outside."""
    x, y = points.T
    side = orient(a[:, 0], a[:, 1], b[:, 0], b[:, 1], x, y)
    on = (side == 0) & (np.minimum(a[:, 0], b[:, 0]) <= x) & (x <= np.maximum(a[:, 0], b[:, 0]))
    up = (a[:, 1] <= y) & (b[:, 1] > y) & (side > 0)
    down = (a[:, 1] > y) & (b[:, 1] <= y) & (side < 0)
    winding = np.bincount(row[up], minlength=n) - np.bincount(row[down], minlength=n)
    return np.where(np.bincount(row[on], minlength=n) > 0, 0, np.where(winding != 0, 1, -1))


def inside(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """1 inside, 0 on the boundary, -1 outside, for each point; points in slabs against all edges."""
    out = np.empty(len(points), int)
    a, b = ring[:-1], ring[1:]
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    step = max(1, _SLAB // len(a))
    for at in range(0, len(points), step):
        part = points[at : at + step]
        # only edges at a point's height can hold it or count
        row, edge = np.nonzero((lo[:, 1] <= part[:, 1:]) & (part[:, 1:] <= hi[:, 1]))
        out[at : at + step] = _placed(part[row], row, a[edge], b[edge], len(part))
    return out


def simple_ring(ring: np.ndarray) -> bool:
    """Whether a closed ring meets itself only at shared ends of neighbouring segments."""
    s = _segments(ring)
    n = len(s)
    if n < 3:
        return False
    for i, j in _close_pairs(s):
        deep, touch = _meet(s[i], s[j])
        next_to = (j - i == 1) | (j - i == n - 1)
        if (deep | (touch & ~next_to)).any():
            return False
    return True


def _side(ring: np.ndarray, other: np.ndarray) -> int:
    """Where a ring that does not cross ``other`` lies: 1 inside, -1 outside, 0 undecided."""
    for at in range(0, len(ring) - 1, 64):
        part = ring[at : at + 64]
        middle = (part[:-1] + part[1:]) / 2 if len(part) > 1 else part
        where = inside(np.vstack([part, middle]), other)
        found = where[where != 0]
        if len(found):
            return int(found[0])
    return 0


def _contacts(s: np.ndarray, t: np.ndarray) -> int:
    """Points at which two rings touch; -1 if they cross or share a stretch."""
    points: set[tuple[float, float]] = set()
    for i, j in _close_pairs(s, t):
        deep, touch = _meet(s[i], t[j])
        if deep.any():
            return -1
        for k in np.flatnonzero(touch):
            a, b, c, d = s[i[k], :2], s[i[k], 2:], t[j[k], :2], t[j[k], 2:]
            for p, (q, r) in ((a, (c, d)), (b, (c, d)), (c, (a, b)), (d, (a, b))):
                if orient(*(np.array([v]) for v in (*q, *r, *p)))[0] == 0 and (np.minimum(q, r) <= p).all() and (p <= np.maximum(q, r)).all():
                    points.add((float(p[0]), float(p[1])))
    return len(points)


def valid_polygon(rings: list[np.ndarray]) -> bool:
    """A simple shell with simple holes inside it that do not overlap; single points may touch."""
    if not all(simple_ring(r) for r in rings):
        return False
    segments = [_segments(r) for r in rings]
    for k in range(1, len(rings)):
        if not 0 <= _contacts(segments[0], segments[k]) <= 1 or _side(rings[k], rings[0]) != 1:
            return False
        for m in range(1, k):
            if not 0 <= _contacts(segments[k], segments[m]) <= 1 or _side(rings[k], rings[m]) == 1 or _side(rings[m], rings[k]) == 1:
                return False
    return True


def _expand(of: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, member) for every member begin..begin+n of what each row is ``of``."""
    size = n[of]
    row = np.repeat(np.arange(len(of)), size)
    return row, begin[of][row] + np.arange(len(row)) - (np.cumsum(size) - size)[row]


def _near_segments(segments: np.ndarray, begin: np.ndarray, count: np.ndarray, chain_owner: np.ndarray, wanted) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owners, s, t): pairs of segments whose boxes meet, of different chains of one owner.

    Chain k has ``count[k]`` segments from ``begin[k]`` on; ``wanted`` says which of two rows of chains are
    looked at, and is asked again for each block.  Owners with too many pairs of two chains are named, and
    these pairs left out.
    """
    lo, hi = np.minimum(segments[:, :2], segments[:, 2:]), np.maximum(segments[:, :2], segments[:, 2:])
    box_lo, box_hi = np.minimum.reduceat(lo, begin), np.maximum.reduceat(hi, begin)
    # boxes are moved apart by owner, predicates use the real positions
    far = chain_owner * (2.0 * float(np.abs(segments).max()) + 1.0) * 1.001
    pad = 1e-3
    boxes = np.column_stack([box_lo[:, 0] + far - pad, box_lo[:, 1] - pad, box_hi[:, 0] + far + pad, box_hi[:, 1] + pad])
    for i, j in _close_pairs(boxes):
        some = (chain_owner[i] == chain_owner[j]) & wanted(i, j)
        i, j = i[some], j[some]
        for at in range(0, len(i), 1 << 14):
            a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            row_a, seg_a = _expand(a, begin, count)
            ok = (lo[seg_a] <= box_hi[b[row_a]]).all(1) & (hi[seg_a] >= box_lo[b[row_a]]).all(1)
            row_a, seg_a = row_a[ok], seg_a[ok]
            row_b, seg_b = _expand(b, begin, count)
            ok = (lo[seg_b] <= box_hi[a[row_b]]).all(1) & (hi[seg_b] >= box_lo[a[row_b]]).all(1)
            row_b, seg_b = row_b[ok], seg_b[ok]
            n_b = np.bincount(row_b, minlength=len(a))
            many = np.bincount(row_a, minlength=len(a)) * n_b > _SLAB
            row_a, seg_a = row_a[~many[row_a]], seg_a[~many[row_a]]
            pair, place = _expand(row_a, np.cumsum(n_b) - n_b, n_b)
            s, t = seg_a[pair], seg_b[place]
            ok = (lo[s] <= hi[t]).all(1) & (hi[s] >= lo[t]).all(1)
            yield chain_owner[a[many]], s[ok], t[ok]


def meet_between(segments: np.ndarray, chain: np.ndarray, side: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cross, deep, touch, unsure) of each of ``n`` pairs of outlines, by the segments of one side against the other's.

    cross: interiors of two segments cross; deep: they do, or overlap along a line; touch: any two share a
    point; unsure: not all were compared.  chain, side and owner (the pair) of each segment: equal ones of an
    owner's side in a row.
    """
    cross, deep, touch, unsure = (np.zeros(n, bool) for _ in range(4))
    kept = (segments[:, :2] != segments[:, 2:]).any(1)
    segments, chain, side, owner = segments[kept], chain[kept], side[kept], owner[kept]
    if not len(segments):
        return cross, deep, touch, unsure
    begin = np.flatnonzero(np.concatenate(([True], (chain[1:] != chain[:-1]) | (side[1:] != side[:-1]) | (owner[1:] != owner[:-1]))))
    chain_side, chain_owner = side[begin], owner[begin]
    for many, s, t in _near_segments(segments, begin, np.diff(np.append(begin, len(segments))), chain_owner, lambda i, j: chain_side[i] != chain_side[j]):
        unsure[many] = True
        proper, along, some = _meetings(segments[s], segments[t])
        cross[owner[s[proper]]] = True
        deep[owner[s[proper | along]]] = True
        touch[owner[s[some]]] = True
    return cross, deep, touch, unsure


def inside_each(points: np.ndarray, outlines: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``inside`` of point k in the closed ring of ``size[k]`` rows of ``outlines`` from ``begin[k]`` on; as many points as rings."""
    if not len(points):
        return np.zeros(0, int)
    row, at = _expand(np.arange(len(points)), begin, size - 1)
    a, b, y = outlines[at], outlines[at + 1], points[row, 1]
    level = np.flatnonzero((np.minimum(a[:, 1], b[:, 1]) <= y) & (y <= np.maximum(a[:, 1], b[:, 1])))
    row = row[level]
    return _placed(points[row], row, a[level], b[level], len(points))


def valid_batch(segments: np.ndarray, chain: np.ndarray, ring: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` polygons whether its densified rings are valid, as ``valid_polygon`` says.

    segments: x1 y1 x2 y2 in ring order; chain: the source edge of each, ring: its ring (the first of
    an owner is the shell), owner: its polygon; all ascending.  Edges that stay apart by their boxes
    are never compared piece by piece, so straight densified edges cost next to nothing; polygons with
    touching rings or bent edges are checked in full.
    """
    out = np.ones(n, bool)
    kept = (segments[:, :2] != segments[:, 2:]).any(1)
    empty = np.setdiff1d(np.unique(ring), np.unique(ring[kept]))
    out[np.unique(owner[np.isin(ring, empty)])] = False
    segments, chain, ring, owner = segments[kept], chain[kept], ring[kept], owner[kept]
    if not len(segments):
        return out
    rings, ring, ring_size = np.unique(ring, return_inverse=True, return_counts=True)
    ring_begin = np.cumsum(ring_size) - ring_size
    ring_owner = owner[ring_begin]
    out[ring_owner[ring_size < 3]] = False
    begin = np.flatnonzero(np.concatenate(([True], (chain[1:] != chain[:-1]) | (ring[1:] != ring[:-1]))))
    count = np.diff(np.append(begin, len(segments)))
    of = np.repeat(np.arange(len(begin)), count)
    chord = segments[begin + count - 1, 2:] - segments[begin, :2]
    slow = np.zeros(n, bool)
    slow[owner[((segments[:, 2:] - segments[:, :2]) * chord[of]).sum(1) <= 0]] = True  # an edge may meet itself
    chain_owner = owner[begin]
    still_open = lambda i, j: out[chain_owner[i]] & ~slow[chain_owner[i]]
    for many, s, t in _near_segments(segments, begin, count, chain_owner, still_open):
        slow[many] = True
        if len(s):
            deep, touch = _meet(segments[s], segments[t])
            apart = np.abs(s - t)
            same = ring[s] == ring[t]
            neighbour = same & ((apart == 1) | (apart == ring_size[ring[s]] - 1))
            out[owner[s[deep | (touch & same & ~neighbour)]]] = False
            slow[owner[s[touch & ~same]]] = True
    first_ring = np.searchsorted(ring_owner, np.arange(n), "left")
    n_rings = np.searchsorted(ring_owner, np.arange(n), "right") - first_ring
    points = lambda r: np.vstack([segments[ring_begin[r] : ring_begin[r] + ring_size[r], :2], segments[ring_begin[r], :2]])
    alone = out & ~slow & (n_rings == 2)
    out[alone] = _hole_inside(segments, ring_begin, ring_size, first_ring[alone])
    for k in np.flatnonzero(out & (slow | (n_rings > 2))).tolist():
        own = [points(r) for r in range(first_ring[k], first_ring[k] + n_rings[k])]
        out[k] = valid_polygon(own) if slow[k] else _nested(own)
    return out


def _hole_inside(segments: np.ndarray, begin: np.ndarray, size: np.ndarray, shell: np.ndarray) -> np.ndarray:
    """Whether the ring after each ``shell`` lies in it; ``begin`` and ``size``: the segments of each ring.  The rings of a pair do not meet."""
    row, at = _expand(shell, begin, size)
    after = np.where(at + 1 == (begin + size)[shell][row], begin[shell][row], at + 1)
    a, b, y = segments[at, :2], segments[after, :2], segments[begin[shell + 1], 1][row]
    level = np.flatnonzero((np.minimum(a[:, 1], b[:, 1]) <= y) & (y <= np.maximum(a[:, 1], b[:, 1])))
    row = row[level]
    return _placed(segments[begin[shell + 1][row], :2], row, a[level], b[level], len(shell)) == 1


def _nested(rings: list[np.ndarray]) -> bool:
    """Whether rings that do not meet are a shell with holes beside each other inside it."""
    heads = np.array([r[0] for r in rings[1:]])
    if not (inside(heads, rings[0]) == 1).all():
        return False
    for k, hole in enumerate(rings[1:]):
        near = (heads >= hole.min(0)).all(1) & (heads <= hole.max(0)).all(1)
        near[k] = False
        if near.any() and (inside(heads[near], hole) == 1).any():
            return False
    return True


def covers(shell: np.ndarray, ring: np.ndarray) -> bool:
    """Whether a ring lies in the area of ``shell``, without crossing it."""
    return _contacts(_segments(shell), _segments(ring)) >= 0 and _side(ring, shell) == 1


def interiors_overlap(first: list[np.ndarray], second: list[np.ndarray]) -> bool:
    """Whether two valid polygons (shell and holes) share interior points."""
    a, b = [_segments(r) for r in first], [_segments(r) for r in second]
    if (a[0][:, ::2].max() <= b[0][:, ::2].min()) or (b[0][:, ::2].max() <= a[0][:, ::2].min()) or (a[0][:, 1::2].max() <= b[0][:, 1::2].min()) or (b[0][:, 1::2].max() <= a[0][:, 1::2].min()):
        return False
    every_a, every_b = np.vstack(a), np.vstack(b)
    touching = False
    for i, j in _close_pairs(every_a, every_b):
        s, t = every_a[i], every_b[j]
        touching = touching or len(i) > 0
        o = [orient(*s[:, :2].T, *s[:, 2:].T, *t[:, k : k + 2].T) for k in (0, 2)] + [orient(*t[:, :2].T, *t[:, 2:].T, *s[:, k : k + 2].T) for k in (0, 2)]
        if ((o[0] * o[1] < 0) & (o[2] * o[3] < 0)).any():
            return True
    if not touching:  # no boxes of edges meet: each polygon lies wholly inside or outside of the other
        return bool(_within(first[0][:1], second)[0] or _within(second[0][:1], first)[0])
    # no edges cross: interiors overlap if a point beside an edge of one is inside both
    return _probe(first, every_a, second) or _probe(second, every_b, first)


_BATCH_PAIRS = 2048


def rings_overlap(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """``interiors_overlap`` of many pairs of polygons without holes: row k of ``first`` and of ``second``, closed rings of one length each.

    All edges of a pair meet in one table, so this is for short rings; pairs are taken some thousand at a time.
    """
    step = max(1, _BATCH_PAIRS * 16 // max(1, (first.shape[1] - 1) * (second.shape[1] - 1)))
    parts = [_some_overlap(first[at : at + step], second[at : at + step]) for at in range(0, len(first), step)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _some_overlap(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first), bool)
    repeats = (first[:, 1:] == first[:, :-1]).all(2).any(1) | (second[:, 1:] == second[:, :-1]).all(2).any(1)
    for k in np.flatnonzero(repeats).tolist():  # repeated vertices leave edges out: such pairs have tables of their own
        out[k] = interiors_overlap([first[k]], [second[k]])
    apart = ((first.max(1) <= second.min(1)) | (second.max(1) <= first.min(1))).any(1)
    todo = np.flatnonzero(~apart & ~repeats)
    if not len(todo):
        return out
    first, second = first[todo], second[todo]
    a, b = np.moveaxis(first[:, :-1], 2, 0)[..., None], np.moveaxis(first[:, 1:], 2, 0)[..., None]
    c, d = np.moveaxis(second[:, :-1], 2, 0)[:, :, None], np.moveaxis(second[:, 1:], 2, 0)[:, :, None]
    meet = ((np.minimum(a, b) <= np.maximum(c, d)) & (np.minimum(c, d) <= np.maximum(a, b))).all(0)
    crossing = meet & (_signs(a, b, c) * _signs(a, b, d) < 0) & (_signs(c, d, a) * _signs(c, d, b) < 0)
    found, touching = crossing.any((1, 2)), meet.any((1, 2))
    alone = np.flatnonzero(~found & ~touching)
    found[alone] = (_sides(first[alone, :1], second[alone]) == 1)[:, 0] | (_sides(second[alone, :1], first[alone]) == 1)[:, 0]
    for own, other in ((first, second), (second, first)):
        open_ = np.flatnonzero(~found & touching)
        found[open_] = _probes(own[open_], other[open_])
    out[todo] = found
    return out


def _signs(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``orient`` of all places of tables whose first axis is X and Y."""
    flat = [v.ravel() for v in np.broadcast_arrays(*a, *b, *c)]
    return orient(*flat).reshape(np.broadcast_shapes(a.shape[1:], b.shape[1:], c.shape[1:]))


def _sides(points: np.ndarray, rings: np.ndarray) -> np.ndarray:
    """``inside`` of the points of each row in that row's ring."""
    p = np.moveaxis(points, 2, 0)[..., None]
    a, b = np.moveaxis(rings[:, :-1], 2, 0)[:, :, None], np.moveaxis(rings[:, 1:], 2, 0)[:, :, None]
    side = _signs(a, b, p)
    on = ((side == 0) & (np.minimum(a, b) <= p).all(0) & (p <= np.maximum(a, b)).all(0)).any(2)
    up, down = (a[1] <= p[1]) & (b[1] > p[1]) & (side > 0), (a[1] > p[1]) & (b[1] <= p[1]) & (side < 0)
    winding = (up.astype(int) - down.astype(int)).sum(2)
    return np.where(on, 0, np.where(winding != 0, 1, -1))


def _probes(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``_probe`` of each row's polygon against the other one."""
    out = np.zeros(len(own), bool)
    middle, step = (own[:, :-1] + own[:, 1:]) / 2, own[:, 1:] - own[:, :-1]
    size = np.abs(own - own[:, :1, :1]).max((1, 2), initial=0.0)
    size = np.where(size == 0, 1.0, size)
    normal = np.stack([-step[..., 1], step[..., 0]], 2) * (1e-7 * size[:, None] / np.maximum(np.hypot(step[..., 0], step[..., 1]), 1e-300))[..., None]
    for sign in (1, -1):
        points = middle + sign * normal
        out |= ((_sides(points, own) == 1) & (_sides(points, other) == 1)).any(1)
    return out


def _within(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    held = inside(points, rings[0]) == 1
    for hole in rings[1:]:
        held &= inside(points, hole) == -1
    return held


def _probe(rings: list[np.ndarray], segments: np.ndarray, other: list[np.ndarray]) -> bool:
    """Whether a point just inside an edge's middle belongs to both polygons."""
    middle = (segments[:, :2] + segments[:, 2:]) / 2
    step = segments[:, 2:] - segments[:, :2]
    normal = np.column_stack([-step[:, 1], step[:, 0]])
    size = float(np.abs(segments - segments[0, 0]).max()) or 1.0
    normal *= 1e-7 * size / np.maximum(np.hypot(*step.T), 1e-300)[:, None]
    low, high = np.maximum(rings[0].min(0), other[0].min(0)), np.minimum(rings[0].max(0), other[0].max(0))
    for sign in (1, -1):
        points = middle + sign * normal
        points = points[((points >= low) & (points <= high)).all(1)]  # no other point is inside both
        for at in range(0, len(points), 64):
            part = points[at : at + 64]
            part = part[_within(part, other)]
            if len(part) and _within(part, rings).any():
                return True
    return False
