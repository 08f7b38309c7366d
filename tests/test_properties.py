"""Properties that hold for any input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from rasterloom.functions import kernels as K
from rasterloom.operators import motion, network
from rasterloom.operators.tracking import Colonies

masks = hnp.arrays(bool, hnp.array_shapes(min_dims=2, max_dims=2, min_side=1, max_side=9))


def flood(a):
    out, n = np.zeros(a.shape, int), 0
    for y, x in np.argwhere(a):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            p, q = todo.pop()
            if 0 <= p < a.shape[0] and 0 <= q < a.shape[1] and a[p, q] and not out[p, q]:
                out[p, q] = n
                todo += [(p + i, q + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


@settings(max_examples=150, deadline=None)
@given(masks)
def test_labels_are_flood_fills(a):
    assert (K.label(a) == flood(a)).all()


@settings(max_examples=100, deadline=None)
@given(masks)
def test_morphology_is_dual_and_ordered(a):
    assert (K.erode(a) <= a).all() and (a <= K.dilate(a)).all()
    assert (K.erode(a, K.SQUARE) == ~K.dilate(~a, K.SQUARE)).all()
    assert (K.close_holes(a) >= a).all() and not (K.holes(a) & a).any()


@settings(max_examples=100, deadline=None)
@given(masks)
def test_outlines_lie_in_shapes(a):
    big = K.largest(a)
    path = K.trace(big)
    assert big[tuple(path.T)].all()
    hull = K.hull(path)
    assert K.polygon_area(hull) >= K.polygon_area(path) - 1e-9
    long, short = sorted(K.least_box(hull), reverse=True)
    assert long * short >= K.polygon_area(hull) - 1e-6


@settings(max_examples=80, deadline=None)
@given(masks)
def test_skeletons_and_graphs_hold_together(a):
    s = K.skeleton(a)
    assert (s <= a).all() and K.label(s).max() == K.label(a).max() or not a.any()
    g = network.Graph(s)
    ids = set(g.vertices.values())
    assert all(v in ids and w in ids for v, w, _ in g.edges)


@settings(max_examples=80, deadline=None)
@given(st.lists(hnp.arrays(bool, (6, 6)), min_size=1, max_size=5))
def test_colonies_cover_the_foreground(frames):
    c, seen = Colonies(), set()
    for a in frames:
        out = c.label(a)
        assert ((out > 0) == a).all()
        seen |= set(out[a].tolist())
    assert seen <= set(range(1, c.next))


@settings(max_examples=80, deadline=None)
@given(hnp.arrays(bool, (8, 8)), hnp.arrays(bool, (8, 8)), st.integers(0, 6))
def test_joined_shapes_keep_the_old_one(new, old, distance):
    out = motion.connect(new, old, motion.Rules(max_distance=distance))
    assert (out >= old).all()
    assert K.label(out).max() <= max(K.label(old).max(), 1) or not old.any()
