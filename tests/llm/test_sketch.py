"""Sketches of near copies never rule a similar pair out."""

import random

import numpy as np

from quillgraph.llm import nearcopies


def test_sketches_bound_the_difference_of_texts():
    random.seed(5)
    for size in (0, 3, 5, 60, 400, 3000):
        words = [b"w%d" % random.randrange(500) for _ in range(size)]
        for edits in (0, 1, size // 40, size // 4):
            other = list(words)
            for _ in range(edits if size else 0):
                other[random.randrange(size)] = b"x%d" % random.randrange(10**6)
            a, b = (nearcopies.shingle_hashes(nearcopies.word_hashes(x)) for x in (words, other))
            x, y = nearcopies.sketch(a), nearcopies.sketch(b)
            assert (x[0], y[0]) == (len(a), len(b))
            assert len(x) == 1 + nearcopies.SKETCH_BITS // 64
            bits = int(np.unpackbits((x[1:] ^ y[1:]).view("u1")).sum())
            assert bits <= len(np.setxor1d(a, b))
