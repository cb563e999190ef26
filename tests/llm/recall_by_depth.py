"""How often pairs at a similarity stay together in the trees of near-dedup, by the number of levels.

    python tests/llm/recall_by_depth.py

A pair is followed through the branching of neardup itself (its roots, hashes
and positions), as if every node were too large to compare, so that d levels
must be passed: the worst case. Prints the share of pairs that one of the trees
still has in one node.
"""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from lodestone.llm import neardup as N  # noqa: E402

DEPTHS = (0, 1, 2, 4, 8, 12, 16)
#: Paths of a pair that are followed; more are near to certain to last.
MOST = 200


def pair(rng: np.random.Generator, size: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Two sets of about that many shingles with that similarity."""
    common = round(2 * size * similarity / (1 + similarity))
    x = np.unique(rng.integers(0, 2**64, 2 * size - common, dtype=np.uint64))
    rng.shuffle(x)
    own = size - common
    return np.sort(x[: common + own]), np.sort(np.concatenate([x[:common], x[common + own :]]))


def lasts(a: np.ndarray, b: np.ndarray) -> int:
    """The deepest of DEPTHS at which a tree has both in one node; -1 if none has at the root."""
    sig = np.stack([np.frombuffer(N.signature(s), "<u2").astype(np.uint64) for s in (a, b)])
    first = np.stack([np.frombuffer(N.first_tokens(s), np.uint64) for s in (a, b)])
    at = np.flatnonzero(first[0] == first[1])
    nodes = np.concatenate([N._child(np.array([t], np.uint64), N.SIGNATURE, first[0, t : t + 1]) for t in at]) if len(at) else np.zeros(0, np.uint64)
    best = -1
    for depth in range(DEPTHS[-1] + 1):
        if not len(nodes):
            break
        best = depth
        mine, theirs = (N._branch(nodes, np.repeat(s[None], len(nodes), 0))[1] for s in sig)
        nodes = mine[mine == theirs][:MOST]
    return best


def recall(similarity: float, pairs: int = 2000, size: int = 400, seed: int = 1) -> dict[int, float]:
    rng = np.random.default_rng(seed)
    deep = np.array([lasts(*pair(rng, size, similarity)) for _ in range(pairs)])
    return {d: float((deep >= d).mean()) for d in DEPTHS}


if __name__ == "__main__":
    print("similarity", *(f"{d:>7}" for d in DEPTHS))
    for s in (0.75, 0.775, 0.80, 0.85):
        print(f"{s:<10}", *(f"{r:7.4f}" for r in recall(s).values()))
