"""The edges that one task contracts before the rounds of the component step."""

import numpy as np
import pandas as pd

from emberfold.operators import components


def test_stars_are_carried_from_chunk_to_chunk(monkeypatch):
    """A place read in many chunks leaves one edge for each node but the smallest, not one for each chunk."""
    monkeypatch.setattr(components, "CHUNK_EDGES", 1_000)
    rng = np.random.default_rng(5)
    frames = [pd.DataFrame({"u": (v := rng.integers(0, 100, 400)) + rng.integers(1, 30, 400), "v": v}) for _ in range(20)]
    stars = pd.concat(components._contract(iter(frames)))
    nodes = set(np.concatenate([np.concatenate([f["u"], f["v"]]) for f in frames]).tolist())
    assert len(stars) == len(nodes) - 1 and set(stars["v"]) == {min(nodes)}
