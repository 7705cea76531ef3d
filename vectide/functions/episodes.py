"""Entity ids that pack an episode and a step: episode << 16 | step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_STEPS = 0xFFFF
MOST_EPISODES = 2**47 - 1  # ids are signed here


def encode(episode: Column, step: Column) -> Column:
    """The packed id; null where a part is out of range."""
    ok = episode.between(0, MOST_EPISODES) & step.between(0, MOST_STEPS)
    return F.when(ok, F.shiftleft(episode.cast("long"), 16).bitwiseOR(step.cast("long")))


def episode(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 16)


def step(packed: Column) -> Column:
    return packed.bitwiseAND(MOST_STEPS)


def episode_range(number: int) -> tuple[int, int]:
    """First and last packed id of an episode, for a pushed-down range filter."""
    return number << 16, number << 16 | MOST_STEPS
