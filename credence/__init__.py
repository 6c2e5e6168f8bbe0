"""credence: bi-temporal, probabilistic time series on Spark."""

from credence.frame import BeliefFrame, belief
from credence.operators.propagate import propagate_beliefs
from credence.operators.viewpoint import unchanged_beliefs
from credence.sensors import BeliefSource, Sensor
from credence.sources.files import load_time_series, read_beliefs, write_csv
from credence.sources.store import BeliefStore, DuplicateBelief, search

__all__ = ["BeliefFrame", "BeliefSource", "BeliefStore", "DuplicateBelief", "Sensor", "belief", "load_time_series", "propagate_beliefs", "read_beliefs", "search", "unchanged_beliefs", "write_csv"]
