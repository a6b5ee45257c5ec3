from .tables import observations, observations_from_events, table  # noqa: F401
from .io import (read_observations, write_observations, read_requests,  # noqa: F401
                 write_metrics, read_metrics)
