"""Query suites; importing this package registers them all."""

from . import em, evaluation, fitted, joint, joins, likelihood, misc, online, polygons, profiles, rewards, scans, sequences, spatial, statistics, streams  # noqa: F401
