"""Query bindings: operators applied to the derived inputs."""

from . import activity, audits, charts, extraction, facts, governed, selection, taxonomy  # noqa: F401
