"""Column factories: missing-value rules, text, dates, labels and scale scores."""

from . import dates, labels, missing, numeric, scales, scoring, text  # noqa: F401
